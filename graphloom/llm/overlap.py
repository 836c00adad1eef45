"""An exact join of texts whose shingle sets overlap, for near copies that fingerprints miss.

Two sets whose Jaccard index is 4/5 or more share a shingle within the first fifth (and
one more) of either, in any common order; shingles whose buckets are rare among
all texts come first, so few texts meet.  Each key's texts are compared where they meet, by sizes and places:

* a key of up to ``HOT`` texts gives the pairs that may still overlap enough;
* a key of more is gone through in parts: each text goes to the first one, a leader, whose
  fingerprint is within ``NEAR`` bits, or becomes a leader itself, and leaders of several
  parts meet again.  Texts are verified against their leaders only, and those that link
  (within two links) are one class;
* keys whose texts are of several classes are gone through once more, part against part:
  of two texts of different classes, bits that tell in which buckets a set has an odd
  number of shingles must allow for the overlap; only such pairs go out.

So a large group of near copies costs a row a member and key, not its pairs.  All pairs
are verified on the whole sets before they link anything; sets meet for a part of the
pairs at a time, as many as carry ``SHARE`` of all sets, so the disk that takes follows the
texts, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, small_side

#: Words of a shingle; the Jaccard index asked for is 4/5.
WIDTH = 5
#: Shingles of all texts are counted in so many hash buckets; the counts only order them.
BUCKETS = 1 << 16
#: Bits of a set's parities.
PARITIES = 512
#: Keys of more texts give no pairs at first; a part of such a key has as many texts as PART.
HOT, PART = 12, 4096
#: Bits within which a text goes to a leader. Whether they link is verified, so this only saves work.
NEAR = 14
#: Sets that pairs carry to their other side at once, as a part of the sets of all texts.
SHARE = 0.5


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's ``width``-word shingles (all its words, if fewer), ascending; no words: none."""
    import xxhash

    words = text.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)] * n
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of the texts of ``docs`` (text) fall into each bucket; a text counts each of its shingles once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                seen += np.bincount((shingle_set(t.as_py()) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("t")).where("t is not null")
    counts = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def with_prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(k1, k2, s1, s2, n, odd, prefix) of texts with words: hashes of the set, its size, parities and prefix in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[int] = []
            names, more, sizes, odd, prefixes = [], [], [], [], []
            for i, t in enumerate(batch.column(2)):
                h = shingle_set(t.as_py())
                n = len(h)
                if n:
                    order = np.lexsort((h, counts[(h % np.uint64(BUCKETS)).astype(np.int64)]))
                    rows.append(i)
                    ones = np.bincount((h % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) % 2
                    odd.append(np.packbits(ones.astype(np.uint8)).tobytes())
                    names.append(xxhash.xxh64_intdigest(h.tobytes()))
                    more.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
                    sizes.append(n)
                    prefixes.append(h[order[: n - (4 * n + 4) // 5 + 1]].view(np.int64))
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
            new = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, more)]
            new += [pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=["k1", "k2", "s1", "s2", "n", "odd", "prefix"])

    texts = docs.select("k1", "k2", F.col("text").cast("binary").alias("t")).where("t is not null")
    return texts.mapInArrow(run, "k1 long, k2 long, s1 long, s2 long, n long, odd binary, prefix array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(m, h): the shingle set of each text of ``docs`` (m, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["m", "h"])

    return docs.select("m", F.col("text").cast("binary").alias("t")).mapInArrow(run, "m long, h array<long>")


# --- texts that meet in a key ------------------------------------------------------------
#
# A place (n << 32 | i) is a set's size and where the key stands in its order.


def may_overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets can have a Jaccard index of 4/5 that share a shingle at places ``x`` and ``y``, by sizes and what is left of them."""
    a, b = x >> 32, y >> 32
    rest = np.minimum(a - (x & 0xFFFFFFFF), b - (y & 0xFFFFFFFF))
    return (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * rest >= 4 * (a + b))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of a partition sorted by the first of them, in stretches that end where its value changes."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        done = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        if done:
            yield tuple(x[:done] for x in held)
            held = tuple(x[done:] for x in held)
    if held is not None and len(held[0]):
        yield held


def _edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))


_MET = "key long, a long, b long"


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    low, high = np.minimum(x, y), np.maximum(x, y)
    by = np.lexsort((high, low))
    low, high = low[by], high[by]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(low)]
    return low[new], high[new]


def _batch(key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, m, place), sorted: pairs (null, a, b) of keys of up to HOT texts; (key, m, place) again of larger ones."""
    for key, m, place in _runs(batches):
        edges = _edges(key)
        sizes = np.diff(edges)
        cold = np.repeat(sizes <= HOT, sizes)
        if not cold.all():
            yield _batch(key[~cold], m[~cold], place[~cold])
        k, x, p = key[cold], m[cold], place[cold]
        a, b = [], []
        for offset in range(1, int(sizes[sizes <= HOT].max(initial=1))):
            hit = np.flatnonzero(k[offset:] == k[:-offset])
            hit = hit[may_overlap(p[hit], p[hit + offset])]
            a.append(x[hit])
            b.append(x[hit + offset])
        low, high = _distinct(a, b)
        yield _batch(pa.nulls(len(low), pa.int64()), low, high)


def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (task, key, m, place, fp), sorted by task and m: (key, leader, text) for all, leaders with themselves."""
    for task, key, m, place, fp in _runs(batches):
        edges = _edges(task)
        bits = fp.view(np.uint64)
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            left = np.arange(start, stop)
            while len(left):
                first = left[0]
                mine = (np.bitwise_count(bits[left] ^ bits[first]) <= NEAR) & may_overlap(place[left], place[first])
                mine[0] = True
                of = left[mine]
                yield _batch(np.full(len(of), key[first]), np.full(len(of), m[first]), m[of])
                left = left[~mine]


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (task, c, m, place, mine, odd), sorted by task: pairs of different components, one of them ``mine``, that sizes, places and parities allow for."""
    for task, c, m, place, mine, odd in _runs(batches):
        edges = _edges(task)
        a, b = [], []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            bits = np.frombuffer(b"".join(odd[start:stop]), np.uint64).reshape(stop - start, -1)
            for i in np.flatnonzero(mine[start:stop].astype(bool)) + start:
                others = np.flatnonzero((c[start:stop] != c[i]) & may_overlap(place[start:stop], place[i]))
                differ = np.bitwise_count(bits[others] ^ bits[i - start]).sum(axis=1)
                others = others[9 * differ <= (place[others + start] >> 32) + (place[i] >> 32)] + start
                a.append(np.full(len(others), m[i]))
                b.append(m[others])
        low, high = _distinct(a, b)
        yield _batch(pa.nulls(len(low), pa.int64()), low, high)


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, distance: int) -> DataFrame:
    """(a, b, far) of ``pairs``: those within ``distance`` bits, and (``far``) those whose sets have a Jaccard index of 4/5 or more.

    The others are sifted by parities before their sets are fetched and compared.
    """
    facts = lambda x: texts.select(F.col("m").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "odd")])
    met = pairs.where("a <> b").distinct().join(facts("a"), "a").join(facts("b"), "b")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb, fa, fb = (batch.column(i).to_numpy() for i in range(6))
                oa, ob = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(a), -1) for i in (6, 7))
                far = np.bitwise_count((fa ^ fb).view(np.uint64)) > distance
                ok = ~far | (9 * np.bitwise_count(oa ^ ob).sum(axis=1) <= na + nb)
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, na, nb, far)], names=["a", "b", "n_a", "n_b", "far"])

    sifted = met.select("a", "b", "n_a", "n_b", "fp_a", "fp_b", "odd_a", "odd_b").mapInArrow(few, "a long, b long, n_a long, n_b long, far boolean")
    close = cut_lineage(sifted)
    asked = close.where("far")
    wanted = asked.select(F.explode(F.array("a", "b")).alias("m")).distinct()
    chosen = cut_lineage(texts.join(wanted, "m", "left_semi").select("m", "k1", "k2"))
    rows = docs.select("k1", "k2", "text").join(small_side(chosen), ["k1", "k2"])
    sets = cut_lineage(whole_sets(rows).dropDuplicates(["m"]))
    release(sets.sparkSession)
    left, right = (sets.select(F.col("m").alias(x), F.col("h").alias(f"h_{x}")) for x in "ab")
    same = "9 * size(array_intersect(h_a, h_b)) >= 4 * (n_a + n_b)"
    carried, all_sets = asked.agg(F.sum("n_a")).first()[0] or 0, texts.agg(F.sum("n")).first()[0] or 1
    parts = max(1, math.ceil(carried / (SHARE * all_sets)))
    linked = close.where("not far").select("a", "b", "far")
    for i in range(parts):
        some = asked.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
        linked = linked.union(cut_lineage(some.join(left, "a").join(right, "b").where(same).select("a", "b", "far")))
        release(sets.sparkSession)
    return cut_lineage(linked)


def _leaders(hot: DataFrame) -> DataFrame:
    """(a, b): each text of ``hot`` (key, m, place, fp) with its leaders."""
    pairs, left, before = None, hot, None
    while True:
        parts = left.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
        dealt = left.join(parts, "key").select(F.xxhash64("key", F.pmod(F.xxhash64("m"), F.col("parts"))).alias("task"), "key", "m", "place", "fp")
        got = cut_lineage(dealt.repartition("task").sortWithinPartitions("task", "m").mapInArrow(lead, _MET))
        pairs = got.select("a", "b") if pairs is None else pairs.union(got.select("a", "b"))
        several = cut_lineage(parts.where("parts > 1").select("key"))
        leaders = got.where("a = b").select("key", F.col("a").alias("m")).join(several, "key", "left_semi")
        left = cut_lineage(left.join(leaders, ["key", "m"], "left_semi"))
        now = left.count()
        if now == 0 or before is not None and now > before // 2:
            return pairs
        before = now


def _classes(found: DataFrame) -> DataFrame:
    """(m, c): the smallest text within two links of each linked text."""
    both = found.select("a", "b").union(found.select("b", "a")).toDF("m", "o").distinct()
    one = both.groupBy("m").agg(F.least(F.min("o"), F.col("m")).alias("c"))
    return both.join(one.toDF("o", "c"), "o").groupBy("m").agg(F.least(F.min("c"), F.col("m"), F.min("o")).alias("c"))


def meetings(texts: DataFrame) -> DataFrame:
    """What ``meet`` finds among all keys of ``texts`` (m, n, prefix)."""
    index = texts.select(F.posexplode("prefix").alias("i", "key"), "m", "n").select("key", "m", (F.shiftleft("n", 32) + F.col("i")).alias("place"))
    return cut_lineage(index.repartition("key").sortWithinPartitions("key", "m").mapInArrow(meet, _MET))


def links(texts: DataFrame, met: DataFrame, docs: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that, with those of fingerprints up to ``distance`` bits apart, connect what all pairs of overlapping sets connect.

    ``texts``: distinct sets (m, k1, k2, fp, n, odd); ``met``: their ``meetings``; ``docs``: rows (k1, k2, text).
    """
    hot = met.where("key is not null").select("key", F.col("a").alias("m"), F.col("b").alias("place"))
    any_hot = not hot.isEmpty()
    pairs = met.where("key is null").select("a", "b")
    if any_hot:
        facts = texts.select("m", "fp")
        pairs = pairs.union(_leaders(cut_lineage(hot.join(facts, "m").select("key", "m", "place", "fp"))))
    release(docs.sparkSession)
    found = _verified(pairs, texts, docs, distance)
    if any_hot:
        classes = small_side(cut_lineage(_classes(found)))
        named = hot.join(classes, "m", "left").select("key", "m", "place", F.coalesce("c", "m").alias("c"))
        mixed = named.groupBy("key").agg((F.min("c") != F.max("c")).alias("mixed"), F.count("*").alias("size")).where("mixed").select("key", "size")
        left = cut_lineage(named.join(mixed, "key"))
        if not left.isEmpty():
            parts = F.ceil(F.col("size") / PART)
            dealt = left.join(texts.select("m", "odd"), "m").select("key", "c", "m", "place", "odd", F.pmod(F.xxhash64("m"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("p"))
            tasks = dealt.select(F.xxhash64("key", F.least("part", "p"), F.greatest("part", "p")).alias("task"), "c", "m", "place", (F.col("part") <= F.col("p")).alias("mine"), "odd")
            more = cut_lineage(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(sift, _MET))
            release(docs.sparkSession)
            found = found.union(_verified(more.select("a", "b"), texts, docs, distance))
    return found.where("far").select("a", "b")


def fingerprint_links(docs: DataFrame, rows: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between fingerprints of texts whose shingle sets have a Jaccard index of 4/5 or more.

    ``docs``: rows (k1, k2, text); ``rows``: their fingerprints (k1, k2, fp).  With the links of
    fingerprints up to ``distance`` bits apart they connect what all such pairs connect.
    """
    sets = with_prefixes(docs, shingle_counts(docs)).groupBy("s1", "s2").agg(F.min(F.struct("k1", "k2", "n", "odd", "prefix")).alias("t"))
    one = sets.select(F.monotonically_increasing_id().alias("m"), "t.*")
    wide = cut_lineage(one.join(rows.select("k1", "k2", "fp").dropDuplicates(["k1", "k2"]), ["k1", "k2"]))
    release(docs.sparkSession)
    met, texts = meetings(wide), cut_lineage(wide.select("m", "k1", "k2", "fp", "n", "odd"))
    del wide  # the prefixes go
    release(docs.sparkSession)
    found = links(texts, met, docs, distance)
    a, b = (texts.select(F.col("m").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    pairs = found.join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return cut_lineage(pairs.where("a <> b").distinct())
