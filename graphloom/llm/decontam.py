"""Benchmark decontamination by greedy string tiling.

A document is held against a benchmark item by tiles: non-overlapping runs of at
least ``min_tile`` equal words, the longest marked first.  The share of the
item's words under tiles is its coverage, which does not change when the passage's
parts are reordered.

Candidates are found by joining the distinct (Karp-Rabin) hashes of the word windows
of both sides; a pair goes on if the item's words under shared windows reach the
threshold.  For a tile, the greatest length at which a free run of both sides has an
equal hash is found by halving, from sums of hashes that give any window's at once;
then the words are compared, so a hash collision never counts.  No list of all places
where two texts meet is ever formed: a tile costs time in proportion to the document's
shared stretches, however often a word repeats.

The benchmark's distinct texts are read in blocks of about ``block_bytes`` (a longer
text is a block by itself), each broadcast by itself, so what a task holds is bounded
however large the benchmark grows; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut_lineage, free_name
from .license_scan import words_of

MIN_TILE = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
#: Parts, by hash, whose sizes are summed to put blocks together: so many for each block's worth of text.
PARTS_A_BLOCK = 16
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a whole text: runs of letters and digits, or of other non-ASCII characters."""
    return words_of((text or b"").decode("utf-8", "replace").lower().encode())


class Rolling:
    """Hashes of all windows of any length of some numbers, from sums over their beginnings."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        one = np.ones(1, np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        # weighed by falling powers of the base, so that one running sum serves all windows
        falling = np.cumprod(np.concatenate((one, np.full(max(self.n - 1, 0), _INVERSE))), dtype=np.uint64)[: self.n]
        self.power = np.cumprod(np.concatenate((one, np.full(self.n, _BASE))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * falling, dtype=np.uint64)))

    def windows(self, k: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of ``k`` numbers at ``starts`` (all)."""
        at = np.arange(max(self.n - k + 1, 0)) if starts is None else starts
        return (self.sums[at + k] - self.sums[at]) * self.power[at]


def free_starts(free: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` free numbers begin."""
    count = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(count[k:] - count[:-k] == k) if len(free) >= k else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of numbers: (document place, item place, length), in the order they are marked.

    The longest run of equal free numbers goes first; among equals the first by item place, then document place.
    """
    of_doc, of_item = Rolling(doc), Rolling(item)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def shared(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, p = free_starts(free_doc, k), free_starts(free_item, k)
        hd, hp = of_doc.windows(k, d), of_item.windows(k, p)
        return d, p, hd, np.flatnonzero(np.isin(hp, hd)) if len(d) and len(p) else p[:0]

    top = min(len(doc), len(item))
    while True:
        low, high = min_tile - 1, top  # a run of ``low`` is shared, one of more than ``high`` is not
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if len(shared(k)[3]) else (low, k - 1)
        if low < min_tile:
            return out
        d, p, hd, hits = shared(low)
        h = of_item.windows(low, p[hits])
        by = np.argsort(hd, kind="stable")
        first = by[np.searchsorted(hd[by], h)]  # the first document place of each hash
        found = next(((int(d[x]), int(p[y])) for x, y in zip(first, hits, strict=True) if np.array_equal(doc[d[x] : d[x] + low], item[p[y] : p[y] + low])), None)
        if found is None:  # nothing but collisions at this length
            top = low - 1
            continue
        at, place = found
        free_doc[at : at + low] = False
        free_item[place : place + low] = False
        out.append((at, place, low))
        top = low


class Block:
    """A block of distinct benchmark texts, entered by the hashes of their windows."""

    def __init__(self, items: list[tuple[object, bytes]], min_tile: int):
        self.k, self.number = min_tile, {}
        self.keys = [key for key, _ in items]
        self.items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64) for _, t in items]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        hashes = [Rolling(x).windows(min_tile) for x in self.items]
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        at = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] + [np.zeros(0, np.int64)])
        order = np.lexsort((place, at, flat))
        self.at, self.place = at[order], place[order]
        self.hashes, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))

    def matches(self, text: bytes | None, threshold: float) -> list[tuple[int, int, int, int]]:
        """(item, tiles, covered words, item words) of all items covered to the threshold."""
        if not len(self.hashes):
            return []
        tokens = words(text)
        ids, k = np.fromiter(map(self.number.get, tokens, repeat(0)), np.int64, len(tokens)), self.k
        starts = free_starts(ids > 0, k)
        if not len(starts):
            return []
        h = Rolling(ids).windows(k, starts)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        met = self.hashes[slot] == h
        if not met.any():
            return []
        keys = np.unique(slot[met])  # each shared window once, however often it stands in the text
        sizes = self.end[keys] - self.begin[keys]
        x = np.repeat(self.begin[keys] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        by = np.lexsort((self.place[x], self.at[x]))
        at, place = self.at[x][by], self.place[x][by]
        same = np.append(at[1:] == at[:-1], False)
        step = np.where(same, np.minimum(np.append(place[1:], 0) - place, k), k)  # words of a window that the next one leaves to it
        under = np.bincount(at, step, len(self.items))
        out, places = [], starts[met]
        for i in np.flatnonzero((under > 0) & (under >= threshold * self.sizes)):
            item = self.items[i]
            own = places[np.isin(h[met], Rolling(item).windows(k))]
            stretch = np.zeros(len(ids) + 1, np.int64)
            np.add.at(stretch, own, 1)
            np.add.at(stretch, own + k, -1)
            inside = np.cumsum(stretch[:-1]) > 0
            # shared stretches of the document, with a number that no item has between them
            edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0])))).reshape(-1, 2)
            doc = np.concatenate([y for a, b in edges for y in (ids[a:b], [0])])
            marked = tiles(doc, item, k)
            covered = sum(length for *_, length in marked)
            if covered >= threshold * len(item):
                out.append((int(i), len(marked), covered, len(item)))
        return out


def benchmark_blocks(texts: DataFrame, block_bytes: int) -> Iterator[DataFrame]:
    """``texts`` (x, t) in blocks of about ``block_bytes``: parts by hash, put together by their summed sizes."""
    total = texts.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n_parts = max(1, PARTS_A_BLOCK * -(-total // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.col("x"), F.lit(n_parts))
    sizes = {r["p"]: r["n"] for r in texts.groupBy(part.alias("p")).agg(F.sum(F.octet_length("t")).alias("n")).collect()}
    first, held = 0, 0
    for p in range(n_parts):
        if held and held + sizes.get(p, 0) > block_bytes:
            yield texts.where((part >= first) & (part < p))
            first, held = p, 0
        held += sizes.get(p, 0)
    if held:
        yield texts.where((part >= first) & (part < n_parts))


def find(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = MIN_TILE, threshold: float = COVERAGE, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_text_col: str = "text") -> tuple[DataFrame, str, DataFrame]:
    """(``docs`` with one more column, its name, the distinct benchmark texts).

    The column is an array of (x, n_tiles, covered_words, item_words) for each row,
    ``x`` and ``y`` naming a benchmark text (``item_names``).  Texts on either side that
    are null, empty or shorter than ``min_tile`` words match nothing.  Repeated rows each
    keep their row; all columns pass through.
    """
    named = benchmark.select(*item_names(item_text_col), col(item_text_col).cast("binary").alias("t")).where("t is not null")
    texts = cut_lineage(named.groupBy("x", "y").agg(F.first("t").alias("t")))
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("x", "y", "n_tiles", "covered_words", "item_words")]))
    matches = free_name(docs, "matches")
    out = docs.select("*", F.array().cast(kind).alias(matches))
    for block in benchmark_blocks(texts, block_bytes):
        items = [((r["x"], r["y"]), bytes(r["t"])) for r in block.collect()]  # block_bytes, or one text
        out = _against(out, items, kind, min_tile, threshold, docs.columns.index(text_col))
    return out, matches, texts


def item_names(item_text_col: str) -> list:
    """Two hashes that stand for a benchmark text."""
    text = col(item_text_col).cast("binary")
    return [F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y")]


def _against(df: DataFrame, items: list, kind: T.ArrayType, min_tile: int, threshold: float, at: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    shared, names, arrow = df.sparkSession.sparkContext.broadcast(items), df.columns, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, min_tile)
        for batch in batches:
            before, found = batch.column(len(names) - 1).to_pylist(), []
            for t, had in zip(batch.column(at), before, strict=True):
                text = t.as_py()
                text = text.encode() if isinstance(text, str) else text
                found.append((had or []) + [dict(zip(_FIELDS, (*block.keys[i], n, c, m), strict=True)) for i, n, c, m in block.matches(text, threshold)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=names)

    return df.mapInArrow(run, df.schema)


_FIELDS = ("x", "y", "n_tiles", "covered_words", "item_words")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row for each document row and benchmark row that it covers to the threshold; clean documents give none.

    Benchmark rows of one text each have their pairs; null ids on either side stay null.
    """
    slim = docs.select(col(id_col).alias("d"), col(text_col).alias("text"))
    found, matches, _ = find(slim, benchmark, text_col="text", item_text_col=item_text_col, **options)
    met = found.select("d", F.explode(matches).alias("m")).select("d", "m.*")
    items = benchmark.select(col(item_col).alias("i"), *item_names(item_text_col))
    pairs = met.join(items, ["x", "y"])
    numbers = [F.col(c).cast("int").alias(c) for c in _FIELDS[2:]]
    return pairs.select(F.col("d").alias(id_col), F.col("i").alias("item_id"), *numbers, (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item; all columns stay as they are."""
    found, matches, _ = find(docs, benchmark, **options)
    return found.where(F.size(matches) == 0).select(*[col(c) for c in docs.columns])
