"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into 2-bit segments; the segments' bit counts form a
vector of 32 numbers.  Flipping one bit moves one count by one, so Hamming
distance is at least the Manhattan distance of the vectors.  Fingerprints within
three bits are thus within Manhattan distance three, and one half of the vector is
within distance one.  The grid join keys on each half: every fingerprint enters
its own cell and, if the half's bit count is odd, all cells one step away (of two
vectors one step apart one is odd, so each such pair meets once).  Members of a
cell are then compared exactly.

Cells report a spanning forest of their links, not all pairs, so a hot group
costs as many rows as it has members.  Equal fingerprints are one member from the
start.  Members of cells with over ``MAX_CELL`` enter four narrower ones each, by the
values of the fingerprint's quarters, one of which two members within three bits share.
What is still larger is cut into chunks, and every pair of chunks is compared by a task
of its own.

Fingerprints of near copies may differ in many more bits.  ``overlap_links`` therefore
finds texts by an exact join on their sets of ``WIDTH``-word shingles (module
``overlap``), and links their fingerprints, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import overlap
from .common import boxed, col, content_key, cut_lineage, release, small_side, unboxed
from .components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
MAX_CELL = 16_384
_PAIRS_BELOW = 48


# --- fingerprints ------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text as an unsigned number; no words: 0."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = h[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long. Null texts count as empty."""
    narrow = df.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return narrow.mapInArrow(run, StructType([*(narrow.schema[c] for c in keep), StructField("fp", LongType())]))


# --- the grid join -----------------------------------------------------------------------


def grid_cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each half's own cell and, for odd halves, the cells one step away."""
    mask32, ones, pairs = F.lit(0xFFFFFFFF), F.lit(0x55555555), F.lit(3)
    halves = F.array(F.struct(F.lit(0).alias("i"), F.col("fp").bitwiseAND(mask32).alias("x")), F.struct(F.lit(1).alias("i"), F.shiftrightunsigned("fp", 32).alias("x")))
    one = fps.select("fp", F.inline(halves))
    counts = F.col("x") - F.shiftright("x", 1).bitwiseAND(ones)  # a field of two bits holds its segment's count
    packed = one.select("fp", "i", counts.alias("v"), (F.bit_count("x") % 2 == 1).alias("odd"))

    def step(j):
        field, unit = F.call_function("shiftright", F.col("v"), j).bitwiseAND(pairs), F.call_function("shiftleft", F.lit(1).cast("long"), j)
        return F.array(F.when(field < 2, F.col("v") + unit), F.when(field > 0, F.col("v") - unit))

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), step))
    cells = F.when(F.col("odd"), F.concat(F.array("v"), around)).otherwise(F.array("v"))
    out = packed.select("fp", "i", F.explode(cells).alias("v")).where("v is not null")
    return out.select((F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")).alias("cell"), "fp")


def forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of ``distance`` bits connect among distinct fingerprints: (member, its root)."""
    left, a, b = fps, [], []
    while len(left):
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near |= np.bitwise_count(left ^ f) <= distance
            front, left = left[near], left[~near]
            a.append(front)
            b.append(np.full(len(front), root))
    return np.concatenate([*a, fps[:0]]), np.concatenate([*b, fps[:0]])


def _links(cells: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``cells``: small runs all at once, by offset; large ones as forests."""
    if not len(cells):
        return fps, fps
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    a, b = [], []
    small = np.repeat(sizes <= _PAIRS_BELOW, sizes)
    c, f = cells[small], fps[small]
    for offset in range(1, int(sizes[sizes <= _PAIRS_BELOW].max(initial=1))):
        hit = np.flatnonzero((c[offset:] == c[:-offset]) & (np.bitwise_count(f[offset:] ^ f[:-offset]) <= DISTANCE))
        a.append(f[hit])
        b.append(f[hit + offset])
    for s, n in zip(starts[sizes > _PAIRS_BELOW], sizes[sizes > _PAIRS_BELOW], strict=True):
        x, y = forest(np.unique(fps[s : s + n]))
        a.append(x)
        b.append(y)
    return np.concatenate([*a, fps[:0]]), np.concatenate([*b, fps[:0]])


def _compare(limit: int | None):
    """Compares the members of each cell of a sorted partition; rows of cells over ``limit`` go out again, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def rows(again: bool, a, b):
            kind = pa.array(np.full(len(a), again))
            return pa.RecordBatch.from_arrays([kind, pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64))], names=["again", "a", "b"])

        for batch in batches:
            c = np.concatenate((held_c, batch.column(0).to_numpy()))
            f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
            if over is not None and len(c):
                rest = int(np.searchsorted(c, over, "right"))  # more of the cell that is too large
                yield rows(True, c[:rest], f[:rest])
                c, f = c[rest:], f[rest:]
            if not len(c):
                continue
            over, done = None, int(np.searchsorted(c, c[-1], "left"))  # the last cell may go on
            yield rows(False, *_links(c[:done], f[:done]))
            held_c, held_f = c[done:], f[done:]
            if limit is not None and len(held_c) > limit:
                over = held_c[-1]
                yield rows(True, held_c, held_f)
                held_c, held_f = held_c[:0], held_f[:0]
        if len(held_c):
            yield rows(False, *_links(held_c, held_f))

    return run


_OUT = "again boolean, a long, b long"


def fingerprint_links(fps: DataFrame, max_cell: int = MAX_CELL) -> DataFrame:
    """(a, b): links that connect exactly what pairs within ``DISTANCE`` bits connect; ``fps``: distinct ``fp``."""

    def compared(cells: DataFrame, limit: int | None) -> DataFrame:
        return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(limit), _OUT)

    def again(out: DataFrame) -> DataFrame:
        return out.where("again").select(F.col("a").alias("cell"), F.col("b").alias("fp"))

    first = cut_lineage(compared(grid_cells(fps), max_cell))
    links = first.where("not again").select("a", "b")
    if first.where("again").isEmpty():
        return links.distinct()
    quarters = F.array(*[F.xxhash64("cell", F.lit(j), F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF)) for j in range(4)])
    second = cut_lineage(compared(again(first).select(F.explode(quarters).alias("cell"), "fp"), max_cell))
    links = links.union(second.where("not again").select("a", "b"))
    if second.where("again").isEmpty():
        return links.distinct()
    large = again(second)
    n = large.groupBy("cell").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / max_cell).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    spread = large.join(n.select("cell", chunks.alias("k")), "cell").withColumn("c", mine)
    spread = spread.select("cell", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("d"))
    task = F.xxhash64("cell", F.least("c", "d"), F.greatest("c", "d"))
    rest = compared(spread.select(task.alias("cell"), "fp"), None)
    return links.union(rest.select("a", "b")).distinct()


def fingerprint_components(rows: DataFrame, max_cell: int = MAX_CELL, more: DataFrame | None = None) -> DataFrame:
    """(fp, component_id) for all fingerprints of ``rows`` (id, fp): the smallest id reachable, over links ``more``, too."""
    reps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    links = fingerprint_links(reps.select("fp"), max_cell)
    parts = connected_components(links if more is None else links.union(more))
    linked = parts.withColumnRenamed("node", "fp").join(reps, "fp")
    ids = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked_ids = parts.join(ids, "component").select(F.col("node").alias("fp"), "component_id")
    # written, so that joins with it start from an exchange on either side and a hot fingerprint's rows can be split
    return cut_lineage(reps.join(linked_ids, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document row: id, ``fp`` and ``component_id``, the smallest id of all documents linked to it.

    Null and empty texts have fingerprint 0 and link like any others; ids may
    repeat; null ids never name a component that has another id.
    """
    rows = cut_lineage(with_fingerprints(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), ["id"]))
    joined = rows.join(small_side(fingerprint_components(rows)), "fp")
    return joined.select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", overlapping: bool = False) -> DataFrame:
    """Keep one row of each component, that with the smallest id (then the smallest content key); all columns stay.

    With ``overlapping``, texts whose shingle sets overlap enough (module ``overlap``) are
    linked as well.  Rows without an id are kept only if their component has no id at all.
    """
    keys = [k.alias(x) for k, x in zip(content_key(col(id_col), col(text_col)), ("k1", "k2"), strict=True)]
    keyed = docs.select(boxed(docs), *keys, col(id_col).alias("id"), col(text_col).alias("text"))
    rows = cut_lineage(with_fingerprints(keyed, ["id", "k1", "k2"]))
    more = overlap.fingerprint_links(keyed, rows, DISTANCE) if overlapping else None
    release(docs.sparkSession)
    parts = fingerprint_components(rows, more=more)
    same = rows.groupBy("fp", "k1", "k2", "id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull(), "id", "k1", "k2", "n")
    # a component without any id is one of equal or linked rows that all lack it: its links still decide
    name = F.coalesce(F.concat(F.lit("i"), F.col("component_id").cast("string")), F.concat(F.lit("f"), F.col("fp").cast("string")))
    best = same.join(small_side(parts), "fp").groupBy(name.alias("c")).agg(F.min(order).alias("w"))
    winners = cut_lineage(best.select("w.k1", "w.k2", "w.n"))
    del more, parts, rows, same, best
    release(docs.sparkSession)
    kept = keyed.join(winners, ["k1", "k2"])
    once = kept.where("n = 1").select(*unboxed(docs.columns))
    if winners.where("n > 1").isEmpty():
        return once
    return once.union(kept.where("n > 1").dropDuplicates(["k1", "k2"]).select(*unboxed(docs.columns)))
