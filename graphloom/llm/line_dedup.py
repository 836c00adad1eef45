"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line that is not blank goes if an equal line stands earlier in the corpus, or another
line within t edits first stands earlier (documents in order of id, lines in order of
place).  t is EDITS among lines of ``MIN_CHARS`` characters or more, 1 among shorter ones of
half as many or more, and 0 below.  If two lines are within t edits and one is cut into
t + 1 segments, some segment stands unchanged in the other, shifted by no more than the
edits allow.  So each distinct line indexes its t + 1 segments by (length, segment number,
hash) and probes, for every length up to t shorter, only the few substrings whose shift
can still be paid for.  Pairs that meet are verified by a banded bit-parallel edit
distance: 2 t + 1 diagonals in one machine word, one step a character.

Only hashes of segments are shuffled; texts of lines are fetched for candidate pairs
alone, and compared if the letters they have an odd number of allow for the edits.  Copies of
a line are merged before anything is joined, so a line that a third of all documents
share costs no more than another; a distinct line is named by a number given once.

Keys that over ``HOT_KEY`` distinct lines index are counted first and give no pairs.  Their
lines are cut anew without the segment that they share: what is left is within the same
edits, so the same two sets of keys find all pairs.  Lines that are still many to a key
tell by semi-joins, split into parts, which of them have an earlier near one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, col, content_key, cut_lineage, small_side

EDITS = 2
MIN_CHARS = 24
#: Segment keys that over so many distinct lines index give no pairs.
HOT_KEY = 16
#: Lines of one key that a task of the last semi-joins compares with all others of the key.
HOT_PART = 2048


def segment_bounds(n: str, edits: int = EDITS) -> list[tuple[str, str]]:
    """SQL of (start from 0, length) of the even segments of a line of ``n`` characters, the longer ones last."""
    parts = edits + 1
    small = f"({n} div {parts})"
    long_from = f"({parts} - {n} % {parts})"  # segments from this number on have one more
    out = []
    for i in range(parts):
        start = f"({i} * {small} + greatest(0, {i} - {long_from}))"
        out.append((start, f"({small} + if({i} >= {long_from}, 1, 0))"))
    return out


def edits_of(n: str) -> str:
    """SQL of the edits that a line of ``n`` characters allows for."""
    return f"case when {n} >= {MIN_CHARS} then {EDITS} when {n} >= {MIN_CHARS // 2} then least(1, {EDITS}) else 0 end"


def index_segments(n: str, edits: int) -> list[tuple[str, str, str]]:
    """SQL of (what a key tells beside the segment, start from 0, length) of each key that a line of ``n`` characters is indexed by."""
    return [(f"{n}, {i}", s, q) for i, (s, q) in enumerate(segment_bounds(n, edits))]


def probe_segments(n: str, edits: int, shorter: int) -> list[tuple[str, str, str]]:
    """The same for the keys under which lines ``shorter`` characters shorter and within ``edits`` edits are indexed."""
    m, out = f"({n} - {shorter})", []
    for i, (s, q) in enumerate(segment_bounds(m, edits)):
        # i edits may lie before segment i, edits - i after it; so many characters are deleted in all
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
            out.append((f"{m}, {i}", f"greatest({s} + {shift}, 0)", q))
    return out


def _array(items: list[str], kind: str) -> str:
    return f"cast(array({', '.join(items)}) as array<{kind}>)"


def _hash(of: tuple[str, str, str], line: str, salt: str) -> str:
    what, start, length = of
    return f"xxhash64({salt}{what}, substring({line}, {start} + 1, {length}))"


def _by_class(n: str, make) -> str:
    """SQL of the array of what ``make(edits)`` lists, by the edits that ``n`` characters allow for."""
    branches = " ".join(f"when {edits_of(n)} = {t} then {make(t)}" for t in range(EDITS, 0, -1))
    return f"case {branches} else {make(0)} end"


def index_keys(line: str = "line", n: str = "n", edits: int | None = None, salt: str = "") -> str:
    """SQL of the array of index keys of a line."""
    of = lambda t: _array([_hash(x, line, salt) for x in index_segments(n, t)] if t else [], "bigint")
    return _by_class(n, of) if edits is None else of(edits)


def probe_keys(line: str = "line", n: str = "n", edits: int | None = None, salt: str = "") -> str:
    """SQL of the array of keys under which lines within their edits and not longer than this one are indexed."""
    if edits is not None:
        return _array([_hash(x, line, salt) for d in range(edits + 1) for x in probe_segments(n, edits, d)], "bigint")
    return _by_class(n, lambda t: _array([_hash(x, line, salt) for d in range(t + 1) for x in probe_segments(n, t, d)] if t else [], "bigint"))


def _rests(segments, line: str, t: int) -> str:
    """SQL of the array of (key, rest, edits) of ``segments``: the line without the segment, beside its key."""
    items = [f"named_struct('key', {_hash(x, line, '')}, 'rest', concat(substring({line}, 1, {x[1]}), substring({line}, {x[1]} + {x[2]} + 1)), 't', {t})" for x in segments]
    return _array(items if t else [], "struct<key:bigint,rest:string,t:int>")


def index_rests(line: str = "line", n: str = "n") -> str:
    return _by_class(n, lambda t: _rests(index_segments(n, t), line, t))


def probe_rests(line: str = "line", n: str = "n") -> str:
    return _by_class(n, lambda t: _rests([x for d in range(t + 1) for x in probe_segments(n, t, d)], line, t))


def common_prefix(a: str, b: str) -> str:
    """SQL of the number of characters that two strings begin with alike: a binary search by powers of two."""
    length = f"least(char_length({a}), char_length({b}))"
    grow = f"if(p + shiftleft(1, e) <= {length} and substring({a}, p + 1, shiftleft(1, e)) = substring({b}, p + 1, shiftleft(1, e)), p + shiftleft(1, e), p)"
    return f"aggregate(sequence(length(bin({length})), 0, -1), 0, (p, e) -> {grow})"


def edit_distance(a: str, b: str, edits: int = EDITS) -> Column:
    """Edit distance of SQL strings ``a`` (the longer or as long) and ``b`` if at most ``edits``; else some larger number.

    What both begin and end with alike is cut off.  For the rest, a column of the
    table of distances is kept on the diagonals -edits..edits as two bit vectors,
    where it rises and where it falls; rows above the first one count as characters
    that never match.
    """
    w = 2 * edits + 1
    full, top = (1 << w) - 1, 1 << (w - 1)
    falls, rises = (1 << (edits + 1)) - 1, full ^ ((1 << (edits + 1)) - 1)
    equal = " | ".join(f"if(j + {t - edits} >= 1 and get(x, j + {t - edits} - 1) = get(y, j - 1), {1 << t}L, 0L)" for t in range(w))
    column = f"named_struct('e', {equal}, 'p', shiftright(s.p, 1) | {top}L, 'n', shiftright(s.n, 1))"
    same = f"named_struct('p', c.p, 'n', c.n, 'd', ((((c.e & c.p) + c.p) ^ c.p) | c.e | c.n) & {full}L)"
    flat = f"named_struct('d', v.d, 'h', (v.n | ~(v.d | v.p)) & {full}L, 'l', v.d & v.p)"
    last = (
        f"named_struct('p', (shiftleft(u.l, 1) | ~(u.d | shiftleft(u.h, 1) | 1L)) & {full}L, 'n', u.d & (shiftleft(u.h, 1) | 1L), "
        f"'k', s.k + 1 - (shiftright(u.d, {edits} + size(x) - size(y)) & 1L))"
    )
    step = f"transform(transform(transform(array({column}), c -> {same}), v -> {flat}), u -> {last})[0]"
    start = f"named_struct('p', {rises}L, 'n', {falls}L, 'k', cast(size(x) - size(y) as bigint))"
    walk = f"aggregate(sequence(1, size(y)), {start}, (s, j) -> if(s.k > {edits}, s, {step}), s -> s.k)"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    chars = let("split(r.a, '')", "x", let("split(r.b, '')", "y", walk))
    middle = f"if(r.b = '', cast(char_length(r.a) as bigint), {chars})"
    back = let(common_prefix("reverse(f.a)", "reverse(f.b)"), "q", let("named_struct('a', substring(f.a, 1, char_length(f.a) - q), 'b', substring(f.b, 1, char_length(f.b) - q))", "r", middle))
    front = let(common_prefix(a, b), "i", let(f"named_struct('a', substring({a}, i + 1), 'b', substring({b}, i + 1))", "f", back))
    return F.expr(front)


def letter_parity(line: str = "line") -> Column:
    """Bits that tell which letters stand in a line an odd number of times: an edit flips two at most."""
    odd = [f"shiftleft((char_length({line}) - char_length(replace({line}, '{c}', ''))) % 2, {i})" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123")]
    return F.expr(" | ".join(odd))


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines that are not blank of ``docs`` (k1, k2, id, text): (k1, k2, id, pos, line, n, and the line's hashes i1, i2)."""
    split = docs.select("k1", "k2", "id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    said = split.withColumn("n", F.char_length("line")).where(r"line rlike '[^\\x20\\x09-\\x0D]'")
    return said.select("*", F.xxhash64("line").alias("i1"), F.xxhash64(F.lit(1), "line").alias("i2"))


def _place(*more: str) -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos", *more)


def _alike(odd_a: str, odd_b: str) -> Column:
    """Whether letter parities allow for two lines to be within the edits."""
    return F.bit_count(F.col(odd_a).bitwiseXOR(F.col(odd_b))) <= 2 * EDITS


def _within() -> Column:
    """Whether the lines ``a`` (the longer, of n_a characters) and ``b`` (of n_b) are within their edits."""
    return (F.expr(edits_of("n_a")) == F.expr(edits_of("n_b"))) & (edit_distance("a", "b") <= F.expr(edits_of("n_b")))


def meetings(index: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``index`` (key, b) and ``probe`` (key, a): the pairs (a, b) that share a key, and the keys (key, n) of more than HOT_KEY lines, which give none."""
    hot = cut_lineage(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY))
    cold = index.join(small_side(hot), "key", "left_anti")
    return probe.join(cold, "key").where("a <> b").select("a", "b").distinct(), hot


def earlier_of(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(line): the later of each pair (a, b) of near lines; ``known``: (l, line, n, odd, first)."""
    left, right = (known.select(F.col("l").alias(f"l{x}"), F.col("line").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "odd", "first")]) for x in "ab")
    both = pairs.select(F.col("a").alias("la"), F.col("b").alias("lb")).join(left, "la").join(right, "lb")
    close = both.where((F.col("n_a") >= F.col("n_b")) & _alike("odd_a", "odd_b")).where(_within())
    return close.select(F.when(F.col("first_a") > F.col("first_b"), F.col("la")).otherwise(F.col("lb")).alias("l"))


def near_earlier(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """(l): distinct lines that have another one within the edits which first stands earlier.

    ``distinct``: l, i1, i2, n, first, ix, pr.
    """
    index = distinct.select(F.explode("ix").alias("key"), F.col("l").alias("b"))
    probe = distinct.select(F.explode("pr").alias("key"), F.col("l").alias("a"))
    met, hot = meetings(index, probe)
    pairs = cut_lineage(met)
    any_hot = not hot.isEmpty()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("l"))
    if any_hot:
        hot = small_side(hot.select("key"))
        members = cut_lineage(probe.join(hot, "key", "left_semi").select(F.col("a").alias("l"), "key"))  # lines that index a key probe it, too
        wanted = wanted.union(members.select("l"))
    chosen = cut_lineage(distinct.join(wanted.distinct(), "l", "left_semi").select("l", "i1", "i2", "n", "first"))
    texts = lines.select("i1", "i2", "line").join(small_side(chosen.select("i1", "i2"), 1_000_000), ["i1", "i2"], "left_semi").groupBy("i1", "i2").agg(F.first("line").alias("line"))
    known = cut_lineage(chosen.join(texts, ["i1", "i2"]).select("l", "line", "n", letter_parity().alias("odd"), "first"))
    found = earlier_of(pairs, known)
    if any_hot:
        found = found.union(_near_in_hot_keys(members, known))
    return found.distinct()


def _near_in_hot_keys(members: DataFrame, known: DataFrame) -> DataFrame:
    """(l) as ``near_earlier``, among lines that probe hot keys: ``members`` (l, key)."""
    asked = members.groupBy("l").agg(F.collect_set("key").alias("keys"))  # no more than a line has keys
    own = known.join(asked, "l")
    of = lambda rests: own.select("l", F.explode(F.expr(f"filter({rests}, x -> array_contains(keys, x.key))")).alias("x")).select("l", "x.*", F.char_length("x.rest").alias("m"))

    def again(df: DataFrame, keys) -> DataFrame:
        by_edits = " ".join(f"when {t} then {keys('rest', 'm', t, 'key, ')}" for t in range(1, EDITS + 1))
        return df.select("l", F.explode(F.expr(f"case t {by_edits} end")).alias("key")).distinct()

    index = cut_lineage(again(of(index_rests()), index_keys).select("key", F.col("l").alias("b")))
    probe = cut_lineage(again(of(probe_rests()), probe_keys).select("key", F.col("l").alias("a")))
    met, hot = meetings(index, probe)
    found = earlier_of(met, known)
    if hot.isEmpty():
        return found
    parts = F.ceil(F.col("n") / HOT_PART).cast("long").alias("parts")
    keyed = hot.select("key", parts)
    columns = ["line", "n", "odd", "first"]
    # each of a key's lines goes to one part, and those it may be near to go to all of them
    return found.union(_later(probe, index, "a", "b", keyed, known, columns)).union(_later(index, probe, "b", "a", keyed, known, columns))


def _later(mine: DataFrame, others: DataFrame, x: str, y: str, hot: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """(l): lines of ``mine`` (key, x) with an earlier near one among ``others`` (key, y) of the same hot key; side a is the longer."""
    def texts(name: str) -> DataFrame:
        return known.select(F.col("l").alias(f"l_{name}"), F.col("line").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns[1:]])

    one = mine.join(hot, "key").select("key", F.pmod(F.xxhash64(x), F.col("parts")).alias("part"), F.col(x).alias(f"l_{x}")).join(texts(x), f"l_{x}")
    all_of = others.join(hot, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col(y).alias(f"l_{y}")).join(texts(y), f"l_{y}")
    near = (F.col("l_a") != F.col("l_b")) & (F.col(f"first_{y}") < F.col(f"first_{x}")) & (F.col("n_a") >= F.col("n_b")) & _alike("odd_a", "odd_b") & _within()
    return one.join(all_of, (one["key"] == all_of["key"]) & (one["part"] == all_of["part"]) & near, "left_semi").select(F.col(f"l_{x}").alias("l"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, dropped, first): the sorted numbers, from 0, of the lines that go from each document of ``docs`` (k1, k2, id, text) that loses any.

    Of rows equal in id and text one is the earliest; ``first`` are the lines that only the others of them lose.
    """
    lines = lines_of(docs)
    # the few short lines by themselves, as one expression for all lengths is too large a method to be compiled well
    long, short = lines.where(F.col("n") >= MIN_CHARS), lines.where(F.col("n") < MIN_CHARS)
    with_keys = lambda df, t: df.select("k1", "k2", "id", "pos", "i1", "i2", F.struct("n", F.expr(index_keys(edits=t)).alias("ix"), F.expr(probe_keys(edits=t)).alias("pr")).alias("of"))
    keyed = with_keys(long, EDITS).unionByName(with_keys(short, None))
    merged = keyed.groupBy("i1", "i2").agg(F.count("*").alias("copies"), F.min(_place("of")).alias("first"))
    at = F.struct(*[F.col(f"first.{c}").alias(c) for c in ("none", "id", "k1", "k2", "pos")]).alias("first")
    distinct = cut_lineage(merged.select(F.monotonically_increasing_id().alias("l"), "i1", "i2", "copies", at, "first.of.*"))
    near = near_earlier(lines, distinct).withColumn("near", F.lit(True))
    judged = distinct.select("l", "i1", "i2", "copies", "first").join(near, "l", "left").where("near or copies > 1").select("i1", "i2", "first", "near")
    places = lines.select("k1", "k2", "id", "pos", "i1", "i2").join(judged, ["i1", "i2"])
    gone = places.select("k1", "k2", "pos", (F.col("near").isNull() & (_place() == F.col("first"))).alias("earliest"))
    # a row equal in id and text to others shares its lines' places with them: its own first lines go from all but one
    sorted_set = lambda kept: F.array_sort(F.collect_set(F.when(F.col("earliest") == kept, F.col("pos"))))
    return gone.groupBy("k1", "k2").agg(sorted_set(False).alias("dropped"), sorted_set(True).alias("first"))


def _keyed(docs: DataFrame, names: list[str], text_col: str, id_col: str) -> DataFrame:
    keys = [k.alias(x) for k, x in zip(content_key(col(id_col), col(text_col)), ("k1", "k2"), strict=True)]
    return docs.select(boxed(docs, names), *keys, col(id_col).alias("id"), col(text_col).alias("text"))


def _decided(rows: DataFrame, carried: list[str]) -> DataFrame:
    """(k1, k2, carried, dropped) of ``rows`` (k1, k2, id, text, ..); ``dropped`` is null if nothing goes.  Only ``carried`` is shuffled."""
    gone = dropped_lines(rows.select("k1", "k2", "id", "text"))
    rows = rows.select("k1", "k2", *carried)
    repeated = cut_lineage(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"))
    if repeated.isEmpty():
        return rows.join(gone.drop("first"), ["k1", "k2"], "left")
    repeated = small_side(repeated)
    plain = rows.join(repeated, ["k1", "k2"], "left_anti").join(gone.drop("first"), ["k1", "k2"], "left")
    # of equal rows the least number stays whole; the numbers are written, so they do not change
    equal = cut_lineage(rows.join(repeated, ["k1", "k2"], "left_semi").withColumn("number", F.monotonically_increasing_id()))
    whole = cut_lineage(equal.groupBy("k1", "k2").agg(F.min("number").alias("whole")))
    judged = equal.join(small_side(whole), ["k1", "k2"]).join(gone, ["k1", "k2"], "left")
    lost = F.when(F.col("number") == F.col("whole"), F.col("dropped")).otherwise(F.array_sort(F.array_union("dropped", "first")))
    return plain.unionByName(judged.withColumn("dropped", lost).drop("number", "whole", "first"))


def decide(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a document row: id, ``n_lines`` (of the split at line feeds; null text: 0) and ``dropped``.

    Of rows equal in id and text one counts as the earliest, so the others lose all their
    lines; rows of one id with other texts are in order of a hash.  Rows without an id
    come last.  Blank lines stay; null and blank texts lose nothing.
    """
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    rows = _decided(_keyed(docs, [id_col], text_col, id_col).withColumn("n_lines", n_lines), ["id", "n_lines"])
    return rows.select(F.col("id").alias(id_col), "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the dropped lines gone from the text; every row and all other columns stay."""
    rows = _decided(_keyed(docs, [c for c in docs.columns if c != text_col], text_col, id_col), ["row", "text"])
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(dropped, i)), '\\n')")
    text = F.when(F.col("dropped").isNull() | (F.size("dropped") == 0), F.col("text")).otherwise(kept)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
