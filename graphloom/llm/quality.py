"""Quality rules with robust multivariate outlier rejection, in DataFrame functions only.

Each text gives counts (words, symbols, repeated lines and word windows).  A
document that passes the fixed rules is then held against the minimum-covariance-
determinant estimate of its language and source, and rejected if its squared
Mahalanobis distance exceeds ``CUTOFF``.

Of all sets of ``CORE`` of a group's rows the one whose covariance has the least
determinant is sought by concentration steps: the rows closest to an estimate give
the next one, which never raises the determinant.  Steps go on until it no longer
falls, from three starts (medians with median deviations, with winsorised
correlations, and with spatial signs), and the least determinant wins.  ``FLOORS``
squared are added to the diagonals throughout, as in the regularised estimate.

Groups are estimated on three levels: all rows, each language, each language and
source.  A language's estimate is averaged with that of all rows, and a source's with
its language's, by their numbers of rows against ``PRIOR_ROWS``.  So a small group
leans on larger ones, and every row that passes the fixed rules is judged.

Statistics are rounded to multiples of 1/256 and summed as whole numbers, so
estimates do not depend on the order of rows.  A concentration step is one
aggregation: moments are summed by group and distance bin before the shuffle, and the
core is the closest bins, of the last of them the share that fills it.  A hot source
therefore costs a task no more rows than it has bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, col, cut_lineage, small_side, unboxed

SPACE = r"\x20\x09-\x0D"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, SQL over STATS; each is rounded to 1/UNIT.
VECTOR = (
    "ln(n_words)",
    "4 * ln(cast(word_chars as double) / n_words)",
    "ln(1 + cast(1000 as double) * n_symbols / n_words)",
    "ln(1 + cast(1000 as double) * n_dup_lines / n_words)",
    "ln(1 + cast(100 as double) * n_repeat_words / n_words)",
)
UNIT = 256
#: Least standard deviation of each transformed statistic: keeps a covariance of constant columns regular.
FLOORS = (1.5, 0.5, 1.0, 1.0, 1.0)
#: Share of a group's rows in the core, and the least fall of the determinant's logarithm for another step.
CORE, FALL = 0.75, 1e-3
#: Squared distance beyond which a row is rejected: chi-squared with 5 degrees of freedom, 1 - 5e-6.
CUTOFF = 32.5
#: Covariance of the central 75 % of a 5-dimensional normal sample times this is that of the whole.
CONSISTENCY = 1.59
#: As many rows the next larger group counts for in a group's estimate.
PRIOR_ROWS = 400
#: Distance bins: ln(1 + squared distance) in steps of 1/BINS.
BINS = 64
#: Starts winsorise at so many deviations, and round their directions to 1/GRAIN.
CLIP, GRAIN = 2, 1024
P = len(VECTOR)

Y = [f"y{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MEANS, COVARIANCES = [f"m{i}" for i in range(P)], [f"c{i}{j}" for i, j in PAIRS]


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns other than the text, with STATS and ``base_failed``; a null text has no words.

    Input columns of those names are replaced; all others pass through.  Word windows
    are sorted by hashes beside their places; those that meet are compared as words.
    """
    keep = [c for c in df.columns if c not in (text_col, *STATS, "base_failed")]
    text = df.select(boxed(df, keep), F.coalesce(col(text_col), F.lit("")).alias("t"))
    cut = text.select(
        "row",
        F.expr(rf"filter(split(t, '[{SPACE}]+'), x -> x <> '')".replace("\\", "\\\\")).alias("w"),
        F.expr(rf"filter(split(t, '\n', -1), x -> x rlike '[^{SPACE}]')".replace("\\", "\\\\")).alias("l"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
    )
    counted = cut.select(
        "row", "w", "n_symbols",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(size(l) - size(array_distinct(l)) as bigint)").alias("n_dup_lines"),
        F.expr("length(bin(size(w)))").alias("b"),
    )
    so_far = ["row", *STATS[:-1]]
    # a number holds as much of a window's hash as the bits of its place leave
    packed = "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), b) | cast(i as bigint)))"
    by_hash = counted.select(*so_far, "w", "b", F.expr(packed).alias("q"))
    beside = "(k > 0 and {0}) or (k < size({1}) - 1 and {2})"
    same_hash = beside.format("shiftright(get(q, k - 1), b) = shiftright(x, b)", "q", "shiftright(get(q, k + 1), b) = shiftright(x, b)")
    met = by_hash.select(*so_far, "w", F.expr(f"transform(filter(q, (x, k) -> {same_hash}), x -> cast(x & (shiftleft(1L, b) - 1) as int))").alias("p"))
    windows = met.select(*so_far, F.expr("sort_array(transform(p, i -> named_struct('s', concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i)))").alias("v"))
    same = beside.format("get(v, k - 1).s = x.s", "v", "get(v, k + 1).s = x.s")
    again = windows.select(*so_far, F.expr(f"sort_array(transform(filter(v, (x, k) -> {same}), x -> x.i))").alias("r"))
    covered = "aggregate(zip_with(r, slice(r, 2, size(r)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"
    out = again.select(*so_far, F.expr(covered).alias(STATS[-1]))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    return out.select(*unboxed(keep), *STATS, failed)


def cholesky(total: DataFrame) -> DataFrame:
    """Add the factor l00, l10, l11, .. of the covariance c00, c10, c11, .. and ``ld``, the logarithm of its determinant."""
    for j in range(P):
        inner = " ".join(f"- l{j}{k} * l{j}{k}" for k in range(j))
        total = total.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest(c{j}{j} {inner}, 1D))"))
        for i in range(j + 1, P):
            inner = " ".join(f"- l{i}{k} * l{j}{k}" for k in range(j))
            total = total.withColumn(f"l{i}{j}", F.expr(f"(c{i}{j} {inner}) / l{j}{j}"))
    return total.withColumn("ld", F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(P))))


def distance(y: list[str] = Y) -> str:
    """SQL of the squared Mahalanobis distance of y from m0.. by the factor l00.., solved row by row."""
    z: list[str] = []
    for i in range(P):
        z.append(f"(({y[i]} - m{i} {' '.join(f'- l{i}{j} * {z[j]}' for j in range(i))}) / l{i}{i})")
    return " + ".join(f"pow({x}, 2)" for x in z)


def starts(points: DataFrame) -> DataFrame:
    """(g, k, n, m0.., c00..): the first estimates of each group of ``points`` (g, y0..), numbered by k."""
    middle = [F.percentile(y, F.lit(0.5)).alias(m) for y, m in zip(Y, MEANS, strict=True)]
    centers = cut_lineage(points.groupBy("g").agg(F.count("*").alias("n"), *middle))
    off = points.join(small_side(centers), "g")
    mads = off.groupBy("g").agg(*[F.percentile(F.abs(F.col(y) - F.col(m)), F.lit(0.5)).alias(f"d{i}") for i, (y, m) in enumerate(zip(Y, MEANS, strict=True))])
    wide = [F.expr(f"sqrt(pow(1.4826D * d{i}, 2) + {FLOORS[i] * UNIT}D * {FLOORS[i] * UNIT}D)").alias(f"w{i}") for i in range(P)]
    scales = cut_lineage(centers.join(mads, "g").select("g", "n", *MEANS, *wide))
    z = points.join(small_side(scales), "g").select("g", *[F.expr(f"(y{i} - m{i}) / w{i}").alias(f"z{i}") for i in range(P)])
    long = z.select("*", F.expr(f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(P))})").alias("norm"))
    clipped = [F.expr(f"cast(round(greatest(-{CLIP}D, least({CLIP}D, z{i})) * {GRAIN}) as bigint)").alias(f"u{i}") for i in range(P)]
    signs = [F.expr(f"if(norm = 0, 0, cast(round(z{i} / norm * {GRAIN}) as bigint))").alias(f"v{i}") for i in range(P)]
    products = [F.sum(F.col(f"{x}{i}") * F.col(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "uv" for i, j in PAIRS]
    sums = scales.join(long.select("g", *clipped, *signs).groupBy("g").agg(*products), "g")

    def start(k: int, cov) -> str:
        items = [f"{k} as k", "n", *MEANS, *[f"{cov(i, j)} as {c}" for (i, j), c in zip(PAIRS, COVARIANCES, strict=True)]]
        return f"struct({', '.join(items)})"

    floor = lambda i, j: f" + {FLOORS[i] * UNIT}D * {FLOORS[i] * UNIT}D" if i == j else ""
    of = [
        start(0, lambda i, j: f"w{i} * w{i}" if i == j else "0D"),
        start(1, lambda i, j: f"w{i} * w{j} * u{i}{j} / n / {GRAIN * GRAIN}{floor(i, j)}"),
        start(2, lambda i, j: f"{P} * w{i} * w{j} * v{i}{j} / n / {GRAIN * GRAIN}{floor(i, j)}"),
    ]
    return sums.select("g", F.inline(F.expr(f"array({', '.join(of)})")))


FACTOR = [f"l{i}{j}" for i, j in PAIRS]
ESTIMATE = ["g", "k", "n", *MEANS, *COVARIANCES, *FACTOR, "ld"]


def concentrate(points: DataFrame, now: DataFrame) -> DataFrame:
    """One step: ESTIMATE by the rows closest to each estimate of ``now`` (g, k, n, m0.., l00..)."""
    factor = now.select("g", "k", "n", *MEANS, *FACTOR)
    near = points.join(factor, "g").select("g", "k", "n", *Y, F.expr(f"cast(floor(ln(1 + {distance()}) * {BINS}) as bigint)").alias("bin"))
    moments = [F.sum(y).alias(f"s{i}") for i, y in enumerate(Y)] + [F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    binned = near.groupBy("g", "k", "n", "bin").agg(F.count("*").alias("here"), *moments)
    before = F.coalesce(F.sum("here").over(Window.partitionBy("g", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = F.expr(f"cast(ceil({CORE}D * n) as bigint)")
    filled = binned.select("*", core.alias("h"), before.alias("before")).where("before < h")
    whole, share = F.col("before") + F.col("here") <= F.col("h"), (F.col("h") - F.col("before")) / F.col("here")
    names = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in PAIRS]
    # whole numbers first, then the share of the one bin that only fills up the core
    sums = [(F.coalesce(F.sum(F.when(whole, F.col(x))), F.lit(0)) + F.coalesce(F.max(F.when(~whole, F.col(x) * share)), F.lit(0.0))).alias(x) for x in names]
    total = filled.groupBy("g", "k", "n", "h").agg(*sums)
    total = total.select("g", "k", "n", "h", *[f"q{i}{j}" for i, j in PAIRS], *[F.expr(f"s{i} / h").alias(f"m{i}") for i in range(P)])
    cov = [F.expr(f"(q{i}{j} / h - m{i} * m{j}) * {CONSISTENCY}D" + (f" + {FLOORS[i] * UNIT}D * {FLOORS[i] * UNIT}D" if i == j else "")).alias(f"c{i}{j}") for i, j in PAIRS]
    return cholesky(total.select("g", "k", "n", *MEANS, *cov)).select(*ESTIMATE)


def mcd(points: DataFrame) -> DataFrame:
    """(g, n, m0.., c00.., l00.., ld): the estimate of least determinant of each group of ``points`` (g, y0..)."""
    first = cut_lineage(cholesky(starts(points)))
    state = cut_lineage(concentrate(points, small_side(first)).withColumn("on", F.lit(True)))
    ends = None
    while True:
        going, stopped = state.where("on").drop("on"), state.where("not on").drop("on")
        ends = stopped if ends is None else ends.unionByName(stopped)
        if going.isEmpty():
            break
        both = concentrate(points, small_side(going)).select("g", "k", F.struct(*ESTIMATE).alias("new")).join(going.select("g", "k", F.struct(*ESTIMATE).alias("old")), ["g", "k"])
        better = F.when(F.col("new.ld") < F.col("old.ld"), F.col("new")).otherwise(F.col("old")).alias("e")
        state = cut_lineage(both.select(better, (F.col("new.ld") < F.col("old.ld") - FALL).alias("on")).select("e.*", "on"))
    return ends.groupBy("g").agg(F.min_by(F.struct(*ESTIMATE), F.struct("ld", "k")).alias("e")).select("e.*").drop("k")


def shrunk(estimates: DataFrame, groups: DataFrame) -> DataFrame:
    """(g2, m0.., l00..): each group's estimate averaged with its language's, and that with all rows' estimate.

    ``groups``: the pairs (g1, g2) of a language's and a group's names; all rows are named '*'.
    """
    numbers = [*MEANS, *COVARIANCES]

    def of(level: str) -> list:
        return [F.col("g").alias(level), F.col("n").alias(f"n_{level}"), *[F.col(x).alias(f"{x}_{level}") for x in numbers]]

    def averaged(df: DataFrame, level: str, wider: str, out: str) -> DataFrame:
        return df.select("*", *[F.expr(f"(n_{level} * {x}_{level} + {PRIOR_ROWS} * {x}_{wider}) / (n_{level} + {PRIOR_ROWS})").alias(f"{x}_{out}") for x in numbers])

    everything = F.broadcast(estimates.where("g = '*'").select(*of("g0")).drop("g0"))  # one row
    languages = averaged(estimates.where("g like 'l%'").select(*of("g1")).crossJoin(everything), "g1", "g0", "wide").select("g1", *[f"{x}_wide" for x in numbers])
    sources = estimates.where("g like 's%'").select(*of("g2")).join(groups, "g2").join(languages, "g1")
    final = averaged(sources, "g2", "wide", "out").select("g2", *[F.col(f"{x}_out").alias(x) for x in numbers])
    return cut_lineage(cholesky(final).select("g2", *MEANS, *FACTOR))


def judge(docs: DataFrame, *, text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The input without its text, with STATS, ``base_failed``, ``distance`` (squared; null if the fixed rules fail) and ``kept``.

    Null languages and sources form groups of their own; texts without words fail the
    fixed rules; repeated rows count each; an empty table gives an empty result.
    Input columns of the added names are replaced, all others pass through.
    """
    names = [c for c in docs.columns if c not in (text_col, *STATS, "base_failed", "distance", "kept")]
    first, second = (F.when(col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), col(c).cast("string"))) for c in by)
    language, group = F.concat(F.lit("l"), first), F.concat(F.lit("s"), F.length(first).cast("string"), F.lit(":"), first, second)
    keyed = docs.select(boxed(docs, names), language.alias("g1"), group.alias("g2"), col(text_col).alias("t"))
    stats = cut_lineage(text_statistics(keyed, "t"))
    vector = [F.expr(f"cast(round(({x}) * {UNIT}) as bigint)").alias(y) for x, y in zip(VECTOR, Y, strict=True)]
    passed = cut_lineage(stats.where("not base_failed").select("row", "g1", "g2", *STATS, "base_failed", *vector))
    points = passed.select(F.explode(F.array(F.lit("*"), "g1", "g2")).alias("g"), *Y)
    estimates = cut_lineage(mcd(points))
    parameters = shrunk(estimates, passed.select("g1", "g2").distinct())
    far = passed.join(small_side(parameters), "g2").select("row", *STATS, "base_failed", F.expr(distance()).alias("distance"))
    failed = stats.where("base_failed").select("row", *STATS, "base_failed", F.lit(None).cast("double").alias("distance"))
    both = far.unionByName(failed)
    return both.select(*unboxed(names), *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))
