"""One query for each graph and matrix operator, over graphs that the checker's tables hold, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import partition, stats
from ..operators import build, generate, jaccard, matrix, micro, pagerank, sampling, traverse, triangles, validate
from ..schema import Matrix
from ..sources import edges as edge_files
from ..sources import mtx
from ..streaming.histogram import windowed_histogram
from . import apps
from .derive import DEGREES, HALF_E, INCIDENCE, PAIRS, PART_E, SQUARE, TRIANGLES, VERTICES, incidence, part_graph, part_pairs, part_vertices, square, table, weighted
from .hash_sql import hashed, scrambled, signed, uniform
from .loops import cut, shared_folder

PARTS = 8
PASSES = 10
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with SQL for the same rows where there is any."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return put


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cut(part_graph(spark, d)), part_vertices(spark, d)


def first_id(edges: DataFrame) -> int:
    return edges.agg(F.min(F.least("u", "v")).alias("r")).first()["r"] or 0


# --- transforms --------------------------------------------------------------------------


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m WHERE "col" <= "row"')
def tril(spark, d):
    return matrix.tril(square(spark, d))


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m WHERE "col" > "row"')
def triu(spark, d):
    return matrix.triu(square(spark, d), 1)


@query(f'WITH {SQUARE} SELECT "col" AS "row", "row" AS "col" FROM m')
def transpose(spark, d):
    return matrix.transpose(square(spark, d))


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m UNION SELECT "col", "row" FROM m')
def symmetrize(spark, d):
    return matrix.symmetrize(square(spark, d))


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m WHERE "row" <> "col"')
def drop_loops(spark, d):
    return matrix.drop_loops(square(spark, d))


@query(f"""WITH {SQUARE}, n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS i, n - p_partkey AS p FROM part, n)
SELECT a.p AS "row", b.p AS "col" FROM m JOIN p a ON a.i = m."row" JOIN p b ON b.i = m."col" """)
def permute_matrix(spark, d):
    ids = part_vertices(spark, d)
    p = ids.select(F.col("id").alias("i"), (F.lit(ids.count()) - F.col("id")).alias("p"))
    return matrix.permute(square(spark, d), p, p)


@query(f"WITH {PAIRS} SELECT greatest(u, v) AS u, least(u, v) AS v, min(w) AS w FROM pairs WHERE u <> v GROUP BY ALL")
def simplify_min_weight(spark, d):
    return matrix.simplify_weighted(part_pairs(spark, d))


@query(f"WITH {PAIRS} SELECT greatest(u, v) AS hi, least(u, v) AS lo FROM pairs")
def orient_pair(spark, d):
    return matrix.orient(part_pairs(spark, d))


@query(f"""WITH {HALF_E}, {DEGREES} SELECT id AS "row", degree,
CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d""")
def csr_offsets(spark, d):
    e, _ = graph(spark, d)
    return matrix.csr_offsets(matrix.both_directions(e).select(F.col("src").alias("row"), F.col("dst").alias("col"))).select("row", "degree", "offset")


@query(f'WITH {HALF_E} SELECT src AS "row", dst AS "col" FROM h')
def csr_to_coo(spark, d):
    e, _ = graph(spark, d)
    a = cut(matrix.both_directions(e).select(F.col("src").alias("row"), F.col("dst").alias("col")))
    place = matrix.running_before(a.select(F.struct("row", "col").alias("at"), F.lit(1).alias("one")), "at", "one")
    targets = place.select(F.col("offset").alias("pos"), F.col("at.col").alias("col"))
    return matrix.csr_to_coo(matrix.csr_offsets(a), targets)


@query(f'WITH {HALF_E} SELECT src AS "row", list_aggregate(list_sort(list(dst)), \'string_agg\', \',\') AS cols FROM h GROUP BY src')
def adjacency_sorted(spark, d):
    e, _ = graph(spark, d)
    a = matrix.both_directions(e).select(F.col("src").alias("row"), F.col("dst").alias("col"))
    return matrix.adjacency(a).select("row", F.array_join(F.transform("cols", lambda x: x.cast("string")), ",").alias("cols"))


@query(f'WITH {HALF_E} SELECT dst AS "col" FROM h WHERE src = (SELECT min(u) FROM e)')
def row_slice(spark, d):
    e, _ = graph(spark, d)
    return matrix.row_slice(matrix.both_directions(e).select(F.col("src").alias("row"), F.col("dst").alias("col")), first_id(e))


@query(f"SELECT p_partkey AS id, p_partkey % {PARTS} AS owner, p_partkey // {PARTS} AS local_id, p_partkey AS global_id FROM part")
def owner_local_global(spark, d):
    v = F.col("id")
    own, local = F.pmod(v, F.lit(PARTS)), F.floor(v / PARTS).cast("long")
    return part_vertices(spark, d).select("id", own.alias("owner"), local.alias("local_id"), build.global_id(local, own, PARTS).alias("global_id"))


# --- predicates and set operations -------------------------------------------------------


def both_inputs(**answers: DataFrame) -> DataFrame:
    """One row an input: its name and what a predicate says of it."""
    named = [df.select(F.lit(name).alias("input"), "*") for name, df in answers.items()]
    return named[0].unionByName(named[1])


@query(f'WITH {SQUARE} SELECT count(*) FILTER ("col" > "row") = 0 AS ok FROM m')
def is_lower_triangular(spark, d):
    return matrix.is_lower_triangular(square(spark, d))


@query(f"""WITH {SQUARE} SELECT 'square' AS input, count(*) FILTER ("col" < "row") = 0 AS ok FROM m
UNION ALL SELECT 'upper', count(*) FILTER ("col" < "row") = 0 FROM m WHERE "col" >= "row\"""")
def is_upper_triangular(spark, d):
    a = square(spark, d)
    return both_inputs(square=matrix.is_upper_triangular(a), upper=matrix.is_upper_triangular(matrix.triu(a)))


@query("""SELECT 'same' AS input, count(*) = count(DISTINCT p_partkey) AND min(p_partkey) >= 0 AND max(p_partkey) < count(*) AS ok FROM part
UNION ALL SELECT 'paired', count(*) = count(DISTINCT p_partkey - p_partkey % 2) AND min(p_partkey) >= 0 AND max(p_partkey) < count(*) FROM part""")
def is_perm(spark, d):
    v = part_vertices(spark, d).select(F.col("id").alias("i"), F.col("id").alias("p"))
    return both_inputs(same=matrix.is_permutation(v), paired=matrix.is_permutation(v.withColumn("p", F.col("p") - F.col("p") % 2)))


@query(f"""WITH {SQUARE}, s AS (SELECT "row", "col" FROM m UNION SELECT "col", "row" FROM m)
SELECT 'symmetric' AS input, (SELECT count(*) FROM (SELECT "row", "col" FROM s EXCEPT ALL SELECT "col", "row" FROM s)) = 0 AS equal
UNION ALL SELECT 'square', (SELECT count(*) FROM (SELECT "row", "col" FROM m EXCEPT ALL SELECT "col", "row" FROM m)) = 0""")
def matrix_equal(spark, d):
    a = square(spark, d)
    s = matrix.symmetrize(a)
    return both_inputs(symmetric=matrix.matrices_equal(s, matrix.transpose(s)), square=matrix.matrices_equal(a, matrix.transpose(a)))


@query(f"WITH {HALF_E}, {VERTICES} SELECT id FROM vs WHERE id NOT IN (SELECT src FROM h)")
def isolated_vertices(spark, d):
    e, v = graph(spark, d)
    return matrix.isolated(v, e)


@query(f"WITH {HALF_E} SELECT e.u, e.v, a.dst AS x FROM e JOIN h a ON a.src = e.u JOIN h b ON b.src = e.v AND b.dst = a.dst")
def neighbor_intersection(spark, d):
    e, _ = graph(spark, d)
    t = triangles.triangles(e)
    sides = F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), F.col(z).alias("x")) for x, y, z in ("abc", "acb", "bca")])).alias("s")
    return t.select(sides).select("s.*")


@query(f"""WITH {HALF_E} SELECT src AS v, dst AS u FROM h
WHERE NOT EXISTS (SELECT 1 FROM h a JOIN h b ON a.dst = b.dst WHERE a.src = h.src AND b.src = h.dst)""")
def neighbor_difference(spark, d):
    e, _ = graph(spark, d)
    near = triangles.triangle_edges(triangles.triangles(e))
    return matrix.both_directions(e).select(F.col("src").alias("v"), F.col("dst").alias("u")).join(near, ["v", "u"], "left_anti")


# --- partitioning ------------------------------------------------------------------------

_R, _C, _P = f"(p_partkey // {PARTS})", f"(p_partkey % {PARTS})", PARTS
_FIB, _XOR = f"(CAST(floor(p_partkey * CAST(1.618034 AS DOUBLE)) AS BIGINT) % {_P})", f"(xor(p_partkey, 2654435769) % {_P})"
_SCHEMES = {
    "cyclic": _C,
    "range": f"(p_partkey // (SELECT CAST(ceil((max(p_partkey) + 1) / {_P}.0) AS BIGINT) FROM part))",
    "snake": f"CASE WHEN {_R} % 2 = 1 THEN {_P} - 1 - {_C} ELSE {_C} END",
    "rotation": f"(({_C} + {_R}) % {_P})",
    "snake_rotation": f"CASE WHEN {_R} % 2 = 1 THEN ((({_P} - 1 - {_C} - {_R} // 2) % {_P}) + {_P}) % {_P} ELSE ({_C} + {_R} // 2) % {_P} END",
    "fibonacci": _FIB,
    "xor": _XOR,
    "fib_xor": f"(({_XOR} * {_FIB}) % {_P})",
}
_NAMES = {"fib_xor": "fibonacci_xor"}


def n_ids(spark: SparkSession, d: str) -> int:
    return (part_vertices(spark, d).agg(F.max("id").alias("m")).first()["m"] or 0) + 1


def _scheme(key: str) -> None:
    @query(f"SELECT p_partkey AS id, CAST({_SCHEMES[key]} AS BIGINT) AS owner FROM part", name=f"part_{key}")
    def run(spark, d):
        return part_vertices(spark, d).select("id", partition.owner(_NAMES.get(key, key), "id", PARTS, n_ids(spark, d)).alias("owner"))


for _key in _SCHEMES:
    _scheme(_key)


@query(f"""WITH o AS (SELECT p_partkey AS id, CAST({_SCHEMES["xor"]} AS BIGINT) AS owner FROM part)
SELECT id, owner, row_number() OVER (PARTITION BY owner ORDER BY id) - 1 AS local_id FROM o""")
def local_ids(spark, d):
    return build.local_ids(part_vertices(spark, d).select("id", partition.owner("xor", "id", PARTS, 0).alias("owner")))


@query(f"""WITH {HALF_E}, l AS (SELECT owner, count(src) AS load FROM range({PARTS}) r(owner) LEFT JOIN h ON h.src % {PARTS} = owner GROUP BY owner),
s AS (SELECT min(load) AS lowest, max(load) AS highest, CAST(sum(load) AS BIGINT) AS total, avg(load) AS mean, var_pop(load) AS variance FROM l)
SELECT lowest, highest, total, mean, round(variance, 6) AS variance, round(greatest(highest - mean, mean - lowest), 6) AS max_deviation,
round(greatest(highest - mean, mean - lowest) / mean, 6) AS imbalance FROM s""")
def load_balance_stats(spark, d):
    e, v = graph(spark, d)
    s = build.load_balance(build.build(e, v, n_ids(spark, d), PARTS).edges, PARTS)
    return s.select("lowest", "highest", "total", "mean", *[F.round(c, 6).alias(c) for c in ("variance", "max_deviation", "imbalance")])


@query(f"WITH {HALF_E} SELECT src, dst, src % {PARTS} AS owner FROM h")
def build_graph(spark, d):
    e, v = graph(spark, d)
    return build.build(e, v, n_ids(spark, d), PARTS).edges


# --- micro-kernels and aggregates --------------------------------------------------------


@query("""SELECT b.i AS idx, count(l_partkey) AS "count" FROM range((SELECT max(p_partkey) + 1 FROM part)) b(i) LEFT JOIN lineitem ON l_partkey = i GROUP BY i""")
def histogram(spark, d):
    return micro.histogram(table(spark, d, "lineitem").select(F.col("l_partkey").alias("idx")), n_ids(spark, d))


@query("""SELECT 'right' AS input, CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'one_more', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey % 7 = 0""")
def histogram_check(spark, d):
    idx = table(spark, d, "lineitem").select(F.col("l_partkey").alias("idx"))
    right = micro.histogram(idx)
    wrong = right.withColumn("count", F.when(F.col("idx") % 7 == 0, F.col("count") + 1).otherwise(F.col("count")))
    bad = lambda counts: micro.histogram_check(idx, counts).agg(F.count("*").alias("bad"))
    return both_inputs(right=bad(right), one_more=bad(wrong))


@query("SELECT l_orderkey * 8 + l_linenumber AS i, -(l_partkey + 1) AS val FROM lineitem JOIN part ON p_partkey = l_partkey")
def index_gather(spark, d):
    requests = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), F.col("l_partkey").alias("idx"))
    return micro.index_gather(requests, part_vertices(spark, d).select(F.col("id").alias("idx"), (-(F.col("id") + 1)).alias("val")))


@query("""SELECT min(l_linenumber) AS "min", max(l_linenumber) AS "max", round(avg(l_linenumber), 9) AS mean FROM lineitem""")
def min_avg_max(spark, d):
    return micro.latency_profile(table(spark, d, "lineitem"), "l_linenumber").select("min", "max", F.round("mean", 9).alias("mean"))


@query(f"WITH {HALF_E} SELECT src AS id, count(*) AS degree FROM h GROUP BY src")
def degree(spark, d):
    return build.degrees(graph(spark, d)[0])


@query(f'WITH {SQUARE}, l AS (SELECT * FROM m WHERE "col" < "row") SELECT id, count(*) AS degree FROM (SELECT "row" AS id FROM l UNION ALL SELECT "col" FROM l) GROUP BY id')
def degree_from_lower(spark, d):
    lower = matrix.tril(square(spark, d), -1)
    return build.degrees(lower.select(F.col("row").alias("u"), F.col("col").alias("v")))


@query(f'WITH {SQUARE} SELECT "col" AS idx, count(*) AS "count" FROM m GROUP BY "col"')
def column_counts(spark, d):
    return micro.histogram(square(spark, d), col="col")


@query(f"""WITH {PART_E}, r2 AS (SELECT v AS id, count(*) AS r FROM e GROUP BY v), c2 AS (SELECT u AS id, count(*) AS c FROM e GROUP BY u)
SELECT CAST(coalesce(sum(r * (r - 1) // 2), 0) AS BIGINT) AS pushes, CAST(coalesce(sum(r * c), 0) AS BIGINT) AS pulls FROM r2 FULL JOIN c2 USING (id)""")
def push_pull_estimate(spark, d):
    e, _ = graph(spark, d)
    return build.push_pull_estimate(e.select(F.col("v").alias("row"), F.col("u").alias("col")))


@query(f"""WITH {HALF_E}, {VERTICES}, {DEGREES}, g AS (SELECT coalesce(degree, 0) AS degree FROM vs LEFT JOIN d USING (id))
SELECT count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS half_edges, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated FROM g""")
def graph_stats(spark, d):
    return build.graph_stats(*graph(spark, d))


@query(f"""WITH {HALF_E}, c AS (SELECT src % {PARTS} AS owner, count(*) AS load FROM h GROUP BY 1),
s AS (SELECT max(coalesce(load, 0)) AS highest, min(coalesce(load, 0)) AS lowest, (coalesce(sum(load), 0) // {PARTS})::BIGINT AS average FROM range({PARTS}) t(owner) LEFT JOIN c USING (owner))
SELECT highest, lowest, average, highest - lowest AS delta, round(coalesce((highest - lowest) * 100.0::DOUBLE / nullif(average, 0), 0), 6) AS percent FROM s""")
def part_stats(spark, d):
    e, v = graph(spark, d)
    return build.part_stats(build.build(e, v, n_ids(spark, d), PARTS).edges, PARTS).withColumn("percent", F.round("percent", 6))


@query("""WITH s AS (SELECT list_sort(list(o_totalprice)) AS x, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS stddev FROM orders)
SELECT n, round(mean, 4) AS mean, round(stddev, 4) AS stddev, x[1] AS "min", round((x[(n - 1) // 4 + 1] + x[n // 4 + 1]) / 2, 4) AS firstquartile,
round((x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2, 4) AS median, round((x[n - 1 - (n - 1) // 4 + 1] + x[n - 1 - n // 4 + 1]) / 2, 4) AS thirdquartile, x[n] AS "max" FROM s""")
def seven_number_summary(spark, d):
    s = stats.seven_numbers(table(spark, d, "orders"), "o_totalprice")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "stddev")], "min", *[F.round(c, 4).alias(c) for c in ("firstquartile", "median", "thirdquartile")], "max")


@query("""WITH t AS (SELECT l_quantity / l_extendedprice AS t FROM lineitem), s AS (SELECT count(*) AS n, avg(t) AS m, stddev_samp(t) AS sd FROM t)
SELECT round(1 / m, 6) AS harmonic_mean, round(sd / (m * m * sqrt(n - 1)), 6) AS harmonic_stddev FROM s""")
def harmonic_teps(spark, d):
    s = stats.harmonic_teps(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


# --- kernels -----------------------------------------------------------------------------


def _pagerank_sql(passes: int) -> str:
    steps = [f"p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM vs) AS pr FROM vs)"]  # noqa: F541
    for i in range(passes):
        gain = f"SELECT h.dst AS id, sum(p.pr / d.degree) AS g FROM h JOIN p{i} p ON p.id = h.src JOIN d ON d.id = h.src GROUP BY h.dst"
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT vs.id, (1 - 0.85::DOUBLE) / (SELECT count(*) FROM vs) + 0.85::DOUBLE * coalesce(g, 0) AS pr FROM vs LEFT JOIN ({gain}) USING (id))")
    return f"WITH {HALF_E}, {VERTICES}, {DEGREES}, " + ", ".join(steps)


@query(_pagerank_sql(PASSES) + f" SELECT id, round(pr, 9) AS pagerank FROM p{PASSES}")
def pagerank_k(spark, d):
    return pagerank.pagerank(*graph(spark, d), tol=None, max_iter=PASSES).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(_pagerank_sql(PASSES) + f" SELECT id, round(pr, 9) AS pagerank FROM p{PASSES}")
def pagerank_lower_k(spark, d):
    e, v = graph(spark, d)
    lower = matrix.tril(matrix.symmetrize(e.select(F.col("u").alias("row"), F.col("v").alias("col"))), -1)
    return pagerank.pagerank(lower.select(F.col("row").alias("u"), F.col("col").alias("v")), v, tol=None, max_iter=PASSES).select("id", F.round("pagerank", 9).alias("pagerank"))


@query(_pagerank_sql(PASSES) + f" SELECT round(sum(pr), 6) AS total, abs(sum(pr) - 1) < 1e-3 AS correct FROM p{PASSES}")
def pagerank_selfcheck(spark, d):
    s = pagerank.self_check(pagerank.pagerank(*graph(spark, d), tol=None, max_iter=PASSES))
    return s.select(F.round("total", 6).alias("total"), "correct")


@query(f"""WITH {HALF_E}, {DEGREES}, c AS (SELECT e.u, e.v, count(*) AS common FROM e JOIN h a ON a.src = e.u JOIN h b ON b.src = e.v AND b.dst = a.dst GROUP BY e.u, e.v)
SELECT e.v, e.u, coalesce(common, 0) AS common, round(coalesce(coalesce(common, 0) / CAST(x.degree + y.degree - coalesce(common, 0) AS DOUBLE), 0), 9) AS jaccard
FROM e LEFT JOIN c USING (u, v) JOIN d x ON x.id = e.u JOIN d y ON y.id = e.v""")
def jaccard_edges(spark, d):
    return jaccard.jaccard_edges(graph(spark, d)[0]).withColumn("jaccard", F.round("jaccard", 9))


@query(f"""WITH {INCIDENCE}, s AS (SELECT "col", count(*) AS n FROM x GROUP BY "col"),
c AS (SELECT a."col" AS i, b."col" AS j, count(*) AS common FROM x a JOIN x b ON a."row" = b."row" AND a."col" > b."col" GROUP BY 1, 2)
SELECT i, j, common, round(common / CAST(a.n + b.n - common AS DOUBLE), 9) AS jaccard FROM c JOIN s a ON a."col" = i JOIN s b ON b."col" = j""")
def jaccard_kmer(spark, d):
    return jaccard.jaccard_columns(incidence(spark, d)).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {PART_E}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def triangle_count(spark, d):
    return triangles.count_triangles(graph(spark, d)[0])


@query(f"WITH {PART_E}, {TRIANGLES} SELECT count(*) AS triangles FROM t")
def triangle_count_u(spark, d):
    return triangles.count_triangles(graph(spark, d)[0], alg=1)


@query(f"WITH {PART_E}, {TRIANGLES} SELECT id, triangles FROM tv")
def vertex_triangles(spark, d):
    return triangles.vertex_triangles(triangles.triangles(graph(spark, d)[0]))


@query(f"""WITH {HALF_E}, {VERTICES}, {TRIANGLES}, total AS (SELECT count(*) AS n FROM t),
near AS (SELECT DISTINCT v, u FROM (SELECT unnest([a, a, b, b, c, c]) AS v, unnest([b, c, a, c, a, b]) AS u FROM t)),
g AS (SELECT h.src AS id, sum(tv.triangles) FILTER (near.u IS NOT NULL) AS near, sum(tv.triangles) FILTER (near.u IS NULL) AS far
  FROM h JOIN tv ON tv.id = h.dst LEFT JOIN near ON near.v = h.src AND near.u = h.dst GROUP BY h.src)
SELECT vs.id, round(CASE WHEN n > 0 THEN (coalesce(triangles, 0) / 3.0::DOUBLE + coalesce(near, 0) / 3.0::DOUBLE + coalesce(far, 0)) / n ELSE 0 END, 9) AS centrality
FROM vs LEFT JOIN tv USING (id) LEFT JOIN g USING (id), total""")
def triangle_centrality(spark, d):
    return triangles.triangle_centrality(*graph(spark, d)).withColumn("centrality", F.round("centrality", 9))


_BFS = f"""WITH RECURSIVE {HALF_E}, {VERTICES}, b(id, depth) AS (
  SELECT min(u), 0 FROM e UNION SELECT h.dst, b.depth + 1 FROM b JOIN h ON h.src = b.id WHERE b.depth < 24),
dist AS MATERIALIZED (SELECT id, min(depth) AS depth FROM b GROUP BY id)"""
_DEPTH = _BFS + " SELECT id, coalesce(depth, -1) AS depth FROM vs LEFT JOIN dist USING (id)"


def _bfs(spark, d, direction):
    e, v = graph(spark, d)
    return traverse.bfs(e, v, first_id(e), direction)


@query(_DEPTH)
def bfs_depth(spark, d):
    return _bfs(spark, d, "top_down").select("id", "depth")


@query(_DEPTH)
def bfs_bottom_up_depth(spark, d):
    return _bfs(spark, d, "bottom_up").select("id", "depth")


@query(_BFS + """, p AS (SELECT h.dst AS id, min(h.src) AS parent FROM h JOIN dist a ON a.id = h.src JOIN dist b ON b.id = h.dst AND b.depth = a.depth + 1 GROUP BY h.dst)
SELECT vs.id, CASE WHEN depth = 0 THEN vs.id ELSE coalesce(parent, -1) END AS parent FROM vs LEFT JOIN dist USING (id) LEFT JOIN p USING (id)""")
def bfs_parent_min(spark, d):
    return _bfs(spark, d, "top_down").select("id", "parent")


@query(_BFS + " SELECT count(*) AS edges FROM h JOIN dist ON dist.id = h.src WHERE h.dst <= h.src")
def teps_edge_count(spark, d):
    e, v = graph(spark, d)
    return traverse.traversed_edges(e, traverse.bfs(e, v, first_id(e)))


@query(_BFS + " SELECT count(*) AS edges FROM h JOIN dist ON dist.id = h.src WHERE h.dst < h.src")
def teps_edge_count_strict(spark, d):
    e, v = graph(spark, d)
    return traverse.traversed_edges(e, traverse.bfs(e, v, first_id(e)), strict=True)


def _sssp_steps(rounds: int) -> str:
    w = "1 + (least(src, dst) * 31 + greatest(src, dst) * 17) % 100"
    steps = [f"hw AS MATERIALIZED (SELECT src, dst, {w} AS w FROM h)", "s0 AS MATERIALIZED (SELECT min(u) AS id, CAST(0 AS BIGINT) AS x FROM e)"]
    for i in range(rounds):
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT id, x FROM s{i} UNION ALL SELECT dst, x + w FROM s{i} JOIN hw ON src = id) GROUP BY id)")
    return f"WITH {HALF_E}, {VERTICES}, " + ", ".join(steps)


@query(_sssp_steps(40) + " SELECT vs.id, round(coalesce(x / 100.0::DOUBLE, -1), 6) AS dist FROM vs LEFT JOIN s40 USING (id)")
def sssp_dist(spark, d):
    e, v = graph(spark, d)
    return traverse.sssp(cut(weighted(e)), v, first_id(e), delta=0.5).select("id", F.round("dist", 6).alias("dist"))


def _checks_sql(reached: str, far: str) -> str:
    """No violation of a right result, and those of one whose depths are doubled and whose root claims not to be reached."""
    names = "unnest(['parent_range', 'reached_both_ways', 'root', 'edge_leaves_component', 'edge_spans_levels', 'tree_edge']) AS \"check\""
    at_root = "SELECT count(*) FROM e, root WHERE r IN (u, v)"
    spans = f"SELECT count(*) FROM e JOIN {reached} a ON a.id = u JOIN {reached} b ON b.id = v, root WHERE r NOT IN (u, v) AND {far}"
    return f""", root AS (SELECT min(u) AS r FROM e)
SELECT 'right' AS input, {names}, 0::BIGINT AS violations
UNION ALL SELECT 'doubled', {names}, unnest([0, 1, 1, ({at_root}), ({spans}), (SELECT count(*) - 1 FROM {reached})])"""


def _judged(e: DataFrame, found: DataFrame, root: int, depth: str) -> DataFrame:
    wrong = found.withColumn(depth, F.when(F.col(depth) > 0, F.col(depth) * 2).otherwise(F.col(depth))).withColumn("parent", F.when(F.col("id") == root, -1).otherwise(F.col("parent")))
    return both_inputs(**{name: validate.validate(e, r, root, depth == "dist") for name, r in (("right", found), ("doubled", wrong))})


@query(_BFS + _checks_sql("dist", "a.depth <> b.depth"))
def validate_bfs(spark, d):
    e, v = graph(spark, d)
    root = first_id(e)
    return _judged(e, cut(traverse.bfs(e, v, root)), root, "depth")


@query(_sssp_steps(40) + _checks_sql("s40", "2 * abs(a.x - b.x) > 1 + (u * 31 + v * 17) % 100"))
def validate_sssp(spark, d):
    e, v = graph(spark, d)
    e, root = cut(weighted(e)), first_id(e)
    return _judged(e, cut(traverse.sssp(e, v, root)), root, "dist")


@query()
def bfs_many_roots(spark, d):
    e, v = graph(spark, d)
    roots = [r["id"] for r in generate.search_roots(e, 0, k=4).collect()]
    return traverse.run_many(e, v, roots)


@query()
def bfs_report(spark, d):
    runs = cut(bfs_many_roots(spark, d))
    return stats.seven_numbers(runs, "seconds").join(F.broadcast(stats.harmonic_teps(runs)))


def _converged_sql(passes: int = 60) -> str:
    changes = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.pr - b.pr)) AS e FROM p{i} a JOIN p{i + 1} b USING (id)" for i in range(passes))
    ranks = " UNION ALL ".join(f"SELECT {i} AS i, id, pr FROM p{i}" for i in range(passes))
    return f"{_pagerank_sql(passes)}, last AS (SELECT min(i) AS i FROM ({changes}) WHERE e < 1e-5) SELECT id, round(pr, 9) AS pagerank FROM ({ranks}) JOIN last USING (i)"


@query(_converged_sql())
def pagerank_converged(spark, d):
    return pagerank.pagerank(*graph(spark, d)).select("id", F.round("pagerank", 9).alias("pagerank"))


# --- generators --------------------------------------------------------------------------


@query('SELECT 0::BIGINT AS "row", i AS "col" FROM range(1, 8) r(i) UNION ALL SELECT i, 0::BIGINT FROM range(1, 8) r(i) UNION ALL SELECT 0, 0')
def star(spark, d):
    return matrix.star(spark, 7, 1)


_STARS = [3, 4, 5]


def _star_sql(m: int, mode: int) -> str:
    loop = {0: "", 1: " UNION ALL SELECT 0, 0", 2: f" UNION ALL SELECT {m}, {m}"}[mode]
    return f"(SELECT 0::BIGINT AS r, i AS c FROM range(1, {m + 1}) t(i) UNION ALL SELECT i, 0::BIGINT FROM range(1, {m + 1}) t(i){loop})"


def _kron_sql(sizes: list[int], mode: int) -> str:
    acc = _star_sql(sizes[0], mode)
    for m in sizes[1:]:
        acc = f"(SELECT x.r * {m + 1} + y.r AS r, x.c * {m + 1} + y.c AS c FROM {acc} x, {_star_sql(m, mode)} y)"
    return f'SELECT r AS "row", c AS "col" FROM {acc} z WHERE c < r'


@query(_kron_sql(_STARS, 1))
def kron_stars(spark, d):
    return matrix.kron_of_stars(spark, _STARS, 1)[0]


_TRI = "WITH k{0} AS ({1}) SELECT {0} AS mode, count(*) AS triangles FROM k{0} a JOIN k{0} b ON b.\"row\" = a.\"row\" AND b.\"col\" < a.\"col\" JOIN k{0} c ON c.\"row\" = a.\"col\" AND c.\"col\" = b.\"col\""


@query(" UNION ALL ".join(f"SELECT * FROM ({_TRI.format(m, _kron_sql(_STARS, m))})" for m in (0, 1, 2)))
def kron_triangles_closed_form(spark, d):
    return spark.createDataFrame([(m, matrix.kron_triangles(_STARS, m)) for m in (0, 1, 2)], "mode int, triangles long")


def _scale(spark: SparkSession, d: str) -> int:
    return max(6, (n_ids(spark, d) - 1).bit_length() - 3)


_IDS = "n AS (SELECT coalesce(max(p_partkey), 0) + 1 AS n FROM part), s AS (SELECT greatest(6, length(bin(n - 1)) - 3) AS scale FROM n), ids AS (SELECT unnest(range(16 * (1::BIGINT << scale))) AS id FROM s)"


def _below(n: str, *longs: str, ints: tuple) -> str:
    return f"floor({uniform(*longs, ints=ints)} * {n})::BIGINT"


@query(f"WITH {_IDS}, ab AS MATERIALIZED (SELECT {_below('(1::BIGINT << scale)', 'id', ints=(0, 20011))} AS a, {_below('(1::BIGINT << scale)', 'id', ints=(1, 20011))} AS b FROM ids, s) SELECT least(a, b) AS u, greatest(a, b) AS v FROM ab")
def gen_uniform(spark, d):
    return generate.generate(spark, "uniform", _scale(spark, d)).edges


def _quadrants_sql() -> str:
    a, b, c = generate.QUADRANTS
    draws = f"x AS MATERIALIZED (SELECT id, bit, {uniform('id', ints=('bit', 12345))} AS x FROM ids, (SELECT unnest(range(scale)) AS bit FROM s))"
    return f"{_IDS}, {draws}, q AS MATERIALIZED (SELECT id, bit, x >= {a + b}::DOUBLE AS down, x >= {a}::DOUBLE AND x < {a + b}::DOUBLE OR x > {a + b + c}::DOUBLE AS rest FROM x)"


@query(f"WITH {_quadrants_sql()} SELECT sum(down::BIGINT << (scale - 1 - bit))::BIGINT AS u, sum(rest::BIGINT << (scale - 1 - bit))::BIGINT AS v FROM q, s GROUP BY id")
def gen_rmat(spark, d):
    return generate.generate(spark, "rmat", _scale(spark, d)).edges


@query(f"""WITH RECURSIVE {_quadrants_sql()},
w(id, bit, u, v) AS (SELECT id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM ids UNION ALL
  SELECT id, bit + 1, u * 2 + (down AND (rest OR u <> v))::BIGINT, v * 2 + (rest OR down AND u = v)::BIGINT FROM w JOIN q USING (id, bit)),
raw AS (SELECT id, 'u' AS side, u AS x FROM w JOIN s ON bit = scale UNION ALL SELECT id, 'v', v FROM w JOIN s ON bit = scale),
{scrambled("raw", "s", 12345)} SELECT a.x AS u, b.x AS v FROM z a JOIN z b ON b.id = a.id WHERE a.side = 'u' AND b.side = 'v'""")
def gen_kronecker(spark, d):
    return generate.generate(spark, "kronecker", _scale(spark, d)).edges


@query()
def gen_erdos_renyi(spark, d):
    n = n_ids(spark, d)
    return generate.erdos_renyi(spark, n, generate.probability(n, 35), "symmetric")


@query()
def gen_erdos_renyi_modes(spark, d):
    n = n_ids(spark, d)
    one = lambda mode: generate.erdos_renyi(spark, n, generate.probability(n, 8), mode, unit_diagonal=True).select(F.lit(mode).alias("mode"), "row", "col")
    return one("lower").union(one("upper")).union(one("asymmetric"))


@query(f"""WITH r AS (SELECT unnest(range(1, 300)) AS r), p AS (SELECT r, unnest(range(r)) AS c FROM r)
SELECT r AS "row", c AS "col" FROM p WHERE {uniform("r", "c", ints=(12345,))} < 0.1::DOUBLE""")
def gen_erdos_renyi_naive(spark, d):
    return generate.erdos_renyi_naive(spark, 300, 0.1)


@query(f"""WITH {PART_E} SELECT u, v, {_below("255", "v", "u", ints=(7,))} + 1 AS whole, {uniform("v", "u", ints=(7,))} AS share FROM e""")
def gen_weights(spark, d):
    e = part_graph(spark, d)
    return generate.with_weights(generate.with_weights(e, largest=255).withColumnRenamed("w", "whole")).withColumnRenamed("w", "share")


@query(f"""WITH {PAIRS}, n AS (SELECT u, v, row_number() OVER (PARTITION BY u, v) AS nth FROM pairs),
k AS MATERIALIZED (SELECT u, v, nth, {signed(hashed("u", "v", "nth", ints=(3,)))} AS k FROM n)
SELECT row_number() OVER (ORDER BY k, u, v, nth) - 1 AS pos, u, v FROM k""")
def gen_edge_shuffle(spark, d):
    return generate.shuffle_edges(part_pairs(spark, d).select("u", "v"))


@query(f"""WITH {_IDS}, r AS (SELECT unnest(range(1::BIGINT << scale)) AS r FROM s), c AS (SELECT unnest(range(64)) AS c)
SELECT r AS "row", c AS "col" FROM r, c WHERE {uniform("r", "c", ints=(12345,))} < 0.02::DOUBLE
UNION SELECT r, {_below("64", "r", ints=(12346,))} FROM r UNION SELECT {_below("(1::BIGINT << scale)", "c", ints=(12347,))}, c FROM c, s""")
def gen_kmer(spark, d):
    return generate.kmer_matrix(spark, 1 << _scale(spark, d), 64, 0.02)


@query(f"WITH {HALF_E}, v AS (SELECT DISTINCT src AS id FROM h) SELECT id FROM v ORDER BY {signed(hashed('id', ints=(2,)))}, id LIMIT 64")
def bfs_roots(spark, d):
    return generate.search_roots(part_graph(spark, d), 0)


@query(f"WITH {_IDS}, k AS (SELECT i, {signed(hashed('i', ints=(12345,)))} AS k FROM (SELECT unnest(range(n)) AS i FROM n)) SELECT i, row_number() OVER (ORDER BY k, i) - 1 AS p FROM k")
def rand_perm(spark, d):
    return generate.random_permutation(spark, n_ids(spark, d))


# --- sampling ----------------------------------------------------------------------------


@query(f"""WITH {SQUARE}, n AS (SELECT "row" AS k, count(*) AS n FROM m GROUP BY 1),
s AS MATERIALIZED (SELECT k, (sum(n) OVER (ORDER BY k) - n) / (SELECT sum(n) FROM n)::DOUBLE AS lo, sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM n)::DOUBLE AS hi FROM n),
q AS (SELECT c_custkey AS draw, ((c_custkey * 7919) % 10007 + 0.5) / 10007.0::DOUBLE AS r FROM customer)
SELECT draw, k FROM q JOIN s ON lo < r AND r <= hi""")
def cdf_lookup(spark, d):
    shares = sampling.cumulative(micro.histogram(square(spark, d), col="row").select(F.col("idx").alias("k"), F.col("count").alias("n")), "k", "n")
    draws = table(spark, d, "customer").select(F.col("c_custkey").alias("draw"), (((F.col("c_custkey") * 7919) % 10007 + 0.5) / 10007.0).alias("r"))
    return sampling.cdf_lookup(draws, shares, "k").select("draw", "k")


def _sampled_sql(by: str, other: str, draws: int) -> str:
    return f"""WITH {SQUARE}, n AS (SELECT "{by}" AS k, count(*) AS n FROM m GROUP BY 1),
s AS MATERIALIZED (SELECT k, (sum(n) OVER (ORDER BY k) - n) / (SELECT sum(n) FROM n)::DOUBLE AS lo, sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM n)::DOUBLE AS hi FROM n),
q AS MATERIALIZED (SELECT id, {uniform("id", ints=(12345,))} AS r FROM range({draws}) t(id)),
p AS (SELECT k, row_number() OVER (ORDER BY k, id) - 1 AS i FROM q JOIN s ON lo < r AND r <= hi OR r = 0 AND lo = 0)
SELECT i AS "{by}", "{other}" FROM p JOIN m ON m."{by}" = k"""


@query(_sampled_sql("row", "col", 500))
def sample_rows(spark, d):
    return sampling.sample_rows(square(spark, d), 500)


@query(_sampled_sql("col", "row", 50))
def sample_columns(spark, d):
    return sampling.sample_columns(square(spark, d), 50)


@query(f"""WITH {SQUARE} SELECT "row", "col" FROM m WHERE {uniform('"row"', '"col"', ints=(12345,))} < 0.25::DOUBLE""")
def uniform_sample(spark, d):
    return sampling.uniform_sample(square(spark, d), 0.25)


@query(f"""WITH {PART_E}, k AS MATERIALIZED (SELECT u, v FROM e WHERE {uniform("u", "v", ints=(12345,))} < 0.5::DOUBLE)
SELECT count(*) / 0.125::DOUBLE AS triangles FROM k x JOIN k y ON y.u = x.v JOIN k z ON z.u = x.u AND z.v = y.v""")
def approximate_triangles(spark, d):
    return sampling.approximate_triangles(part_graph(spark, d), 0.5)


# --- mini-apps ---------------------------------------------------------------------------


@query()
def app_triangles(spark, d):
    return apps.triangle_app(spark, kron="1 3 4 5", sample=0.7)


@query()
def app_triangles_random(spark, d):
    return apps.triangle_app(spark)


_STAR_PRODUCT = f'p AS (SELECT * FROM ({_kron_sql([3, 4, 5], 1)})), e AS MATERIALIZED (SELECT "col" AS u, "row" AS v FROM p)'


@query(SQL["triangle_centrality"].replace(PART_E, _STAR_PRODUCT).replace(VERTICES, "vs AS MATERIALIZED (SELECT unnest(range(120)) AS id)"))
def app_centrality(spark, d):
    return apps.centrality_app(spark, kron="1 3 4 5").withColumn("centrality", F.round("centrality", 9))


@query(SQL["jaccard_edges"].replace(PART_E, _STAR_PRODUCT))
def app_jaccard(spark, d):
    return apps.jaccard_app(spark, kron="1 3 4 5").withColumn("jaccard", F.round("jaccard", 9))


@query()
def app_pagerank(spark, d):
    return apps.pagerank_app(spark, rows=1000, nz_per_row=20)


@query()
def app_histogram(spark, d):
    return apps.histogram_app(spark)


@query()
def app_index_gather(spark, d):
    return apps.index_gather_app(spark)


@query()
def app_bfs_benchmark(spark, d):
    return apps.traversal_benchmark(spark, 8, n_roots=2)


@query()
def app_sssp_benchmark(spark, d):
    return apps.traversal_benchmark(spark, 7, kernel="sssp", n_roots=2, delta=0.1)


# --- files and streams -------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m')
def mtx_roundtrip(spark, d):
    a, path = cut(square(spark, d)), _folder(spark)
    shape = a.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    mtx.write_mtx(Matrix(a, (shape["r"] or 0) + 1, (shape["c"] or 0) + 1), path)
    return mtx.read_mtx(spark, path).entries


@query(f'WITH {SQUARE} SELECT "row", "col" FROM m')
def dataset_roundtrip(spark, d):
    a, path = cut(square(spark, d)), _folder(spark)
    shape = a.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    mtx.write_dataset(Matrix(a, (shape["r"] or 0) + 1, (shape["c"] or 0) + 1), path)
    return mtx.read_dataset(spark, path).entries


@query(f'WITH {SQUARE} SELECT max("row") + 1 AS numrows, max("col") + 1 AS numcols, count(*) AS nnz FROM m')
def metadata_roundtrip(spark, d):
    a, path = cut(square(spark, d)), _folder(spark)
    shape = a.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    mtx.write_metadata(Matrix(a, (shape["r"] or 0) + 1, (shape["c"] or 0) + 1), path)
    m = mtx.read_metadata(spark, path)
    return spark.createDataFrame([(m["numrows"], m["numcols"], m["nnz"])], "numrows long, numcols long, nnz long")


@query(f"WITH {PART_E} SELECT v + 1 AS hi, u + 1 AS lo FROM e")
def edge_dump_to_coo(spark, d):
    e, _ = graph(spark, d)
    a = cut(e.select(F.col("u").alias("row"), F.col("v").alias("col")))
    place = matrix.running_before(a.select(F.struct("row", "col").alias("at"), F.lit(1).alias("one")), "at", "one")
    dump = place.select(F.col("offset").alias("pos"), F.concat(F.lit("edge: "), F.col("at.col").cast("string")).alias("value"))
    offsets = matrix.csr_offsets(a).select("row", "offset", (F.col("offset") + F.col("degree")).alias("next_offset"))
    return edge_files.edge_dump_to_coo(edge_files.numbers(dump, "col"), offsets)


@query(f'WITH {INCIDENCE} SELECT "row", "col" FROM x')
def kmer_files_roundtrip(spark, d):
    path = _folder(spark)
    edge_files.write_kmer_samples(incidence(spark, d).repartition("col"), path)
    return edge_files.read_kmer_samples(spark, path)


@query(f"WITH {PAIRS} SELECT u, v, w FROM pairs")
def edge_file_roundtrip(spark, d):
    path = _folder(spark)
    edge_files.write_edges(part_pairs(spark, d), path)
    edge_files.write_edges(part_pairs(spark, d), path, reuse=True)
    return edge_files.read_edges(spark, path)


@query("""SELECT date_trunc('day', ts) AS "start", event_type AS "key", count(*) AS "count" FROM events GROUP BY 1, 2""")
def windowed_event_histogram(spark, d):
    return windowed_histogram(table(spark, d, "events"))
