import pytest
from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.operators import build, generate, jaccard, matrix, micro, pagerank, sampling, traverse, triangles, validate

from .graphs import BRIDGE, KMERS, MESSY, PATH, TWO_CLIQUES, edges, entries


def test_triangle_centrality_golden(spark):
    got = {r["id"]: r["centrality"] for r in triangles.triangle_centrality(edges(spark, BRIDGE), spark.range(7)).collect()}
    want = [0.555556, 0.666667, 0.555556, 1.0, 1.0, 0.333333, 0.333333]
    assert [got[i] for i in range(7)] == pytest.approx(want, abs=1e-6)


def test_triangle_centrality_without_triangles(spark):
    rows = triangles.triangle_centrality(edges(spark, PATH), spark.range(7)).collect()
    assert len(rows) == 7 and all(r["centrality"] == 0 for r in rows)


@pytest.mark.parametrize(("pairs", "count"), [(BRIDGE, 3), (TWO_CLIQUES, 8), (PATH, 0), (MESSY, 1)])
def test_triangle_counts_agree(spark, pairs, count):
    e = edges(spark, pairs)
    assert triangles.count_triangles(e).first()[0] == triangles.count_triangles(e, alg=1).first()[0] == count
    assert (triangles.vertex_triangles(triangles.triangles(e)).agg(F.sum("triangles")).first()[0] or 0) == 3 * count


def test_jaccard_edges_golden(spark):
    got = {(r["v"] + 1, r["u"] + 1): r["jaccard"] for r in jaccard.jaccard_edges(edges(spark, TWO_CLIQUES)).collect()}
    want = {(2, 1): 0.5, (3, 1): 0.4, (4, 1): 0.5, (3, 2): 0.4, (4, 2): 0.5, (4, 3): 0.4, (5, 3): 0, (6, 5): 0.4, (7, 5): 0.4, (8, 5): 0.4, (7, 6): 0.5, (8, 6): 0.5, (8, 7): 0.5}
    assert got == pytest.approx(want)


def test_jaccard_columns_golden(spark):
    got = {(r["i"], r["j"]): r["jaccard"] for r in jaccard.jaccard_columns(entries(spark, KMERS), 5).collect()}
    assert len(got) == 10
    assert {k: v for k, v in got.items() if v} == pytest.approx({(2, 1): 2 / 3, (4, 1): 2 / 3, (4, 2): 1.0})


def test_pagerank_returns_the_ranks_before_the_last_change(spark):
    got = {r["id"]: r["pagerank"] for r in pagerank.pagerank(edges(spark, PATH), spark.range(6)).collect()}
    want = [0.1097447, 0.19939591, 0.19085939, 0.19085939, 0.19939591, 0.1097447]
    assert [got[i] for i in range(6)] == pytest.approx(want, abs=5e-8)
    fixed = {r["id"]: r["pagerank"] for r in pagerank.pagerank(edges(spark, PATH), spark.range(6), tol=None, max_iter=28).collect()}
    assert fixed == pytest.approx(got)


def test_pagerank_of_isolated_vertices(spark):
    ranks = pagerank.pagerank(edges(spark, PATH), spark.range(10))
    got = {r["id"]: r["pagerank"] for r in ranks.collect()}
    assert got[9] == pytest.approx(0.15 / 10)
    assert not pagerank.self_check(ranks).first()["correct"]


@pytest.mark.parametrize("direction", ["top_down", "bottom_up"])
def test_bfs_on_a_path(spark, direction):
    e = edges(spark, PATH)
    r = traverse.bfs(e, spark.range(8), 0, direction)
    got = {x["id"]: (x["parent"], x["depth"]) for x in r.collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (2, 3), 4: (3, 4), 5: (4, 5), 6: (-1, -1), 7: (-1, -1)}
    assert traverse.traversed_edges(e, r).first()[0] == 5


@pytest.mark.parametrize("delta", [None, 0.1])
def test_sssp_and_its_validator(spark, delta):
    g = generate.rmat_edges(spark, 6, 8)
    e = matrix.simplify_weighted(generate.with_weights(g.edges))
    root = e.agg(F.min("v")).first()[0]
    r = traverse.sssp(e, g.vertices, root, delta)
    assert {x["violations"] for x in validate.validate(e, r, root, weighted=True).collect()} == {0}
    broken = r.withColumn("dist", F.when(F.col("dist") > 0, F.col("dist") + 5).otherwise(F.col("dist")))
    assert any(x["violations"] for x in validate.validate(e, broken, root, weighted=True).collect())


def test_bfs_on_rmat_is_valid_either_way(spark):
    g = generate.rmat_edges(spark, 7)
    e = g.edges.distinct().persist()
    root = generate.search_roots(e, 128, 1).first()["id"]
    down, up = traverse.bfs(e, g.vertices, root), traverse.bfs(e, g.vertices, root, "bottom_up")
    assert sorted(down.collect()) == sorted(up.collect())
    claimed = traverse.traversed_edges(e, down).first()["edges"]
    assert {x["violations"] for x in validate.validate(e, down, root, claimed_edges=claimed).collect()} == {0}
    wrong = down.withColumn("depth", F.when(F.col("depth") == 2, 4).otherwise(F.col("depth")))
    assert sum(x["violations"] for x in validate.validate(e, wrong, root).collect()) > 0
    runs = traverse.run_many(e, g.vertices, [root])
    assert runs.first()["edges"] == claimed


@pytest.mark.parametrize("sizes", [[2, 3], [3, 4], [3, 4, 5]])
@pytest.mark.parametrize("mode", [0, 1, 2])
def test_kronecker_triangles_match_the_closed_form(spark, sizes, mode):
    low, n = matrix.kron_of_stars(spark, sizes, mode)
    want = {(2, 3): (12, [12, 17, 17]), (3, 4): (20, [24, 31, 31]), (3, 4, 5): (120, [240, 346, 346])}[tuple(sizes)]
    assert (n, low.count()) == (want[0], want[1][mode])
    e = low.select(F.col("col").alias("u"), F.col("row").alias("v"))
    assert triangles.count_triangles(e).first()[0] == matrix.kron_triangles(sizes, mode)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 64])
def test_seven_numbers(spark, n):
    xs = sorted((i * 37) % 101 / 2 for i in range(n))
    got = stats.seven_numbers(spark.createDataFrame([(x,) for x in xs], "x double"), "x").first()
    assert got["firstquartile"] == (xs[(n - 1) // 4] + xs[n // 4]) / 2
    assert got["median"] == (xs[(n - 1) // 2] + xs[n // 2]) / 2
    assert got["thirdquartile"] == (xs[n - 1 - (n - 1) // 4] + xs[n - 1 - n // 4]) / 2
    assert (got["min"], got["max"], got["n"]) == (xs[0], xs[-1], n)
    assert (got["stddev"] is None) == (n == 1)


def test_histogram_gather_and_checks(spark):
    idx = spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "i long, idx long")
    h = micro.histogram(idx, 4)
    assert sorted(map(tuple, h.collect())) == [(0, 1), (1, 0), (2, 2), (3, 0)]
    assert micro.histogram_check(idx, h).isEmpty()
    tab = spark.range(4).select(F.col("id").alias("idx"), (-(F.col("id") + 1)).alias("val"))
    assert sorted(map(tuple, micro.index_gather(idx, tab).collect())) == [(0, -3), (1, -3), (2, -1)]


def test_sampling_keeps_whole_rows(spark):
    a = entries(spark, TWO_CLIQUES)
    sizes = {r["row"]: r["count"] for r in a.groupBy("row").count().collect()}
    got = sampling.sample_rows(a, 20)
    counts = [r["count"] for r in got.groupBy("row").count().collect()]
    assert len(counts) == 20 and set(counts) <= set(sizes.values())
    assert sampling.sample_columns(a, 5).select("col").distinct().count() == 5


def test_build_and_balance(spark):
    e = edges(spark, TWO_CLIQUES)
    g = build.build(e, spark.range(8), 8, 4, "snake_rotation")
    assert g.edges.count() == 26 and g.vertices.count() == 8
    assert g.edges.rdd.glom().map(lambda rows: len({r["owner"] for r in rows})).max() == 1
    s = build.load_balance(build.build(e, spark.range(8), 8, 4).edges, 4).first()
    assert (s["total"], s["mean"]) == (26, 6.5) and s["lowest"] <= 6.5 <= s["highest"]
