import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import partition
from graphloom.operators import generate, matrix
from graphloom.schema import Matrix
from graphloom.sources import edges as edge_files
from graphloom.sources import mtx

from .graphs import MESSY, TWO_CLIQUES, entries, mtx_text

#: Owners of 16 vertices in 4 parts (fixed values).
OWNERS = {
    "cyclic": [0, 1, 2, 3] * 4,
    "range": [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4,
    "snake": [0, 1, 2, 3, 3, 2, 1, 0] * 2,
    "rotation": [0, 1, 2, 3, 1, 2, 3, 0, 2, 3, 0, 1, 3, 0, 1, 2],
    "snake_rotation": [0, 1, 2, 3, 3, 2, 1, 0, 1, 2, 3, 0, 2, 1, 0, 3],
}


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("scheme", OWNERS)
def test_owner_vectors(spark, scheme):
    got = [r[0] for r in spark.range(16).orderBy("id").select(partition.owner(scheme, "id", 4, 16)).collect()]
    assert got == OWNERS[scheme]


@pytest.mark.parametrize("scheme", partition.SCHEMES)
def test_owners_are_parts(spark, scheme):
    got = spark.range(1000).select(partition.owner(scheme, "id", 7, 1000).alias("o")).agg(F.min("o"), F.max("o")).first()
    assert 0 <= got[0] <= got[1] < 7


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=12, unique=True))
def test_triangles_and_transpose(spark, pairs):
    a = entries(spark, pairs)
    assert matrix.matrices_equal(matrix.transpose(matrix.transpose(a)), a).first()["equal"]
    assert matrix.matrices_equal(matrix.tril(a).union(matrix.triu(a, 1)), a).first()["equal"]
    s = matrix.symmetrize(a)
    assert matrix.matrices_equal(s, matrix.transpose(s)).first()["equal"]


def test_predicates(spark):
    a = entries(spark, TWO_CLIQUES)
    assert matrix.is_lower_triangular(a).first()["ok"] and not matrix.is_upper_triangular(a).first()["ok"]
    assert not matrix.is_lower_triangular(a, 8).first()["ok"]
    with_diagonal = a.union(spark.range(8).select("id", F.col("id").alias("c")))
    assert matrix.is_lower_triangular(with_diagonal, 8).first()["ok"]
    p = generate.random_permutation(spark, 50)
    assert matrix.is_permutation(p).first()["ok"]
    assert not matrix.is_permutation(p.withColumn("p", F.col("p") + 1)).first()["ok"]
    assert not matrix.matrices_equal(a, a.union(a.limit(1))).first()["equal"]


def test_permutation_keeps_entries(spark):
    a, p = entries(spark, MESSY), generate.random_permutation(spark, 6, 3)
    q = {r["i"]: r["p"] for r in p.collect()}
    assert rows(matrix.permute(a, p, p)) == sorted((q[r - 1], q[c - 1]) for r, c in MESSY)


def test_csr_round_trip(spark):
    a = entries(spark, MESSY)
    off = matrix.csr_offsets(a)
    assert [r["offset"] for r in off.orderBy("row").collect()] == [0, 3, 4, 7, 10, 12]
    flat = [(i, c - 1) for i, (_, c) in enumerate(sorted(MESSY))]
    assert rows(matrix.csr_to_coo(off, spark.createDataFrame(flat, "pos long, col long"))) == rows(a)


def test_mtx_round_trip_and_errors(spark, tmp_path):
    (tmp_path / "a.mtx").write_text(mtx_text(MESSY, 6, 6))
    m = mtx.read_mtx(spark, str(tmp_path / "a.mtx"))
    assert (m.numrows, m.numcols) == (6, 6) and rows(m.entries) == sorted((r - 1, c - 1) for r, c in MESSY)
    mtx.write_mtx(m, str(tmp_path / "b"))
    assert rows(mtx.read_mtx(spark, str(tmp_path / "b")).entries) == rows(m.entries)
    mtx.write_dataset(m, str(tmp_path / "c"), writers=3)
    assert mtx.read_metadata(spark, str(tmp_path / "c/metadata")) == {"numrows": 6, "numcols": 6, "nnz": 14, "nwriters": 3}
    assert rows(mtx.read_dataset(spark, str(tmp_path / "c")).entries) == rows(m.entries)
    for name, text in {"banner": "%%Nothing\n1 1 1\n1 1", "field": mtx_text(MESSY, 6, 6).replace("pattern", "real"), "count": mtx_text(MESSY, 6, 6) + "\n1 2", "range": mtx_text(MESSY, 3, 3), "empty": ""}.items():
        (tmp_path / f"{name}.mtx").write_text(text)
        with pytest.raises(ValueError):
            mtx.read_mtx(spark, str(tmp_path / f"{name}.mtx"))


def test_edge_files(spark, tmp_path):
    a = entries(spark, TWO_CLIQUES)
    edge_files.write_kmer_samples(a, str(tmp_path / "k"))
    assert rows(edge_files.read_kmer_samples(spark, str(tmp_path / "k"))) == rows(a)
    edge_files.write_edges(a, str(tmp_path / "e"))
    edge_files.write_edges(a.limit(1), str(tmp_path / "e"), reuse=True)
    assert rows(edge_files.read_edges(spark, str(tmp_path / "e"))) == rows(a)
    dump = spark.createDataFrame([(0, "t 0: 4"), (1, "t 1: 2"), (2, "t 2: 0")], "pos long, value string")
    offsets = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 3)], "row long, offset long, next_offset long")
    assert rows(edge_files.edge_dump_to_coo(edge_files.numbers(dump, "col"), offsets)) == [(3, 1), (3, 1), (5, 1)]


@pytest.mark.parametrize("kind", list(generate.GENERATORS))
def test_generators_do_not_depend_on_partitions(spark, kind):
    g = generate.generate(spark, kind, 6, 8)
    assert g.edges.count() == 8 * 64
    assert g.edges.agg(F.max(F.greatest("u", "v"))).first()[0] < 64
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        again = rows(generate.generate(spark, kind, 6, 8).edges)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert again == rows(g.edges)


def test_rmat_quadrants(spark):
    g = generate.rmat_edges(spark, 8, 64)
    top = g.edges.select((F.shiftright("u", 7) * 2 + F.shiftright("v", 7)).alias("q")).groupBy("q").count().collect()
    share = {r["q"]: r["count"] / (64 * 256) for r in top}
    assert [share[q] for q in range(4)] == pytest.approx([0.57, 0.19, 0.19, 0.05], abs=0.02)


def test_scramble_is_a_bijection(spark):
    for scale in (1, 5, 8):
        assert spark.range(1 << scale).select(generate.scramble(F.col("id"), scale, 3).alias("x")).distinct().count() == 1 << scale


def test_erdos_renyi(spark):
    n, p = 400, 0.05
    low = generate.erdos_renyi(spark, n, p)
    mean, sd = generate.expected_edges(n, p)
    for m in (low, generate.erdos_renyi_naive(spark, n, p)):
        assert abs(m.count() - mean) < 5 * sd
        assert m.where("col >= row or col < 0").isEmpty()
        assert m.distinct().count() == m.count()
    assert generate.erdos_renyi(spark, n, p, "symmetric").count() == 2 * low.count()
    assert generate.erdos_renyi(spark, n, p, "upper", unit_diagonal=True).count() == low.count() + n
    assert generate.erdos_renyi(spark, 5, 1.0).count() == 10 and generate.erdos_renyi(spark, 5, 0.0).count() == 0


def test_kmer_matrix_has_no_empty_line(spark):
    a = generate.kmer_matrix(spark, 30, 9, 0.01)
    assert a.select("row").distinct().count() == 30 and a.select("col").distinct().count() == 9


def test_hypergeometric_free_helpers(spark):
    assert generate.probability(100, 35) == pytest.approx(0.68) and generate.probability(10, 100) == 1.0
    assert np.isclose(generate.expected_edges(3, 0.5)[0], 1.5)


def test_matrix_market_in_many_parts(spark, tmp_path):
    from graphloom.schema import Matrix

    a = spark.range(2000).selectExpr("id % 97 as row", "id as col")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, single in (("parts", False), ("one", True)):
            path = tmp_path / name
            mtx.write_mtx(Matrix(a, 97, 2000), str(path), single)
            files = sorted(x for x in path.glob("part-*"))
            assert single == (len(files) == 1)
            back = mtx.read_mtx(spark, str(path))
            assert (back.numrows, back.numcols) == (97, 2000)
            assert sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, a.collect()))
        text = files[0].read_text().splitlines()
        assert text[0].startswith("%%MatrixMarket") and text[1] == "97 2000 2000" and len(text) == 2002
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    (tmp_path / "integer.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n3 3 2\n1 2 7\n3 3 9\n")
    assert sorted(map(tuple, mtx.read_mtx(spark, str(tmp_path / "integer.mtx")).entries.collect())) == [(0, 1), (2, 2)]


def test_unknown_requests_and_large_factors(spark, monkeypatch):
    from graphloom.operators import matrix, micro

    got = micro.index_gather(spark.createDataFrame([(1, 5), (2, 6)], "i long, idx long"), spark.createDataFrame([(5, 50)], "idx long, val long"))
    assert sorted(map(tuple, got.collect())) == [(1, 50), (2, None)]
    monkeypatch.setattr(matrix, "KRON_ENTRIES", 3)
    a = spark.range(4).selectExpr("id as row", "id as col")
    with pytest.raises(ValueError):
        matrix.kron(a, a, 4, 4)
