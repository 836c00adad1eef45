import pytest

from graphloom.plans import apps

from .graphs import KMERS, TWO_CLIQUES, mtx_text


def lines(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_triangles_of_a_known_product(spark):
    got = lines(apps.triangle_app(spark, kron="1 3 4 5", sample=0.8))
    assert got["triangles"] == got["closed_form"] == "287" and got["correct"] == "True" and float(got["error_percent"]) >= 0
    with pytest.raises(ValueError):
        apps.triangle_app(spark, kron="1 3")


def test_files(spark, tmp_path):
    (tmp_path / "g.mtx").write_text(mtx_text(TWO_CLIQUES, 8, 8))
    (tmp_path / "k.mtx").write_text(mtx_text(KMERS, 4, 5))
    assert lines(apps.triangle_app(spark, file=str(tmp_path / "g.mtx"), alg=1))["triangles"] == "8"
    assert apps.centrality_app(spark, file=str(tmp_path / "g.mtx")).count() == 8
    assert apps.jaccard_app(spark, file=str(tmp_path / "g.mtx")).count() == 13
    assert apps.kmer_app(spark, str(tmp_path / "k.mtx"), dense=True).count() == 10


def test_random_graphs(spark):
    got = lines(apps.pagerank_app(spark, rows=300, nz_per_row=12))
    assert got["correct"] == "true" or got["correct"] == "True"
    assert lines(apps.histogram_app(spark, 5000, 50))["wrong_bins"] == "0"
    got = lines(apps.index_gather_app(spark, 5000, 100))
    assert (got["answers"], got["wrong"]) == ("5000", "0")


@pytest.mark.parametrize("kernel", ["bfs", "sssp"])
def test_traversal_benchmark(spark, kernel):
    got = lines(apps.traversal_benchmark(spark, 6, 8, kernel=kernel, n_roots=2))
    assert got["validation"] == "passed" and float(got[f"{kernel} harmonic_mean_TEPS"]) > 0
    assert "validation" not in lines(apps.traversal_benchmark(spark, 6, 8, skip_run=True))
