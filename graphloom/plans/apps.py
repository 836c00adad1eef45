"""The mini-apps: get a graph, run one kernel, check it, report.

Options carry the names and defaults of the command lines they stand for:
``rows`` and ``nz_per_row`` (or ``edge_prob``) for a random matrix, ``kron`` for a
product of stars ("mode m1 m2 ..."), ``file`` for a Matrix Market file.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import build, generate, jaccard, matrix, micro, pagerank, sampling, traverse, triangles, validate
from ..sources.mtx import read_mtx
from .loops import cut

ROWS, NZ_PER_ROW, SEED, EDGEFACTOR = 10_000, 35, 12345, 16


def report(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """(key, value) lines."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def acquire(spark: SparkSession, rows: int = ROWS, nz_per_row: float = NZ_PER_ROW, edge_prob: float | None = None, kron: str | None = None, file: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, int | None]:
    """(edges u < v, vertices, triangles known from a closed form)."""
    known = None
    if file is not None:
        m = read_mtx(spark, file)
        n, a = m.numrows, matrix.drop_loops(m.entries)
    elif kron is not None:
        mode, *sizes = map(int, kron.split())
        if len(sizes) < 2:
            raise ValueError("a product needs at least two sizes")
        a, n = matrix.kron_of_stars(spark, sizes, mode)
        known = matrix.kron_triangles(sizes, mode)
    else:
        n = rows
        a = generate.erdos_renyi_lower(spark, n, generate.probability(n, nz_per_row) if edge_prob is None else edge_prob, seed)
    lower = matrix.tril(matrix.symmetrize(a), -1)
    return cut(lower.select(F.col("col").alias("u"), F.col("row").alias("v"))), spark.range(n), known


def _timed(f) -> tuple[object, float]:
    began = time.perf_counter()
    return f(), time.perf_counter() - began


def triangle_app(spark: SparkSession, alg: int = 0, sample: float | None = None, **graph) -> DataFrame:
    edges, vertices, known = acquire(spark, **graph)
    lower = edges.select(F.col("v").alias("row"), F.col("u").alias("col"))
    work = build.push_pull_estimate(lower).first()
    count, seconds = _timed(lambda: triangles.count_triangles(edges, alg).first()["triangles"])
    out = {"vertices": vertices.count(), "edges": edges.count(), "pushes": work["pushes"], "pulls": work["pulls"], "triangles": count, "seconds": seconds}
    if known is not None:
        out |= {"closed_form": known, "correct": known == count}
    if sample is not None:
        guess, faster = _timed(lambda: sampling.approximate_triangles(edges, sample).first()["triangles"])
        out |= {"estimate": guess, "error_percent": 100 * abs(guess - count) / max(count, 1), "speed_up": seconds / faster}
    return report(spark, out)


def centrality_app(spark: SparkSession, **graph) -> DataFrame:
    edges, vertices, _ = acquire(spark, **graph)
    return triangles.triangle_centrality(edges, vertices)


def pagerank_app(spark: SparkSession, damping: float = 0.85, tol: float = 1e-5, **graph) -> DataFrame:
    edges, vertices, _ = acquire(spark, **graph)
    ranks, seconds = _timed(lambda: cut(pagerank.pagerank(edges, vertices, damping, tol)))
    check = pagerank.self_check(ranks).first()
    return report(spark, {"vertices": vertices.count(), "edges": edges.count(), "total": check["total"], "correct": check["correct"], "seconds": seconds})


def jaccard_app(spark: SparkSession, **graph) -> DataFrame:
    return jaccard.jaccard_edges(acquire(spark, **graph)[0])


def kmer_app(spark: SparkSession, file: str, dense: bool = False) -> DataFrame:
    m = read_mtx(spark, file)
    return jaccard.jaccard_columns(m.entries, m.numcols if dense else None)


def histogram_app(spark: SparkSession, updates: int = 1_000_000, size: int = 1000, seed: int = SEED) -> DataFrame:
    """Counts random updates and takes them back again."""
    idx = spark.range(updates).select(generate.uniform_int(size, "id", seed=seed).alias("idx"))
    counts, seconds = _timed(lambda: cut(micro.histogram(idx, size)))
    return report(spark, {"updates": updates, "bins": counts.count(), "wrong_bins": micro.histogram_check(idx, counts).count(), "seconds": seconds})


def index_gather_app(spark: SparkSession, requests: int = 1_000_000, size: int = 100_000, seed: int = SEED) -> DataFrame:
    """Gathers table[idx] = -(idx + 1) for random requests and counts the wrong ones."""
    req = spark.range(requests).select(F.col("id").alias("i"), generate.uniform_int(size, "id", seed=seed).alias("idx"))
    tab = spark.range(size).select(F.col("id").alias("idx"), (-(F.col("id") + 1)).alias("val"))
    got, seconds = _timed(lambda: cut(micro.index_gather(req, tab)))
    wrong = got.join(req, "i").where("val <> -(idx + 1)").count()
    return report(spark, {"requests": requests, "answers": got.count(), "wrong": wrong, "seconds": seconds})


def traversal_benchmark(
    spark: SparkSession, scale: int, edgefactor: int = EDGEFACTOR, kind: str = "kronecker", kernel: str = "bfs", n_roots: int = 64, parts: int = 8, scheme: str = "cyclic", skip_run: bool = False, skip_validation: bool = False, **options
) -> DataFrame:
    """Generate, build, traverse from many roots, validate; (key, value) lines with run-time and TEPS statistics."""
    g, made = _timed(lambda: generate.generate(spark, kind, scale, edgefactor))
    edges = cut(generate.with_weights(g.edges) if kernel == "sssp" else g.edges)
    vertices, n = g.vertices, 1 << scale
    built, building = _timed(lambda: build.build(edges, vertices, n, parts, scheme))
    balance = build.load_balance(built.edges, parts).first()
    out: dict[str, object] = {"SCALE": scale, "edgefactor": edgefactor, "graph_generation": made, "num_processes": parts, "construction_time": building}
    out |= {f"load_{k}": balance[k] for k in ("lowest", "highest", "total", "mean", "variance", "max_deviation", "imbalance")}
    if skip_run:
        return report(spark, out)
    work = matrix.simplify_weighted(edges) if kernel == "sssp" else edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    work = cut(work)
    roots = [r["id"] for r in generate.search_roots(edges, n, n_roots).collect()]
    run = traverse.sssp if kernel == "sssp" else traverse.bfs
    runs, checked, valid = [], [], True
    for i, root in enumerate(roots):
        result, seconds = _timed(lambda root=root: cut(run(work, vertices, root, **options)))
        runs.append((i, seconds, float(traverse.traversed_edges(edges, result).first()["edges"])))
        if not skip_validation:
            found, took = _timed(lambda root=root, result=result: validate.validate(work, result, root, kernel == "sssp").agg(F.sum("violations")).first()[0])
            valid, checked = valid and not found, [*checked, took]
    table = spark.createDataFrame(runs, "run int, seconds double, edges double")
    for name, df, col in (("time", table, "seconds"), ("nedge", table, "edges"), ("TEPS", table.select((F.col("edges") / F.col("seconds")).alias("teps")), "teps")):
        s = stats.seven_numbers(df, col).first()
        out |= {f"{kernel} {k}_{name}": s[k] for k in ("min", "firstquartile", "median", "thirdquartile", "max", "mean", "stddev")}
    h = stats.harmonic_teps(table).first()
    out |= {f"{kernel} harmonic_mean_TEPS": h["harmonic_mean"], f"{kernel} harmonic_stddev_TEPS": h["harmonic_stddev"]}
    if checked:
        out |= {f"{kernel} mean_validate": sum(checked) / len(checked), "validation": "passed" if valid else "failed"}
    return report(spark, out)
