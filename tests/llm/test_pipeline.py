"""Each stage is held against the operator's own tests' brute force on a small table with planted cases."""

import random

import pytest

import corpus_pipeline
from graphloom.llm import decontam, toxicity

from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(400)]
    line = lambda n=12: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, line(30)) for i in range(10)]
    docs = [[line() for _ in range(6)] for _ in range(150)]
    docs += [list(x) for x in docs[:5]]  # exact copies
    docs += [[*x[:3], bench[i][1], *x[4:]] for i, x in enumerate([[line() for _ in range(6)] for _ in range(5)])]
    toxic = [[line(), "you stupid idiot and idiot", line()] for _ in range(30)] + [[line(), "such an 1d10t and st*pid i d i o t", line()] for _ in range(5)]
    rows = [(i, "\n".join(x), "en", "s", 0) for i, x in enumerate(docs + toxic)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= len(docs))) for i in range(len(docs) + 30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, set(range(len(docs), len(docs) + 35)), dict(bench)


def test_stages(spark, folder):
    path, rows, toxic, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, path).persist())
        docs = seen[name][1]
        assert docs.columns[:5] == COLUMNS
    after = {k: {r["doc_id"]: r["text"] for r in v[1].collect()} for k, v in seen.items()}
    assert set(after["toxicity"]) == {r[0] for r in rows} - toxic

    left = [(i, t) for i, t in after["toxicity"].items()]
    for (i, t), gone in zip(left, brute_lines(left), strict=True):
        want = t if t is None or not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert after["line_dedup"][i] == want

    fps = {i: brute_fingerprint(t) for i, t in after["line_dedup"].items()}
    parts, best = brute_components(fps.values()), {}
    for i, f in fps.items():
        best[parts[f]] = min(i, best.get(parts[f], i))
    assert set(after["simhash_near_dedup"]) == set(best.values())

    block = decontam.Block([(i, t.encode()) for i, t in bench.items()], decontam.MIN_TILE)
    dirty = {i for i, t in after["simhash_near_dedup"].items() if block.matches((t or "").encode(), decontam.COVERAGE)}
    assert len(dirty) == 5 and set(after["decontamination"]) == set(after["simhash_near_dedup"]) - dirty
    assert after["byte_bpe"] == after["decontamination"]


def test_run_equals_the_stages(spark, folder):
    path, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*COLUMNS, "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_empty_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_toxicity_uses_no_held_out_labels(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    share = ids.where(toxicity.held_out()).count() / 1000
    assert 0.15 < share < 0.25
