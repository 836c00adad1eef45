import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import sharding


def rows_of(spark, n, text="t"):
    return spark.createDataFrame([(i, f"{text}{i % 7}") for i in range(n)], "doc_id long, text string")


@pytest.mark.parametrize(("n", "parts"), [(0, 3), (1, 2), (23, 3), (1000, 5)])
def test_exact_sizes_and_gapless_slots(spark, n, parts):
    out = sharding.assign(sharding.document_rows(rows_of(spark, n).repartition(parts)), 24).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(n))
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values(), default=0) - (min(sizes.values()) if len(sizes) == 24 else 0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_groups_within_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 20)
    out = sharding.assign(sharding.document_rows(rows_of(spark, 1000)), 3).collect()
    for s in range(3):
        mine = [r["slot"] for r in out if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))


def test_shuffles_are_uniform(spark):
    """Where a row goes has nothing to do with where it was."""
    df = sharding.document_rows(rows_of(spark, 12).repartition(3))
    seen = Counter()
    for seed in range(30):
        for r in sharding.assign(df, 3, seed).collect():
            seen[(r["doc_id"], r["shard"])] += 1
    x = np.array([[seen[(i, s)] for s in range(3)] for i in range(12)])
    assert x.sum() == 360 and ((x - 10) ** 2 / 10).sum() < 60  # 24 degrees of freedom, p below 1e-4


def test_same_seed_same_deal(spark):
    df = sharding.document_rows(rows_of(spark, 300).coalesce(2))
    assert sorted(sharding.assign(df, 5, 1).collect()) == sorted(sharding.assign(df, 5, 1).collect())
    assert sorted(sharding.assign(df, 5, 1).collect()) != sorted(sharding.assign(df, 5, 2).collect())


def test_matrix_margins_and_law():
    m = sharding.communication_matrix([5, 0, 7], [6, 3, 3], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [6, 3, 3]
    rng = np.random.default_rng(1)
    draws = [sharding.communication_matrix([5, 7], [6, 6], int(s))[0, 0] for s in rng.integers(0, 1 << 40, 3000)]
    from math import comb

    for k in range(6):
        assert draws.count(k) / 3000 == pytest.approx(comb(6, k) * comb(6, 5 - k) / comb(12, 5), abs=0.04)


def test_large_populations(monkeypatch):
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)
    rng = np.random.default_rng(2)
    for good, bad, n in ((6, 6, 5), (50, 3, 40), (1, 100, 50), (10**11, 10**12, 10**10)):
        x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(500)])
        total, mean = good + bad, n * good / (good + bad)
        sd = (mean * bad / total * (total - n) / (total - 1)) ** 0.5
        assert max(0, n - bad) <= x.min() and x.max() <= min(good, n)
        assert abs(x.mean() - mean) < 5 * sd / 500**0.5 and x.std() == pytest.approx(sd, rel=0.2)


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "é", 9), (2, "", 9), (3, "x" * 100_000, 9)], "doc_id long, text string, shard int")
    out = sharding.assign(sharding.document_rows(d).withColumn("slot", sharding.F.lit("clash")), 2).collect()
    assert len(out) == 5
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str)
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ((1, None), (1, None), (None, "é"), (2, ""), (3, "x" * 100_000))]
    assert got == sorted(want, key=str)
