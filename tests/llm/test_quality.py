import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t\x0b\x0c\r ", "a b c", "a b c a b c", "x " * 5000, "🙂é" * 100, "a\n\na\n a\na", "a b c d \x1c e"]
    for _ in range(200):
        texts.append("".join(rng.choice(["a", "b", "é", "##"]) + rng.choice([" ", "\n", "  ", "\t", "\r\n"]) for _ in range(rng.randrange(120))))
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = quality.text_statistics(d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in quality.STATS) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        n, *_, rep = brute(texts[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)


FLOOR = np.diag((np.array(quality.FLOORS) * quality.UNIT) ** 2)


def log_determinant(core):
    return np.linalg.slogdet(np.cov(core.T, bias=True) * quality.CONSISTENCY + FLOOR)[1]


def searched(y, rng, tries):
    """Least log determinant of a core among plain concentration from many random starts."""
    h, best = int(np.ceil(quality.CORE * len(y))), np.inf
    for _ in range(tries):
        core = y[rng.choice(len(y), min(len(y), quality.P + 1), replace=False)]
        while True:
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) * quality.CONSISTENCY + FLOOR
            d = np.einsum("ij,ij->i", y - m, np.linalg.solve(c, (y - m).T).T)
            core = y[np.argsort(d, kind="stable")[:h]]
            now = log_determinant(core)
            if not now < best - 1e-9:
                break
            best = now
    return best


def points(spark, groups):
    rows = [(g, *map(int, r)) for g, y in groups.items() for r in y]
    return spark.createDataFrame(rows, "g string, " + ", ".join(f"y{i} long" for i in range(quality.P))).repartition(7)


def test_least_determinant_is_as_low_as_a_search_finds(spark):
    rng = np.random.default_rng(2)
    shape = rng.normal(0, 1, (quality.P, quality.P))
    groups = {}
    for name, n, bad in (("big", 600, 60), ("fifth", 200, 45), ("few", 30, 6), ("one", 1, 0), ("two", 2, 0)):
        y = np.rint(rng.normal(0, 400, (n, quality.P)) @ shape).astype(int)
        y[:bad] += 9000
        groups[name] = y
    groups["same"] = np.full((50, quality.P), 77)
    got = {r["g"]: r for r in quality.mcd(points(spark, groups)).collect()}
    for name, y in groups.items():
        r = got[name]
        assert r["n"] == len(y)
        if len(y) > 2:
            # the core's last bin is shared out, so determinants agree nearly, not to the last digit
            assert r["ld"] <= searched(y, rng, 40) + 0.02
        c = np.zeros((quality.P, quality.P))
        for i, j in quality.PAIRS:
            c[i, j] = c[j, i] = r[f"c{i}{j}"]
        assert r["ld"] == pytest.approx(np.linalg.slogdet(c)[1])
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(quality.P)] for i in range(quality.P)])
        assert low @ low.T == pytest.approx(c, rel=1e-9, abs=1e-3)
    assert [got["one"][m] for m in quality.MEANS] == groups["one"][0].tolist()
    assert got["same"]["ld"] == pytest.approx(np.linalg.slogdet(FLOOR)[1])


def test_small_groups_lean_on_larger_ones(spark):
    m = [0.0] * quality.P
    c = [float(i == j) * 100 for i, j in quality.PAIRS]
    zero = [0.0] * (len(quality.FACTOR) + 1)
    rows = [("*", 10_000, *m, *c, *zero), ("len", 400, *[8.0] * quality.P, *c, *zero), ("sen1", 1, *[16.0] * quality.P, *c, *zero), ("sen2", 40_000, *[16.0] * quality.P, *c, *zero)]
    names = ["g", "n", *quality.MEANS, *quality.COVARIANCES, *quality.FACTOR, "ld"]
    out = quality.shrunk(spark.createDataFrame(rows, names), spark.createDataFrame([("len", "sen1"), ("len", "sen2")], "g1 string, g2 string"))
    got = {r["g2"]: r["m0"] for r in out.collect()}
    k = quality.PRIOR_ROWS
    lang = 400 * 8.0 / (400 + k)
    assert got == pytest.approx({"sen1": (16 + k * lang) / (1 + k), "sen2": (40_000 * 16 + k * lang) / (40_000 + k)})


def documents(rng, n, source):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    return [(" ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(rng.randrange(60, 300))), "en", source) for _ in range(n)]


def test_judging_and_odd_rows(spark):
    rng = random.Random(3)
    good = documents(rng, 200, "a") + documents(rng, 30, "b") + documents(rng, 90, "c")
    junk = [(" ".join(f"###{w}###" for w in t.split()), lang, s) for t, lang, s in documents(rng, 10, "a") + documents(rng, 5, "b")]
    odd = [(None, "en", "a"), ("", None, None), (good[0][0], None, None), (good[0][0], None, None), ("w" * 100_000, "en", "a"), (good[1][0] * 50, "en", "a")]
    rows = [(i, *r, "x") for i, r in enumerate(good + junk + odd)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    out = quality.judge(d)
    assert out.columns == ["doc_id", "lang", "source", *quality.STATS, "base_failed", "distance", "kept"]
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert len(kept) == len(rows)
    n, m = len(good), len(junk)
    assert all(kept[i] for i in range(n)) and not any(kept[i] for i in range(n, n + m))
    assert [kept[n + m + i] for i in range(6)] == [False, False, True, True, False, False]
    assert quality.judge(d.limit(0)).count() == 0


def test_small_groups_and_small_tables_are_judged(spark):
    rng = random.Random(4)
    junk = lambda t: " ".join(f"###{w}###" for w in t.split())
    big = documents(rng, 300, "a")
    rare = [(junk(t) if i < 3 else t, "es", "b") for i, (t, *_) in enumerate(documents(rng, 20, "b"))]
    source = [(junk(t) if i < 3 else t, "en", "c") for i, (t, *_) in enumerate(documents(rng, 20, "c"))]
    schema = "doc_id long, text string, lang string, source string"
    for rows, bad in ((big + rare + source, {300, 301, 302, 320, 321, 322}), (rare, {0, 1, 2})):
        out = quality.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)).collect()
        assert len(out) == len(rows) and {r["doc_id"] for r in out if not r["kept"]} == bad
        assert all(r["distance"] is not None for r in out)
    alone = quality.judge(spark.createDataFrame([(0, *big[0])], schema)).first()
    assert alone["kept"] and alone["distance"] == 0


def test_verdicts_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = quality.judge(d.coalesce(1)).orderBy("doc_id").collect()
    assert one == quality.judge(d.repartition(9)).orderBy("doc_id").collect()
