import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import overlap, simhash
from graphloom.llm.components import connected_components


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{fp: smallest fp reachable} by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= simhash.DISTANCE:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def some_fingerprints(seed, n):
    rng, out = random.Random(seed), []
    while len(out) < n:
        f = rng.choice([rng.getrandbits(64), 0, (1 << 64) - 1, *out[-50:]] if out else [rng.getrandbits(64)])
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return out


def signed(fps):
    return np.array(fps, np.uint64).view(np.int64).tolist()


def components_of(spark, fps, **options):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed(fps))], "id long, fp long")
    return {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.fingerprint_components(df, **options).collect()}


def check(spark, fps, **options):
    got, want, first = components_of(spark, fps, **options), brute_components(fps), {}
    for i, f in enumerate(fps):
        first.setdefault(want[f], i)
    assert got == {f: first[want[f]] for f in set(fps)}


def test_grid_join_loses_no_link(spark):
    check(spark, some_fingerprints(1, 600))


def test_large_cells_go_another_way(spark):
    rng, centre = random.Random(3), 0x0123456789ABCDEF
    ball = [centre ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3) for _ in range(120)]
    check(spark, ball + some_fingerprints(4, 100), max_cell=10)
    check(spark, ball)


def test_forest_connects_what_pairs_connect():
    fps = np.array(sorted(set(some_fingerprints(5, 400))), np.uint64)
    a, b = simhash.forest(fps)
    assert len(a) <= len(fps)
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    assert {f: find(f) for f in root} == brute_components(root)


def test_components_of_chains_hubs_and_rings(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    df = spark.createDataFrame(edges + edges[:10], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}, **{2000 + i: 2000 for i in range(9)}}
    assert connected_components(df.limit(0)).isEmpty()


def documents(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice(["a", "Bee", "see", "dée", "x"]) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    rows += [(100 + i, t.upper(), "s") for i, t in enumerate(base[:10])] + [(200 + i, t + " tail", "s") for i, t in enumerate(base[:30])]
    rows += [(300, None, "s"), (301, "", "s"), (302, " \n\t ", "s"), (None, base[0], "s"), (3, base[3], "s"), (400, "word " * 60_000, None), (401, "one two", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string"), rows


def test_documents(spark):
    d, rows = documents(spark)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    parts, best = brute_components(fps), {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            best[parts[f]] = min(i, best.get(parts[f], i))
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == sorted(((i, f, best[parts[f]]) for (i, *_), f in zip(rows, fps, strict=True)), key=str)
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best.values())
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.deduplicate(d.limit(0)).count() == 0


def test_rows_without_any_id(spark):
    d = spark.createDataFrame([(None, "alpha beta gamma"), (None, "alpha beta gamma"), (None, "other words here")], "doc_id long, text string")
    assert simhash.deduplicate(d).count() == 2
    assert simhash.near_duplicates(d).where(F.col("component_id").isNotNull()).isEmpty()


@pytest.mark.parametrize(("hot", "part"), [(overlap.HOT, overlap.PART), (2, 3)])
def test_overlap_links_every_pair_at_four_fifths(spark, monkeypatch, hot, part):
    monkeypatch.setattr(overlap, "HOT", hot)
    monkeypatch.setattr(overlap, "PART", part)
    rng = random.Random(12)
    texts = {}
    for g in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for k in range(4):
            w = list(words)
            for _ in range(k * len(w) // 60):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            texts[10 * g + k] = " ".join(w)
    texts |= {900: None, 901: "", 902: "two words", 903: "Two  words"}
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := (t or "").lower().split())}
    alike = {(i, j) for i in grams for j in grams if i < j and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    near = {(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE}
    assert len(alike - near) > 10
    root = {i: i for i in texts}
    for _ in texts:
        for i, j in alike | near:
            root[i] = root[j] = min(root[i], root[j])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"] for r in simhash.deduplicate(d, overlapping=True).collect()}
    assert got == set(root.values()) and got < {r["doc_id"] for r in simhash.deduplicate(d).collect()}
    assert simhash.deduplicate(d.limit(0), overlapping=True).count() == 0


def test_overlapping_sets_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARE", 0.2)
    test_overlap_links_every_pair_at_four_fifths(spark, monkeypatch, 2, 3)


def test_shingles_are_counted_in_all_texts(spark):
    texts = ["a b c d e f a b c d e", "A b c d e", "two words", "", None, *[f"x y z {i} v w" for i in range(30)]]
    want = np.zeros(overlap.BUCKETS, np.int64)
    for t in texts:
        w = (t or "").lower().split()
        for g in {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ():
            want[xxhash.xxh64_intdigest(g) % overlap.BUCKETS] += 1
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k1 long, text string").repartition(3)
    assert (overlap.shingle_counts(d) == want).all()
