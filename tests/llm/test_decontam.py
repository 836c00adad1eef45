import random

from graphloom.llm import decontam


def brute_tiles(doc, item, k):
    """Greedy string tiling by trying all places, longest first, then by item place, then document place."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and free_i[p + n] and free_d[d + n] and item[p + n] == doc[d + n]:
                    n += 1
                if n >= k and (best is None or n > best[0]):
                    best = (n, p, d)
        if best is None:
            return out
        n, p, d = best
        out.append((d, p, n))
        free_d[d : d + n], free_i[p : p + n] = [False] * n, [False] * n


def test_tiling_equals_brute_force():
    rng = random.Random(7)
    for k in (2, 3):
        for _ in range(150):
            item = [rng.choice("abcd") for _ in range(rng.randrange(3, 12))]
            doc = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
            block = decontam.Block([(0, " ".join(item).encode())], k)
            got = block.matches(" ".join(doc).encode(), 1e-9)
            want = brute_tiles(doc, item, k)
            assert (got[0][1:3] if got else (0, 0)) == (len(want), sum(n for *_, n in want))


def passage(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(8)
    items = [(i, passage(rng, 40)) for i in range(30)]
    noise = lambda: passage(rng, 100)
    rows, want = [], set()
    for i, p in items[:10]:
        rows.append((i, noise() + p + noise()))
        want.add((i, i))
    for i, p in items[10:20]:  # reordered parts
        rows.append((i, p[20:] + noise() + p[10:20] + noise() + p[:10]))
        want.add((i, i))
    for i, p in items[20:]:  # half a passage
        rows.append((i, noise() + p[:20] + noise()))
    docs = [(i, " ".join(w).title(), "x") for i, w in rows] + [(100, None, "x"), (101, "", "x"), (0, " ".join(rows[0][1]), "x"), (102, "w1 " * 100_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, coverage string")
    bench = [(i, ", ".join(w)) for i, w in items] + [(200, None), (201, ""), (202, "w1 w2"), (None, "none here at all ever")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    pairs = decontam.contaminated_pairs(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in pairs} == want and len(pairs) == len(want) + 1
    assert all(r["coverage"] == 1.0 for r in pairs)
    small = decontam.contaminated_pairs(d, b, block_bytes=2000).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, pairs))
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - len(want) - 1
    assert decontam.contaminated_pairs(d.limit(0), b).count() == 0
    assert decontam.clean(d, b.limit(0)).count() == len(docs)


def test_hidden_by_a_changed_word(spark):
    rng = random.Random(9)
    p = passage(rng, 40)
    near = [*p[:13], "changed", *p[14:]]
    d = spark.createDataFrame([(1, " ".join(near))], "doc_id long, text string")
    b = spark.createDataFrame([("a", " ".join(p))], "item_id string, text string")
    r = decontam.contaminated_pairs(d, b).first()
    assert (r["n_tiles"], r["covered_words"]) == (2, 39)


def test_windows_of_any_length_hash_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(1, 4, 300)
    r = decontam.Rolling(x)
    for k in (1, 2, 7, 64, 299):
        seen = {}
        for i, h in enumerate(r.windows(k).tolist()):
            assert seen.setdefault(h, tuple(x[i : i + k])) == tuple(x[i : i + k])
        assert len(seen) == len({tuple(x[i : i + k]) for i in range(len(x) - k + 1)})


def test_repeated_words_take_no_quadratic_time():
    block = decontam.Block([(0, b"a " * 400), (1, b"a " * 30 + b"b " + b"a " * 20), (2, b"c d e f g h " * 50)], 5)
    got = {i: (n, c) for i, n, c, _ in block.matches(b"a " * 1_000_000, 0.8)}
    assert got == {0: (1, 400), 1: (2, 50)}
    got = block.matches(b"c d e f g h " * 100_000 + b"a " * 100_000 + b"b " * 3, 0.8)
    assert [(i, c) for i, _, c, _ in got] == [(0, 400), (1, 51), (2, 300)]


def test_a_hot_text_of_the_benchmark_is_held_once(spark):
    rng = random.Random(10)
    p, q = passage(rng, 40), passage(rng, 4000)
    b = spark.createDataFrame([(i, " ".join(p)) for i in range(500)] + [(500, " ".join(q))], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(["x", *p, "y"])), (2, " ".join(q)), (3, "clean words only, nothing to find here")], "doc_id long, text string")
    pairs = decontam.contaminated_pairs(d, b, block_bytes=1000)
    assert sorted((r["doc_id"], r["item_id"]) for r in pairs.collect()) == [(1, i) for i in range(500)] + [(2, 500)]
    assert [r["doc_id"] for r in decontam.clean(d, b, block_bytes=1000).collect()] == [3]
