import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import line_dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def within(a, b, edits):
    """Whether ``edits`` edits are enough, by trying each kind where the strings first differ."""
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b) <= edits
    return edits > 0 and any(within(x, y, edits - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abé")
        elif kind == 1:
            s.insert(at, rng.choice("abé"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    rng, pairs = random.Random(edits), []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 20)))
        b = edited(rng, a, rng.randrange(edits + 3))
        if a and b and abs(len(a) - len(b)) <= edits:
            pairs.append((max(a, b, key=len), min(a, b, key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.edit_distance("a", "b", edits).alias("d")).collect():
        want = levenshtein(r["a"], r["b"])
        assert r["d"] == want if want <= edits else r["d"] > edits, r


def test_pairs_within_the_edits_share_a_key(spark):
    rng, pairs = random.Random(4), []
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 30)))
        b = edited(rng, a, rng.randrange(3))
        if len(b) >= 6 and levenshtein(a, b) <= 2:
            pairs.append((max(a, b, key=len), min(a, b, key=len)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("n", F.char_length("a")).withColumn("m", F.char_length("b"))
    met = df.select(F.expr(f"arrays_overlap({line_dedup.probe_keys('a', 'n', 2)}, {line_dedup.index_keys('b', 'm', 2)})").alias("met"))
    assert met.where("not met").isEmpty()


@settings(max_examples=50, deadline=None)
@given(st.integers(24, 400))
def test_segments_cover_the_line(n):
    spans = [(eval(s.replace("div", "//").replace("greatest", "max")), eval(q.replace("div", "//").replace("if(", "(lambda c, a, b: a if c else b)("))) for s, q in line_dedup.segment_bounds(str(n))]
    assert [s for s, _ in spans] == [0, *[s + q for s, q in spans]][:-1] and spans[-1][0] + spans[-1][1] == n


def edits_of(n):
    return 2 if n >= line_dedup.MIN_CHARS else 1 if n >= line_dedup.MIN_CHARS // 2 else 0


def brute(rows):
    """Dropped line numbers of each row; of rows equal in id and text the first is the earliest."""
    order = sorted((i is None, i or 0, t, number) for number, (i, t) in enumerate(rows) if t is not None)
    first, seen = {}, []
    for rank, (_, _, t, number) in enumerate(order):
        for k, line in enumerate(t.split("\n")):
            if line.strip(" \t\n\v\f\r"):
                seen.append((number, (rank, k), line))
                first.setdefault(line, (rank, k))
    # distinct texts of one id are ordered by a hash in the operator, so tests avoid shared lines there
    near = set()
    for a in first:
        for b in first:
            t = edits_of(len(a))
            if a != b and t and t == edits_of(len(b)) and abs(len(a) - len(b)) <= t and first[b] < first[a] and within(a, b, t):
                near.add(a)
                break
    out = [[] for _ in rows]
    for number, place, line in seen:
        if line in near or first[line] != place:
            out[number].append(place[1])
    return out


def corpus():
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(10, 60))).strip() or "x"
    pool = [line() for _ in range(40)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(rng.randrange(1, 7)):
            base = rng.choice(pool) if rng.random() < 0.6 else line()
            ls.append(edited(rng, base, rng.choice([0, 0, 1, 2, 3])))
        rows.append((i, "\n".join(ls)))
    hot = "the very same line that stands in every document of all"
    rows += [(100 + i, hot + "\n" + line()) for i in range(40)]
    short = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14)))
    rows += [(200 + i, "\n".join(short() for _ in range(3))) for i in range(30)] + [(300 + i, f"a long row of a table, number {i // 7 * 13} of many others") for i in range(30)]
    rows += [(400, "}\n\t\n \n}\nend"), (401, "}\nend\n\n"), (402, "a row that stands twice"), (402, "a row that stands twice"), (402, "a row that stands twice")]
    rows += [(500, None), (501, ""), (502, "\n\n"), (5, rows[5][1]), (None, "a line of a document without an id\n" + hot), (503, "z" * 90_000 + "\n" + "z" * 90_001)]
    return rows


@pytest.mark.parametrize(("hot_key", "part"), [(line_dedup.HOT_KEY, line_dedup.HOT_PART), (1, 2)])
def test_documents(spark, monkeypatch, hot_key, part):
    monkeypatch.setattr(line_dedup, "HOT_KEY", hot_key)
    monkeypatch.setattr(line_dedup, "HOT_PART", part)
    rows = corpus()
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dropped string")
    want = brute(rows)
    got = sorted(((r["doc_id"], r["n_lines"], r["dropped"]) for r in line_dedup.decide(d).collect()), key=str)
    assert got == sorted(((i, 0 if t is None else t.count("\n") + 1, w) for (i, t), w in zip(rows, want, strict=True)), key=str)
    assert sum(map(len, want)) > 50
    clean = line_dedup.deduplicate(d)
    assert clean.columns == d.columns
    kept = sorted((r["doc_id"], r["text"]) for r in clean.where("doc_id is not null").collect() if r["text"] is not None)
    assert kept == sorted((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in w)) for (i, t), w in zip(rows, want, strict=True) if t is not None and i is not None)
    assert line_dedup.decide(d.limit(0)).count() == 0 and line_dedup.deduplicate(d.limit(0)).count() == 0
