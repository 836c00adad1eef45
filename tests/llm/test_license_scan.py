import random
import re
from collections import Counter

from graphloom.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w, places = words(text), []
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, best = {x for _, x in places}, 1.0 if places else 0.0
    lines = [set(words(line)) for line in (text or "").split("\n")]
    for label, t in ls.TEMPLATES:
        size, t = len(words(t)), set(words(t))
        if len(t & set(w)) < ls.THRESHOLD * len(t) - 1e-9:
            continue
        shared = max(len(t & block) for block in [*lines, *(set(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))])
        if shared >= ls.THRESHOLD * len(t) - 1e-9:
            labels.add(label)
            best = max(best, shared / len(t))
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    pool = [w for _, t in ls.TEMPLATES for w in t.split()] + ["the", "é", "x\ty", "MIT", "CC", "BY", "gnu"]
    texts = [None, "", "\n\n", "MIT License mit license, MIT license", "cc by" * 3, "GNU General\nPublic License", "a" * 100_000, "cc by " * 20_000]
    texts += [t for _, t in ls.TEMPLATES] + [t.upper() for _, t in ls.TEMPLATES]
    for _ in range(150):
        _, t = rng.choice(ls.TEMPLATES)
        w = t.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        rng.shuffle(w) if rng.random() < 0.3 else None
        texts.append(rng.choice(["", "Intro\n"]) + " ".join(w) + rng.choice(["", " tail words", "\nlast"]))
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(1, texts[8], 7)], "doc_id long, text string, score int")
    got = {}
    for r in ls.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in ls.SCAN.fieldNames() if c != "blocks"))
    for i, t in enumerate(texts):
        want = {brute(t)} | ({brute(texts[8])} if i == 1 else set())
        assert set(got[i]) == want, t
    assert len(got[1]) == 2
    assert ls.scan(docs.limit(0)).count() == 0


def test_the_join_does_not_depend_on_the_order():
    vocab = list(ls.build_index(ls.TEMPLATES, {}, ls.THRESHOLD).rank)
    rng = random.Random(6)
    for _ in range(20):
        index = ls.build_index(ls.TEMPLATES, {w: rng.randrange(100) for w in vocab}, ls.THRESHOLD)
        block = index.block(set(rng.sample(vocab, len(vocab) // 2)) | {b"other"})
        found = {t for t, _ in ls.join_block(block, index)}
        assert found == {t for t, s in enumerate(index.sets) if len(set(block) & set(s)) >= index.need[t]}


def test_each_filter_lets_fewer_through():
    index = ls.build_index(ls.TEMPLATES, {}, ls.THRESHOLD)
    vocab, rng, passed, matched = list(index.rank), random.Random(7), Counter(), 0
    for _ in range(400):
        block = index.block(set(rng.sample(vocab, rng.randrange(1, len(vocab)))))
        matched += len(list(ls.join_block(block, index, passed)))
    assert 400 * len(index.sets) > passed["prefix"] > passed["length"] > passed["position"] > matched > 0


def test_templates_have_a_size_bound(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    try:
        ls.scan(docs, templates=[("big", "word " * ls.MAX_TEMPLATE_CHARS)])
    except ValueError:
        return
    raise AssertionError


def test_wrapped_notices_are_found(spark):
    import textwrap

    texts = []
    for _, t in ls.TEMPLATES:
        for width, mark in ((72, ""), (30, "# "), (20, " * ")):
            texts.append("Intro words of a file\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n\nand a tail")
    long = ls.TEMPLATES[5][1]
    wrapped = "\n".join(textwrap.wrap(long, 40))
    texts += [wrapped + "\nbetween\n" * 60 + wrapped, long + "\n" + "x\n" * 60 + wrapped, "permission\n" + "x " * 40 + "\n" + " ".join(long.split()[1:9])]
    got = {r["doc_id"]: r for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert got[i]["labels"] == brute(text)[5] and got[i]["score"] == brute(text)[6]
    for i in range(3 * len(ls.TEMPLATES)):
        label = ls.TEMPLATES[i // 3][0]
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= ls.THRESHOLD, texts[i]
        block = next(b for b in got[i]["blocks"] if b["label"] == label)
        assert 5 <= block["stop"] and block["containment"] >= ls.THRESHOLD
    n = 3 * len(ls.TEMPLATES)
    of = lambda i: [(b["label"], b["start"], b["stop"]) for b in got[i]["blocks"] if b["template"] == 5]
    size = len(words(long))
    assert of(n) == [("mit", 0, size), ("mit", size + 60, 2 * size + 60)]
    assert of(n + 1) == [("mit", 0, size), ("mit", size + 60, 2 * size + 60)]
    assert got[n + 2]["blocks"] == []
