import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, toxicity

WORDS = ["idiot", "stupid", "table", "river", "house", "green", "paper", "water", "little", "morning", "the", "and", "garden", "window"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(4000))
    return toxicity.char_model(np.bincount(toxicity.gram_counts(toxicity.fold(text)), minlength=toxicity.N**4).astype(float))


def test_char_model_sums_to_one(model):
    assert np.exp(model).reshape(-1, toxicity.N).sum(axis=1) == pytest.approx(1.0)


def brute(span, model):
    """The best reading by trying all paths through the lattice."""

    def paths(i):
        run = len(span[i:]) - len(span[i:].lstrip(span[i : i + 1])) if i < len(span) else 0
        if i == len(span):
            yield (), 0.0
        else:
            for took, letters, cost in toxicity.arcs(span, i, run):
                for rest, more in paths(i + took):
                    yield letters + rest, cost + more

    best = None
    for letters, cost in paths(0):
        ctx, s, out = 0, -cost, ""
        for c in (*letters, 0):
            if c == 0 and ctx % toxicity.N == 0:
                continue
            s += model[ctx * toxicity.N + c]
            ctx = (ctx * toxicity.N + c) % toxicity.N**3
            out += " " if c == 0 else toxicity.LETTERS[c - 1]
        if best is None or s > best[0] + 1e-9:
            best = (s, out.strip())
    return best[1]


def test_viterbi_is_exact(model):
    for span in map(bytes, itertools.product(b"i1d0$ s", repeat=4)):
        assert toxicity.viterbi(span, model) == brute(span, model), span


@pytest.mark.parametrize("hidden", ["1d10t", "i d i o t", "i.d.i.o.t", "idi0t", "1diiiiot", "i-d-1-0-t", "id!ot"])
def test_hidden_words_are_found(model, hidden):
    words = toxicity.Decoder(model).restored(f"the {hidden} and the garden")
    assert words["idiot"] == 1 and words["garden"] == 1


@pytest.mark.parametrize("clean", ["THE GARDEN!!", "from*** the### river$$$", "water, paper; the (green) house.", "", "12 345", "...", "***"])
def test_clean_text_has_no_spans(clean):
    assert list(toxicity.suspicious_spans(toxicity.fold(clean.lower()))) == []


def test_very_long_spans(model):
    assert len(list(toxicity.suspicious_spans(b"a1" * 50_000))) == 1
    toxicity.Decoder(model).restored("a1" * 2000 + " " + "x " * 2000 + "é" * 50_000)


@pytest.mark.parametrize("before", [1, 41, 42, 43, 500])
def test_hidden_words_anywhere_in_a_long_span(model, before):
    span = "river-" * before + "1d10t-" + "water-" * 40 + "house"
    assert toxicity.Decoder(model).restored(span)["idiot"] == 1


def test_time_grows_with_the_span(model):
    for text in ("x1" + "!" * 200_000 + "a", "a" + "-" * 200_000 + "b1d", "1d" + "@" * 100_000, "*" * 100_000 + "st*pid"):
        toxicity.Decoder(model).restored(text)


def test_logistic_meets_its_optimum():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((200, 12)) < 0.3, rng.random((200, 12)), 0.0)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ rng.normal(0, 3, 12) - 0.5)))).astype(float)
    at, cols = np.nonzero(x)
    w, bias = toxicity.logistic(at, cols, x[at, cols], y, 12)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert x.T @ (p - y) + 0.02 * w == pytest.approx(np.zeros(12), abs=1e-6) and (p - y).sum() == pytest.approx(0, abs=1e-4)


def test_scores(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(WORDS[2:]) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["idiot", "1d10t", "i d i o t", "stup1d", "stupid", "st*pid"])
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "a"), (1001, "", "a"), (1001, "", "a"), (None, "idiot " * 2000, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxicity string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab, usable=~toxicity.held_out())
    out = toxicity.score(d, model)
    assert out.columns == ["doc_id", "text", "toxicity"]
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r["toxicity"] <= 1 for r in got)
    by = {r["doc_id"]: r["toxicity"] for r in got}
    assert all((by[i] >= 0.5) == bool(y) for i, y in labels)
    assert by[1000] < 0.5 and by[1001] < 0.5 and by[None] > 0.5
    decoder = toxicity.Decoder(model.chars)
    for r in got[::17]:
        n, words = {}, decoder.restored(r["text"] or "")
        for word in words.elements():
            for f in (word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)):
                if f in model.vocabulary:
                    n[f] = n.get(f, 0) + 1
        z = model.bias + sum(model.weights[model.vocabulary[f]] * np.log(1 + c) for f, c in n.items()) + (model.weights[-1] * np.log(1 + words.total()) if n else 0)
        assert r["toxicity"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    none = toxicity.fit(d.limit(0), lab.limit(0), usable=F.lit(True))
    assert toxicity.score(d.limit(0), none).count() == 0
    assert toxicity.score(d, none).agg(F.max("toxicity")).first()[0] < 0.01


def test_held_out_rows_are_told_apart(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    clean = got[got["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.97
    assert got[got["toxic"] == 1]["score"].mean() > clean["score"].mean() + 0.1
