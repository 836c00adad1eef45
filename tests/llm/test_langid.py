from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid, queries
from graphloom.llm.common import id_bucket

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba", "c"]


def brute(word, probs, pieces):
    """Sum over all segmentations."""
    number = {p: i for i, p in enumerate(pieces)}
    text = "▁" + word

    def total(i):
        if i == len(text):
            return np.ones(probs.shape[1])
        out = np.zeros(probs.shape[1])
        for j in range(i + 1, len(text) + 1):
            part = text[i:j]
            if part in number:
                out = out + probs[number[part]] * total(j)
            elif j == i + 1:
                out = out + probs[-1] * total(j)
        return out

    return total(0)


WORDS = ["a", "b", "ab", "aba", "abab", "bcab", "xay", "cccc", "abababab"]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    probs = rng.dirichlet(np.ones(len(PIECES) + 1), 2).T
    got = langid.forward(langid.PieceIndex(PIECES), WORDS, probs)
    assert got == pytest.approx(np.log([brute(w, probs, PIECES) for w in WORDS]))


def test_expected_counts_are_derivatives():
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(len(PIECES) + 1))
    index, counts = langid.PieceIndex(PIECES), np.arange(1, len(WORDS) + 1)[:, None]
    got = langid.expected_counts(index, WORDS, counts, p)[:, 0]
    for i in range(len(p)):
        up = p.copy()
        up[i] *= 1 + 1e-6
        slope = (langid.forward(index, WORDS, up[:, None]) - langid.forward(index, WORDS, p[:, None]))[:, 0] / 1e-6
        assert got[i] == pytest.approx((slope * counts[:, 0]).sum(), rel=1e-3, abs=1e-4)


def test_words_of_any_length_in_any_script():
    rng = np.random.default_rng(5)
    probs = rng.dirichlet(np.ones(len(PIECES) + 1), 2).T
    index = langid.PieceIndex(PIECES)
    for word in ("ab" * 20, "abc" * 40 + "x" * 33, "天" * 100, "b" * 700):
        exact = [_exact(word, probs[:, g]) for g in (0, 1)]
        assert langid.forward(index, ["a", word, "ab"], probs)[1] == pytest.approx(exact)
    tiny = langid.smoothed(np.array([[1e9], *[[0.0]] * len(PIECES)]), 1e-12)
    long = ["天" * n for n in (30, 64, 1000, 100_000)]
    got = langid.forward(index, long, np.hstack([tiny, tiny]))
    assert np.isfinite(got).all() and got[0, 0] == pytest.approx(_exact(long[0], tiny[:, 0]))
    counts = langid.expected_counts(index, long, np.ones((4, 1), int), tiny[:, 0])
    assert np.isfinite(counts).all() and counts[-1, 0] == pytest.approx(sum(map(len, long)))


def _exact(word, p):
    """Log of the sum over all segmentations, in exact fractions."""
    number, text = {x: i for i, x in enumerate(PIECES)}, "▁" + word
    p = [Fraction(x) for x in p]
    alpha = [Fraction(1)]
    for end in range(1, len(text) + 1):
        total = Fraction(0)
        for start in range(max(0, end - 3), end):
            part = text[start:end]
            if part in number or len(part) == 1:
                total += alpha[start] * p[number.get(part, -1)]
        alpha.append(total)
    a = alpha[-1]
    shift = a.numerator.bit_length() - a.denominator.bit_length()
    return float(np.log(float(a / Fraction(2) ** shift))) + shift * float(np.log(2))


def test_words_keep_their_marks():
    assert langid.words_of("हिन्दी भाषा, ŠKODA e\u0301te\u0301 2x²") == ["हिन्दी", "भाषा", "škoda", "e\u0301te\u0301", "x²"]


def test_unknown_scripts_leave_the_model_whole(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-k, c * n, lang) for k, (c, n, lang) in enumerate([("天", 32, "en"), ("ก", 100_000, "de"), ("ა", 300, "xx"), ("", 0, "yy")], 1)], docs.schema)
    pieces = langid.vocabulary_pieces(queries.tokenizer_path(queries.PIECES))
    model = langid.fit(docs.union(odd), pieces, usable=F.lit(True))
    assert np.isfinite(model.probs).all() and (model.probs > 0).all()
    got = langid.predict(docs.union(odd), model).toPandas()
    assert got["lang_score"].between(0, 1).all()
    known = got[(got["doc_id"] >= 0) & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.98
    with pytest.raises(ValueError):
        many = spark.range(langid.MAX_LANGUAGES + 1).select(F.col("id").cast("string").alias("lang"), F.lit("a").alias("text"))
        langid.fit(many, pieces, usable=F.lit(True))


def test_index_finds_exactly_the_vocabulary():
    pieces = langid.vocabulary_pieces(queries.tokenizer_path(queries.PIECES))
    index = langid.PieceIndex(pieces)
    h = np.array([langid.PieceIndex.hash_of(p) for p in pieces], np.uint64)
    assert (index.find(h) == np.arange(len(pieces))).all()
    other = np.array([langid.PieceIndex.hash_of(x) for x in {p + "zq" for p in pieces} - set(pieces)], np.uint64)
    begun = {q[:k] for q in pieces for k in range(1, len(q))}
    assert not {p + "zq" for p in pieces} & begun
    assert (index.find(other) < 0).all()
    inner = np.array([langid.PieceIndex.hash_of(p) for p in begun - set(pieces)], np.uint64)
    assert (index.find(inner) == -2).all()


def test_held_out_accuracy_and_odd_rows(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 ... !", "de"), (-3, "123 ... !", "de"), (-4, "x" * 100_000, None), (None, "the of and", None)], "doc_id long, text string, lang string")
    pieces = langid.vocabulary_pieces(queries.tokenizer_path(queries.PIECES))
    held = id_bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, pieces, usable=~held)
    out = langid.predict(docs.union(odd).withColumn("lang_score", F.lit("clash")), model).withColumn("held", held)
    got = out.toPandas()
    assert len(got) == docs.count() + 6 and got["lang_score"].between(0, 1).all()
    test = got[got["held"] & (got["doc_id"] >= 0)]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.98
    assert set(got[got["doc_id"].isin([-1, -2, -3])]["lang_pred"]) == {"und"}
    none = langid.fit(docs.limit(0), pieces, usable=F.lit(True))
    assert set(langid.predict(odd, none).toPandas()["lang_pred"]) == {"und"}
