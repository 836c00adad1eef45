"""Toxicity scoring behind a noisy-channel decoder.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``), masking
(``st*pid``) and repetition (``looooser``).  Each suspicious span becomes a
lattice of the letters it may stand for; an exact Viterbi search under a
character 4-gram model finds the likeliest reading, and a classifier scores the
restored text.

The 4-gram counts come from every document of the input.  They are summed per
task into a table over a fixed alphabet of 27 symbols, so what reaches the
driver is bounded by 27**4 counts however large the corpus is.  The classifier
(a logistic regression over all words and word beginnings that stand significantly
more often beside label 1) is fitted on at most ``max_rows`` labelled rows; which
ones depends only on a hash of their ids.  Spans are decoded whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import col, cut_lineage, free_name, id_bucket

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What a sign may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Latin-1 letters with marks, and the plain letters they are read as (fixed values).
MARKED = {"àáâãäåæ": "a", "ç": "c", "èéêë": "e", "ìíîï": "i", "ñ": "n", "òóôõöø": "o", "ùúûü": "u", "ýÿ": "y", "ß": "s"}

N = len(LETTERS) + 1  # the letters and, as 0, anything between words
#: Channel costs in nats.
SUBSTITUTE, MASK, KEEP_SIGN, DROP_SIGN, SQUEEZE, UNDOUBLE, JOIN = 0.5, 1.0, 2.0, 1.5, 0.3, 2.5, 0.2

_FOLD = bytearray(range(256))
_CODE = np.zeros(256, np.int64)
for _marked, _plain in MARKED.items():
    for _c in _marked.encode("latin-1"):
        _FOLD[_c] = ord(_plain)
for _i, _c in enumerate(LETTERS.encode(), 1):
    _CODE[_c] = _i
_FOLD = bytes(_FOLD)

WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LEET)).encode()
#: A letter beside a sign that can stand for one, or three equal letters.
SUSPECT = re.compile(rb"[a-z][" + _SIGNS + rb"]|[" + _SIGNS + rb"][a-z]|([a-z])\1\1")
#: At least four single characters with one or two separators between each.
SPACED = re.compile(rb"(?<![a-z0-9])(?:[a-z0-9@$!|+*][ ._\-]{1,2}){3,}[a-z0-9@$!|+*](?![a-z0-9])")
BLANK = re.compile(rb"\s")
#: Signs before a token, and (read backwards) after it, that are punctuation or decoration, not letters.
_BEFORE = re.compile(rb"(?:[^a-z0-9@$!|+*]|([@$!|+*])\1+)*")
_AFTER = re.compile(rb"(?:[^a-z0-9@$]|([@$])\1\1+)*")


def fold(lowered: str) -> bytes:
    """One byte a character: marks go, what Latin-1 lacks becomes '?'."""
    return lowered.encode("latin-1", "replace").translate(_FOLD)


# --- the character model -----------------------------------------------------------------


def gram_counts(folded: bytes) -> np.ndarray:
    """Counts of the 4-grams of a folded text; runs of non-letters count as one border."""
    codes = _CODE[np.frombuffer(b" " + folded + b" ", np.uint8)]
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    codes = np.concatenate(([0, 0], codes))
    return ((codes[:-3] * N + codes[1:-2]) * N + codes[2:-1]) * N + codes[3:]


def corpus_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """4-gram counts of all texts, as a table of N**4 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**4, np.int64)
        for batch in batches:
            grams = [gram_counts(fold(x.as_py().decode("utf-8", "replace").lower())) for x in batch.column(0)]
            if grams:
                total += np.bincount(np.concatenate(grams), minlength=N**4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    texts = docs.select(col(text_col).cast("binary").alias("t")).where("t is not null")
    sums = texts.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(N**4)
    table[sums["gram"].to_numpy(np.int64)] = sums["n"].to_numpy()
    return table


def char_model(table: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Log probabilities of the last symbol of each 4-gram, backed off order by order."""
    counts = table.reshape(N, N, N, N)
    model = np.full(N, 1.0 / N)
    for order in (3, 2, 1, 0):
        c = counts.sum(axis=tuple(range(order))) if order else counts
        model = (c + strength * model) / (c.sum(axis=-1, keepdims=True) + strength)
    return np.log(model).reshape(-1)


# --- decoding ----------------------------------------------------------------------------


def run_lengths(span: bytes) -> list[int]:
    """How many equal characters begin at each place."""
    out = [1] * len(span)
    for i in range(len(span) - 2, -1, -1):
        if span[i] == span[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def arcs(span: bytes, i: int, run: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
    """Readings that start at character ``i``, of which ``run`` equal ones stand there: characters taken, letter codes (0: border), cost."""
    c = chr(span[i])
    if code := int(_CODE[span[i]]):
        if run == 1:
            yield 1, (code,), 0.0
        else:
            yield run, (code,), UNDOUBLE if run == 2 else SQUEEZE
            yield run, (code, code), 0.0 if run == 2 else SQUEEZE
    elif c in LEET and not (c == "*" and run > 2):
        cost = MASK if c == "*" else SUBSTITUTE
        for letter in LEET[c]:
            yield 1, (ord(letter) - 96,), cost
        if run > 1:
            for letter in LEET[c] if c != "*" else "":
                yield run, (ord(letter) - 96,), cost + SQUEEZE
        yield 1, (0,), KEEP_SIGN
        yield 1, (), DROP_SIGN
    else:
        yield run, (0,), 0.0
        yield run, (), JOIN


def viterbi(span: bytes, model: np.ndarray) -> str:
    """The likeliest reading of a folded span, its words separated by blanks.

    Exact: a state is the position and the last three symbols.  Time and memory grow
    with the span; states that nothing leads on from are dropped.
    """
    layers: list[dict[int, tuple[float, tuple | None]]] = [{} for _ in range(len(span) + 1)]
    layers[0][0] = (0.0, None)
    runs = run_lengths(span)
    for i in range(len(span)):
        if not layers[i]:
            continue
        steps = list(arcs(span, i, runs[i]))
        for context, (score, path) in layers[i].items():
            for took, letters, cost in steps:
                ctx, s, p = context, score - cost, path
                for code in letters:
                    if code == 0 and ctx % N == 0:
                        continue
                    gram = ctx * N + code
                    s += model[gram]
                    ctx, p = gram % (N**3), (code, p)
                seen = layers[i + took].get(ctx)
                if seen is None or s > seen[0]:
                    layers[i + took][ctx] = (s, p)
        layers[i] = {}
    best, ends = None, layers[len(span)]
    for ctx in sorted(ends):
        s, p = ends[ctx]
        s += model[ctx * N] if ctx % N else 0.0
        if best is None or s > best[0]:
            best = (s, p)
    out, p = [], best[1]
    while p:
        out.append(" " if p[0] == 0 else LETTERS[p[0] - 1])
        p = p[1]
    return "".join(reversed(out)).strip()


def suspicious_spans(folded: bytes) -> Iterator[bytes]:
    """Spaced-out spans, and tokens in which signs or runs may hide letters."""
    for m in SPACED.finditer(folded):
        yield m.group()
    done = 0
    for m in SUSPECT.finditer(folded):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not folded[start - 1 : start].isspace():
            start -= 1
        end = BLANK.search(folded, m.end())
        done = end.start() if end else len(folded)
        core = folded[start:done]
        core = core[_BEFORE.match(core).end() :]
        core = core[: len(core) - _AFTER.match(core[::-1]).end()]
        if SUSPECT.search(core):
            yield core


@dataclass
class Decoder:
    """Decodes spans under one model; readings are kept for short spans seen before."""

    model: np.ndarray
    keep: int = 100_000
    keep_chars: int = 64

    def __post_init__(self):
        self._known: dict[bytes, tuple[str, ...]] = {}

    def words(self, span: bytes) -> tuple[str, ...]:
        known = self._known.get(span)
        if known is None:
            known = tuple(viterbi(span, self.model).split())
            if len(span) <= self.keep_chars:
                if len(self._known) >= self.keep:
                    self._known.clear()
                self._known[span] = known
        return known

    def restored(self, text: str) -> Counter:
        """Counts of the words of a text, hidden ones included."""
        lowered = text.lower()
        words = Counter(WORD.findall(lowered))
        for span in suspicious_spans(fold(lowered)):
            words.update(self.words(span))
        return words


# --- the classifier ----------------------------------------------------------------------

PREFIXES = (4, 5, 6)
#: The labelled sample is decoded in so many tasks.
_TRAINING_TASKS = 32


def features(word: str) -> Iterator[str]:
    """A word counts as itself and by its first letters."""
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + "-"


@dataclass
class Model:
    """All that scoring needs: the character model, the chosen features, their weights."""

    chars: np.ndarray
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, x: dict[int, int], n_words: int) -> float:
        # the length only puts hits into proportion: a text without any is not judged by it
        z = self.bias + (self.weights[-1] * np.log1p(n_words) if x else 0.0) + sum(self.weights[i] * np.log1p(n) for i, n in x.items())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _hits(words: Counter, vocabulary: dict[str, int], known: dict[str, tuple[int, ...]]) -> dict[int, int]:
    found: dict[int, int] = {}
    for word, n in words.items():
        ids = known.get(word)
        if ids is None:
            ids = tuple(vocabulary[f] for f in features(word) if f in vocabulary)
            if len(known) < 500_000:
                known[word] = ids
        for i in ids:
            found[i] = found.get(i, 0) + n
    return found


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression of ``width`` sparse columns, entries (rows, cols, values), by Newton's method.

    Steps are solved by conjugate gradients, so no matrix of features is ever formed.
    """
    n = len(y)

    def times(w):
        return np.bincount(rows, values * w[cols], n) + w[-1]

    def back(r):
        return np.append(np.bincount(cols, values * r[rows], width), r.sum())

    w, ridge = np.zeros(width + 1), np.append(np.full(width, l2), 1e-6)

    def loss(w):
        z = times(w)
        return (np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(times(w), -30, 30)))
        grad, weight = back(p - y) + ridge * w, p * (1 - p) + 1e-9
        scale = 1.0 / (np.append(np.bincount(cols, values * values * weight[rows], width), weight.sum()) + ridge)
        step, r = np.zeros(width + 1), grad.copy()
        z = scale * r
        d, rz = z.copy(), r @ z
        for _ in range(4 * (width + 1)):
            if rz <= 1e-20 * max(1.0, grad @ grad):
                break
            h = back(weight * times(d)) + ridge * d
            a = rz / (d @ h)
            step += a * d
            r -= a * h
            z = scale * r
            rz, old = r @ z, rz
            d = z + rz / old * d
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if np.abs(step).max() < 1e-8 or before - now < 1e-12 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def training_rows(labels: DataFrame, label_col: str, usable: Column, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` labelled ids, picked by a hash of the id; one row an id, the higher label wins."""
    rows = labels.where(usable & col(label_col).isNotNull() & col(id_col).isNotNull())
    rows = rows.groupBy(col(id_col).alias("id")).agg(F.max(col(label_col).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, *, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000, min_g2: float = 15.0) -> Model:
    """Count characters over all of ``docs``, then fit the classifier on labelled rows.

    ``max_rows`` bounds the labelled sample: one row an id, that with the least text
    where rows of ``docs`` share an id.  Words and beginnings are used whose log
    likelihood ratio against the label is above ``min_g2``, however many they are.
    Without labels of both kinds every score is the share of label 1 (0 if there are
    no labels at all).  Null texts count as empty; rows without an id are not learned from.
    """
    spark = docs.sparkSession
    chars = char_model(corpus_grams(docs, text_col))
    shared = spark.sparkContext.broadcast(chars)
    sample = F.broadcast(training_rows(labels, label_col, usable, max_rows, id_col))
    met = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias("t")).join(sample, "id")
    rows = cut_lineage(met.groupBy("id", "y").agg(F.min("t").alias("t")).select("t", "y").repartition(_TRAINING_TASKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, seen = Decoder(shared.value), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = decoder.restored(t.decode("utf-8", "replace"))
                seen.update((f, y) for f in {f for w in words for f in features(w)})
        # what is in one document of this task only can still add up elsewhere, so all goes out
        names, ys = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["f", "y", "n"])

    one = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    per = rows.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(one.alias("a"), (F.sum("n") - one).alias("b"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    pos, neg = int(totals["p"]), int(totals["n"] - totals["p"])
    if not pos or not neg:
        share = min(max(pos / max(pos + neg, 1), 1e-6), 1 - 1e-6)
        return Model(chars, {}, np.zeros(1), float(np.log(share / (1 - share))))

    def g2(k: Column, total: int) -> Column:
        return F.when(k > 0, k * F.log(k * (pos + neg) / ((F.col("a") + F.col("b")) * total))).otherwise(0.0)

    chosen = per.withColumn("g", 2 * (g2(F.col("a"), pos) + g2(F.col("b"), neg))).where((F.col("g") > min_g2) & (F.col("a") * neg > F.col("b") * pos))
    vocabulary = {f: i for i, f in enumerate(sorted(r["f"] for r in chosen.select("f").collect()))}
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(shared.value), {}
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                words = decoder.restored(t.decode("utf-8", "replace"))
                x = _hits(words, shared_vocabulary.value, known)
                out.append(x | {len(shared_vocabulary.value): words.total()} if x else x)
            yield pa.RecordBatch.from_arrays([pa.array([sorted(x) for x in out], pa.list_(pa.int32())), pa.array([[x[i] for i in sorted(x)] for x in out], pa.list_(pa.int64())), batch.column(1)], names=["i", "n", "y"])

    got = sorted((r["y"], r["i"], r["n"]) for r in rows.mapInArrow(hits, "i array<int>, n array<long>, y int").collect())
    at = np.repeat(np.arange(len(got)), [len(i) for _, i, _ in got])
    cols = np.array([i for _, x, _ in got for i in x], np.int64)
    values = np.log1p(np.array([n for _, _, x in got for n in x], float))
    weights, bias = logistic(at, cols, values, np.array([y for y, *_ in got], float), len(vocabulary) + 1)
    return Model(chars, vocabulary, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Add the probability of label 1 to every row; nulls and empty texts are scored as no words.

    A score depends on the text alone, so repeated rows score alike.  An input column
    of the score's name is replaced, all others pass through.
    """
    df = docs.select(*[col(c) for c in docs.columns if c != score_col])
    carried = df.select("*", F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias(free_name(df, "__text")))
    shared, names = df.sparkSession.sparkContext.broadcast(model), [*df.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        decoder, known = Decoder(m.chars), {}
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                words = decoder.restored(t.as_py().decode("utf-8", "replace"))
                out.append(m.score(_hits(words, m.vocabulary, known), words.total()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=names)

    return carried.mapInArrow(run, StructType([*df.schema.fields, StructField(score_col, DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return id_bucket(col(id_col), folds) == fold
