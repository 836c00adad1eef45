"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is given; each language has a probability
for every piece.  The likelihood of a word under a language is the sum over all
ways to cut it into pieces (forward algorithm), a text's is the product over its
words.  Piece probabilities are expected counts (forward-backward) over every
training document: one task sums them for all its words, so a shuffle carries at
most languages x vocabulary rows a task, which also bounds what the driver gets.

Words are whole runs of letters and the marks on them, lower-cased, of any length.
The dynamic programs go over all distinct words of a batch at once, place by place,
and keep as many columns as the longest piece has symbols.  Beyond ``PLAIN`` places
the columns are rescaled at each, so no product leaves the range of doubles.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import col, free_name

START = "▁"
LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Pieces of more symbols than this are not used: products over so many places stay within doubles.
MAX_PIECE = 16
#: Every symbol of a piece is weighed by this, so that products of common words stay near 1.
SCALE = 24.0
#: Places that need no rescaling: a weight is at least SCALE * LEAST.
PLAIN, LEAST = 16, 1e-15
#: Share of each probability that is spread evenly over the vocabulary and the unknown symbol.
SMOOTHING = 1e-3
#: More languages are refused: every task holds a number for each piece and language.
MAX_LANGUAGES = 1000
#: Symbols of distinct words that one pass of a dynamic program takes (one longer word is a pass by itself).
PASS_SYMBOLS = 1 << 20
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@cache
def _marks() -> tuple[np.ndarray, re.Pattern]:
    """Which characters are combining marks, and the pattern of words that have some."""
    is_mark = np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_mark.astype(np.int8), [0]))))
    ranges = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edges.reshape(-1, 2))
    return is_mark, re.compile(rf"[^\W\d_](?:[^\W\d_]|[{ranges}])*")


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased: whole runs of letters, with the marks that follow them."""
    low = text.lower()
    if not low.isascii() and _marks()[0][_codes(low).astype(np.int64)].any():
        return _marks()[1].findall(low)
    return LETTER_RUN.findall(low)


def _is_bare(piece: str) -> bool:
    return piece == "" or piece == piece.lower() and all(unicodedata.category(c)[0] in "LM" for c in piece)


def vocabulary_pieces(model_path: str) -> list[str]:
    """The usable pieces of a sentencepiece model: letters and marks only, with or without the word-start mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if len(p) <= MAX_PIECE and _is_bare(p.removeprefix(START)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PieceIndex:
    """Finds the number of a piece by a polynomial hash of its characters: -1 if none, -2 for a piece's beginning only."""

    LEVELS = (44, 22)  # which bits of the mixed hash address the first and second table
    BITS = 20

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max((len(p) for p in pieces), default=1)
        if self.longest > MAX_PIECE:
            raise ValueError(f"pieces may have {MAX_PIECE} symbols at most")
        value = {p[:k]: -2 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}
        keys = np.array([self.hash_of(p) for p in value], np.uint64)
        assert len(value) >= len(pieces) and len(np.unique(keys)) == len(keys), "pieces must be distinct"
        self.tables, left = [], np.arange(len(keys))
        for shift in self.LEVELS:
            table = np.full(1 << self.BITS, -1, np.int32)
            slot = self._slot(keys[left], shift)
            table[slot[::-1]] = left[::-1]
            self.tables.append((shift, table))
            left = left[table[slot] != left]
        self.values = np.append(np.fromiter(value.values(), np.int32, len(value)), np.int32(-1))
        self.rest = {int(keys[i]): int(self.values[i]) for i in left}
        self.keys = np.append(keys, np.uint64(0))

    @staticmethod
    def hash_of(text: str) -> np.uint64:
        h, base = 0, int(_BASE)
        for c in text:
            h = (h * base + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h * _MIX) >> np.uint64(shift)).astype(np.int64) & ((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for shift, table in self.tables:
            got = table[self._slot(h, shift)]
            out = np.where((out == -1) & (self.keys[got] == h) & (got >= 0), self.values[got], out)
        for key, i in self.rest.items():
            out[h == np.uint64(key)] = i
        return out


class Lattice:
    """All spans of some words that are pieces, by the place where they end.

    Words are numbered by falling length, so those that reach a place are the first
    ones.  Single symbols always are pieces, as number ``index.size`` if unknown.
    """

    def __init__(self, index: PieceIndex, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.width = int(self.lengths[0])
        self.reach = np.searchsorted(-self.lengths, -np.arange(self.width + 1), "right")  # words with at least so many symbols
        flat = _codes(START + START.join(words[i] for i in self.order))
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        at, h = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        stop = np.repeat(ends, self.lengths)
        word = np.repeat(np.arange(len(words)), self.lengths)
        found = []  # (end, length, word, piece)
        for n in range(1, index.longest + 1):
            h = h * _BASE + flat[at + n - 1]
            piece = index.find(h)
            hit = piece >= 0
            if n == 1:
                piece, hit = np.where(hit, piece, index.size), np.ones(len(at), bool)
                begins = index.find(h) != -1
            else:
                begins = piece != -1
            w = word[at[hit]]
            found.append((at[hit] - starts[w] + n, np.full(len(w), n, np.int8), w, piece[hit]))
            on = begins & (at + n < stop[at])
            at, h = at[on], h[on]
            if not len(at):
                break
        end, length, self.word, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((self.word, length, end))
        end, length, self.word, self.piece = end[by], length[by], self.word[by], self.piece[by].astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], (end[1:] != end[:-1]) | (length[1:] != length[:-1]))))
        self.groups = [(int(end[a]), int(length[a]), a, b) for a, b in zip(cut, [*cut[1:], len(end)], strict=True)]

    def by_end(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(end, [(length, from, to)]) in order; ``word`` and ``piece`` from .. to are the spans."""
        at = 0
        while at < len(self.groups):
            end, spans = self.groups[at][0], []
            while at < len(self.groups) and self.groups[at][0] == end:
                spans.append(self.groups[at][1:])
                at += 1
            yield end, spans


def _passes(words: list[str], weight: int = 1) -> Iterator[np.ndarray]:
    """Numbers of words, cut so that a pass has about PASS_SYMBOLS / weight symbols."""
    size = max(PASS_SYMBOLS // weight, 1)
    part = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from np.split(np.arange(len(words)), cuts)


def forward(index: PieceIndex, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log likelihoods (words x languages); ``probs``: (pieces + 1) x languages, the last row for unknown symbols."""
    out = np.zeros((len(words), probs.shape[1]))
    for part in _passes(words, 1 + probs.shape[1] // 8) if words else ():
        lattice = Lattice(index, [words[i] for i in part])
        n, depth = len(part), index.longest + 1
        ring, log = np.zeros((depth, n, probs.shape[1])), np.zeros((n, probs.shape[1]))
        ring[0] = 1.0
        for end, spans in lattice.by_end():
            m = lattice.reach[end]
            now = ring[end % depth][:m]
            now[:] = 0.0
            for length, a, b in spans:
                w = lattice.word[a:b]
                now[w] += ring[(end - length) % depth][w] * (probs[lattice.piece[a:b]] * SCALE**length)
            if end > PLAIN:
                by = now.copy()
                log[:m] += np.log(by)
                ring[:, :m] /= by
            done = slice(lattice.reach[end + 1] if end < lattice.width else 0, m)
            log[done] += np.log(now[done.start : m]) - lattice.lengths[done, None] * np.log(SCALE)
        out[part[lattice.order]] = log
    return out


def expected_counts(index: PieceIndex, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of words seen ``counts`` (words x languages) times, all cut by ``probs``.

    Going back, a place hands its mass on by the shares that the spans ending there
    had in its forward sum, so the backward pass needs no sums of its own.
    """
    total = np.zeros((index.size + 1, counts.shape[1]))
    for part in _passes(words) if words else ():
        lattice = Lattice(index, [words[i] for i in part])
        n, depth = len(part), index.longest + 1
        ring = np.zeros((depth, n))
        ring[0] = 1.0
        share = np.empty(len(lattice.word))
        steps = list(lattice.by_end())
        for end, spans in steps:
            m = lattice.reach[end]
            now = ring[end % depth][:m]
            now[:] = 0.0
            for length, a, b in spans:
                w = lattice.word[a:b]
                share[a:b] = ring[(end - length) % depth][w] * (probs[lattice.piece[a:b]] * SCALE**length)
                now[w] += share[a:b]
            first, last = spans[0][1], spans[-1][2]
            share[first:last] /= now[lattice.word[first:last]]
            if end > PLAIN:
                ring[:, :m] /= now.copy()
        mass = np.zeros((depth, n))
        for end, spans in reversed(steps):
            m = lattice.reach[end]
            mass[end % depth][lattice.reach[end + 1] if end < lattice.width else 0 : m] = 1.0
            for length, a, b in spans:
                w = lattice.word[a:b]
                share[a:b] *= mass[end % depth][w]
                mass[(end - length) % depth][w] += share[a:b]
            mass[end % depth] = 0.0
        of = counts[part[lattice.order]]
        for g in range(counts.shape[1]):
            total[:, g] += np.bincount(lattice.piece, share * of[lattice.word, g], index.size + 1)
    return total


class Bag:
    """Numbers the distinct words of a batch; ``ids`` turns a text into word numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        put = self.number.setdefault
        return [put(word, len(self.number)) for word in words_of(text)]


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    probs: np.ndarray  # (pieces + 1) x languages
    log_prior: np.ndarray


def smoothed(counts: np.ndarray, share: float = SMOOTHING) -> np.ndarray:
    """Probabilities from the counts of each column, of which ``share`` is spread evenly; all of it if there are none."""
    total = counts.sum(axis=0)
    known = np.divide(counts, total, out=np.full(counts.shape, 1.0 / len(counts)), where=total > 0)
    return np.maximum((1 - share) * known + share / len(counts), LEAST)


def flat_start(pieces: list[str]) -> np.ndarray:
    """First guess: a piece is likelier the longer it is, which favours few long pieces."""
    w = np.array([8.0 ** -max(1, 12 - len(p)) for p in pieces] + [8.0**-12 / 100])
    return np.maximum(w / w.sum(), LEAST)


def fit(docs: DataFrame, pieces: list[str], *, usable: Column, text_col: str = "text", lang_col: str = "lang", rounds: int = 1, smoothing: float = SMOOTHING) -> Model:
    """Expected piece counts of all usable rows with a language, then smoothed probabilities.

    ``rounds`` passes of expectation-maximisation over the corpus; the first cuts
    words by ``flat_start``, later ones by the pooled probabilities.  Null and empty
    texts count for their language's prior only; repeated rows count each; a table
    without usable rows gives a model without languages.  More than MAX_LANGUAGES
    distinct languages raise.
    """
    spark = docs.sparkSession
    rows = docs.where(usable & col(lang_col).isNotNull()).select(col(lang_col).alias("l"), col(text_col).cast("binary").alias("t"))
    seen = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(seen)
    cut = flat_start(pieces)
    probs = np.tile(cut[:, None], (1, max(len(languages), 1)))
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, cut))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, langs, by = shared.value
            ix, at = PieceIndex(names), {x: i for i, x in enumerate(langs)}
            total = np.zeros((ix.size + 1, len(langs)))
            for batch in batches:
                bag, ids, owners = Bag(), [], []
                for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    got = bag.ids((t.as_py() or b"").decode("utf-8", "replace"))
                    ids.append(np.array(got, np.int64))
                    owners.append(np.full(len(got), at[lang], np.int64))
                if bag.number:
                    key = np.concatenate(ids) * len(langs) + np.concatenate(owners)
                    counts = np.bincount(key, minlength=len(bag.number) * len(langs)).reshape(-1, len(langs))
                    total += expected_counts(ix, list(bag.number), counts, by)
            p, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(g, pa.int32()), pa.array(total[p, g])], names=["p", "g", "n"])

        got = rows.mapInArrow(count, "p int, g int, n double").groupBy("p", "g").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(probs)
        total[got["p"].to_numpy(), got["g"].to_numpy()] = got["n"].to_numpy()
        probs, cut = smoothed(total, smoothing), smoothed(total.sum(axis=1)[:, None], smoothing)[:, 0]
    prior = np.array([seen[x] for x in languages], float)
    return Model(pieces, languages, probs, np.log(prior / prior.sum()) if languages else np.zeros(1))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Add the likeliest language of every whole text and its posterior probability.

    Texts that are null or have no letter get ``und`` and 0, as does everything
    when no language was learned.  Ties go to the first language by name; repeated
    rows each keep their row.  Input columns of the two names are replaced, all
    others pass through.  Memory grows with the batch and the longest run of letters.
    """
    df = docs.select(*[col(c) for c in docs.columns if c not in (lang_col, score_col)])
    carried = df.select("*", F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias(free_name(df, "__text")))
    shared, names = df.sparkSession.sparkContext.broadcast(model), [*df.columns, lang_col, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = PieceIndex(m.pieces)
        for batch in batches:
            bag, lang, score = Bag(), [], []
            texts = [bag.ids(t.as_py().decode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1)]
            words = list(bag.number)
            table = forward(index, words, m.probs)
            letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
            for ids in texts:
                at = np.array(ids, np.int64)
                if not m.languages or not len(at) or not letters[at].any():
                    lang.append("und")
                    score.append(0.0)
                    continue
                z = table[at].sum(axis=0) + m.log_prior
                best = int(z.argmax())
                lang.append(m.languages[best])
                score.append(float(1.0 / np.exp(np.minimum(z - z[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return carried.mapInArrow(run, StructType([*df.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))
