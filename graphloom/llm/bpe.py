"""Byte-level BPE encoding and decoding.

The tiktoken library does the merging, from a local rank file whose bytes the
driver reads once and broadcasts (the file's size bounds that).  Long texts are
cut before a separator that follows a letter or digit: no pre-splitting match
spans such a place, so the blocks encode to the same ids as the whole text while
no single call holds a whole book.  Decoding concatenates raw token bytes, so
ids that end inside a character still round-trip.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, free_name

#: A letter or digit, then a blank, line feed or ASCII punctuation: always a border of two matches.
SAFE = re.compile(r"(?<=[A-Za-z0-9])[\x20\n!-/:-@\[-\x60{-~]")
BLOCK_CHARS = 1 << 15

_codecs: dict[tuple[bytes, str], Codec] = {}


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe borders into blocks of at least ``size`` characters."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


class Codec:
    """Encoder and decoder for the contents of one rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token
        self._decimal = [str(i) for i in range(len(self._bytes))]

    def encode(self, text: str, size: int = BLOCK_CHARS) -> list[int]:
        if len(text) <= size:
            return self._encoding.encode_ordinary(text)
        return [i for block in blocks(text, size) for i in self._encoding.encode_ordinary(block)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decimal(self, ids) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this worker process, built once."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _with(df: DataFrame, text_col: str, rank_path: str, pattern: str, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with its text replaced on the way by ``make(codec, text)``'s columns."""
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    kept = [col(c) for c in df.columns if c not in {f.name for f in fields}]
    carried = df.select(*kept, text.alias(free_name(df, "__text")))
    df = df.select(*kept)
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            rows = [make(c, x.as_py().decode("utf-8", "replace")) for x in batch.column(batch.num_columns - 1)]
            arrays = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names, types = schema.fieldNames(), [to_arrow_type(f.dataType) for f in fields]
    return carried.mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Add the array of token ids of every whole text (null and empty texts: no ids)."""
    return _with(df, text_col, rank_path, pattern, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], lambda c, text: (c.encode(text),))


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the raw bytes that an id array stands for (null: null).  Unknown ids raise."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            out = pa.array([None if x is None else c.decode(x) for x in ids], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    df = df.select(*[col(c) for c in df.columns if c != bytes_col])
    at, names = df.columns.index(ids_col), [*df.columns, bytes_col]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again, in one pass.

    Adds ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded bytes).  A null text counts as empty: no
    tokens and the digests of nothing.  Columns of those names that the input
    has are replaced; all other columns pass through, repeated rows included.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(c: Codec, text: str):
        ids = c.encode(text)
        return len(ids), hashlib.sha256(c.decimal(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _with(df, text_col, rank_path, pattern, fields, make)
