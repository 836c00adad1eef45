import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, queries

PATH, PATTERN = queries.tokenizer_path(queries.BPE_RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), PATTERN)


PIECES = st.sampled_from(["a", "B9", " ", "  ", "\n", "\t", "'s", "'", "é", "中文", "🙂", "...", "x y", " z", "<|endoftext|>", "\x1c", " ", "12"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.integers(1, 6))
def test_blocks_encode_as_the_whole(plain, codec, text, size):
    assert "".join(bpe.blocks(text, size)) == text
    ids = codec.encode(text, size)
    assert ids == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_text_without_borders(plain, codec):
    text = "é" * 70_000
    assert codec.encode(text) == plain.encode_ordinary(text)


def test_ids_that_cut_a_character_round_trip(codec):
    ids = codec.encode("🙂")
    assert b"".join(codec.decode([i]) for i in ids) == "🙂".encode()


def test_rows(spark, plain):
    rows = [(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "hello  world's 12\n", None), (None, "é " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, PATH, PATTERN)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t, _ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, t, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    both = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
