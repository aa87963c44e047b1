"""Byte-level BPE in chunks against the library on whole texts."""

import base64
import hashlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from tidewater.llm import byte_bpe

SCHEMA = "doc_id long, text string, row long, token_ids string, seq long"


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = np.random.default_rng(3)
    bits = ["word", " it's", " we'll", "\n\n", "   ", " 1234", "é", " naïve", "日本語", "😀", "...", "'s", " 'tis", "\t", " 　", "a" * 40, " " * 50, "x\n" * 7, " ", "!?", "é"]
    mixed = ["".join(r.choice(bits, int(n))) for n in r.integers(1, 400, 60)]
    return [None, "", " ", "\n", "a", "a" * 500, " " * 500 + "x", " " * 500, "<|endoftext|>", "ab " * 300, "''s" * 120, *mixed, mixed[0], mixed[0]]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (40, 39), (1 << 16, 1 << 10)])
def test_against_whole_texts(spark, library, chunk, overlap):
    rows = [(k if k % 9 else None, t, 5, "clash", 6) for k, t in enumerate(texts())] + [(7, "same", 1, "", 1)] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = byte_bpe.token_digest(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_chunks_resynchronise_where_they_can(spark):
    df = spark.createDataFrame([(1, "one two three " * 200), (2, "a" * 3000)], "doc_id long, text string")
    got = byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=256, overlap=32).collect()
    assert {r["parts"] for r in got if r["doc_id"] == 1} == {11}  # a piece for each chunk
    assert [r["parts"] for r in got if r["doc_id"] == 2] == [1]  # one pre-token, whole


def test_chunks_that_agree_out_of_step_are_not_cut(spark):
    """Inside a bracket longer than several chunks all chunks read single letters, and agree, but the text is one pre-token there."""
    pattern = r"<[^>]*|\s?\w|[^\w<]"
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "the text <" + "there is a bracket " * 30 + "> the end of it" * 9), (2, "no bracket in here " * 40), (3, "<" + "a" * 20 + ">" + "the " * 100)]
    got = byte_bpe.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), pattern, chunk_chars=64, overlap=16).collect()
    for r in got:
        ids = library.encode_ordinary(dict(rows)[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(dict(rows)[r["doc_id"]].encode()).hexdigest()


def test_long_white_space_is_encoded(library):
    coder = byte_bpe.Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "a" + " " * 2_000_000 + "b"
    ids = coder.encode(text)
    assert coder.decode(ids) == text.encode()
    assert list(ids[-1:]) == library.encode_ordinary(" b") and list(ids[:1]) == library.encode_ordinary("a")


def test_empty_table_and_bad_options(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.token_digest(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk_chars=8, overlap=8)
