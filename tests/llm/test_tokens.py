"""Operators 4 and 9 against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from quern.llm import byte_bpe, piece_count
from quern.llm.queries_byte_bpe import RANKS, op4_byte_bpe
from quern.llm.queries_piece_count import MODEL, op9_token_counts

ODD = ["", " ", "  \n\n x", "a" * 3000, "日本語テキスト、😀😀 ok" * 40, "\x00\x01 ▁▁ a▁b", "<s></s> <unk>", "!!!!" * 500, "   " * 300 + "x", "it's we'll x'S"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))


def texts():
    random.seed(3)
    return ODD + ["".join(random.choice("ab \n\t▁é😀.zqx'") for _ in range(random.randint(0, 400))) for _ in range(300)]


def test_bpe_equals_library(tik):
    bpe = byte_bpe.loaded(P.path(RANKS), P.PATTERN)
    got = [[i for part in parts for i in part] for parts in bpe.ids(texts())]
    assert got == [tik.encode_ordinary(t) for t in texts()]
    assert [bpe.decode(g).decode() for g in got] == texts()


LONG = ["a" * 3001, "ab" * 700, "é" * 999, "=" * 2000 + "-" * 777, "日本語テキスト" * 90, "x" * 100_000, "".join(random.Random(1).choice("etaoinshr") for _ in range(20_000))]
LONG += ["".join(random.Random(k).choices("abcde"[: 2 + k % 4], k=300 + 7 * k)) for k in range(60)] + ["\n" * 400 + " " * 700]


@pytest.mark.parametrize("longest", [1, 3, 256])
def test_long_pre_tokens(tik, sp, monkeypatch, longest):
    """Rounds over flat arrays give what the libraries give, for short pre-tokens too."""
    monkeypatch.setattr(byte_bpe, "LONGEST_ROW", longest)
    monkeypatch.setattr(byte_bpe, "_LONG", 5000)
    monkeypatch.setattr(piece_count, "LONGEST_ROW", longest)
    own = LONG + texts()
    bpe = byte_bpe.ByteBPE(P.path(RANKS), P.PATTERN)
    assert [[i for part in parts for i in part] for parts in bpe.ids(own)] == [tik.encode_ordinary(t) for t in own]
    assert piece_count.PieceCounter(P.path(MODEL)).counts(own) == [len(x) for x in sp.encode(own)]
    monkeypatch.setattr(piece_count, "SLICE_CHARS", 100)
    monkeypatch.setattr(piece_count, "SLICE_TOKENS", 7)
    assert piece_count.PieceCounter(P.path(MODEL)).counts(own) == [len(x) for x in sp.encode(own)]


def test_other_models_are_refused():
    piece = lambda number, value: bytes([number << 3 & 127 | 128 * (number > 15)] + [number >> 4] * (number > 15) + [value])
    part = lambda number, data: bytes([number << 3 | 2, len(data)]) + data
    good = part(2, piece(3, 2) + piece(35, 1)) + part(3, piece(4, 0))
    assert piece_count.unsupported(good) is None
    for bad in (b"", part(2, piece(35, 1)), part(2, piece(3, 2)), good + part(3, piece(4, 1)), good + part(3, piece(4, 0) + piece(3, 0)), good + part(3, piece(4, 0) + part(2, b"map"))):
        assert piece_count.unsupported(bad)


def test_bpe_slices_and_small_cache(tik, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "SLICE_TOKENS", 7)
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    bpe = byte_bpe.ByteBPE(P.path(RANKS), P.PATTERN)
    got = [[i for part in parts for i in part] for parts in bpe.ids(texts())]
    assert got == [tik.encode_ordinary(t) for t in texts()]


def test_counts_equal_library(sp, monkeypatch):
    assert piece_count.loaded(P.path(MODEL)).counts(texts()) == [len(x) for x in sp.encode(texts())]
    monkeypatch.setattr(piece_count, "CACHE", 20)
    assert piece_count.PieceCounter(P.path(MODEL)).counts(texts()) == [len(x) for x in sp.encode(texts())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=5))
def test_any_text(sp, tik, own):
    assert piece_count.loaded(P.path(MODEL)).counts(own) == [len(x) for x in sp.encode(own)]
    bpe = byte_bpe.loaded(P.path(RANKS), P.PATTERN)
    assert [[i for part in parts for i in part] for parts in bpe.ids(own)] == [tik.encode_ordinary(t) for t in own]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


def test_queries_on_odd_tables(spark, tmp_path, tik, sp):
    """Null, empty and repeated rows, clashing extra columns, and an empty table."""
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (2, "", None), (3, "é😀" * 50, "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = sorted(map(tuple, op4_byte_bpe(spark, f"{tmp_path}/a").collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = tik.encode_ordinary(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    got = sorted(map(tuple, op9_token_counts(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), len(sp.encode(t or "")), False) for d, t, _ in rows], key=str)
    assert op4_byte_bpe(spark, f"{tmp_path}/b").collect() == op9_token_counts(spark, f"{tmp_path}/b").collect() == []
