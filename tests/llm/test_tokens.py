import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import piece_codec
from pulsegrid.llm import token_counts as tc
from pulsegrid.llm.piece_codec import PieceCodec, encode_decode

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n\n\n", "  a  b\n\tc <s> ﬁ Å ▁x", "日本語 テスト🙂🙂", "<|endoftext|> hi<|endoftext|>", "\x1c\x85 a\xa0b", "it's we'll \n  x", "a" * 5000, "<0x0A></s><unk>", "é́ ̀", "x\r\ny"]
library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
codec, counter, tokenizer = PieceCodec(PIECES), tc.Counter(BPE), Tokenizer.from_file(BPE)
texts = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n▁abetion<>|.'s0é")), max_size=60)


def count(text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_as_the_library(text):
    ids = library.encode(text)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_as_the_library(text):
    assert counter.lengths([text]) == [count(text)]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert codec.encode(text) == library.encode(text) and codec.decode(library.encode(text)) == library.decode(library.encode(text))
    assert counter.lengths([text]) == [count(text)]


def test_pieces_of_long_texts_add_up():
    text = "The quick it's brown fox, and  so\non 12 34. " * 300
    parts = list(tc.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 50 and sum(counter.lengths(parts)) == count(text)
    assert list(tc.pieces("", 10)) == [""]


@pytest.mark.parametrize("short", [0, 5, 10_000])
def test_short_and_long_units_have_the_same_ids(monkeypatch, short):
    monkeypatch.setattr(piece_codec, "SHORT", short)
    own = PieceCodec(PIECES)
    for text in ("Thorther onorshon, éonaieaurétre. ENTIING!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a\u4e00\U0001f600b", "x" * 33 + "https://example.com/a?b=c", "  \n\t two  "):
        assert own.encode(text) == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert piece_codec.loaded(PIECES) is piece_codec.loaded(PIECES)


def test_byte_batches_balance():
    runs = list(tc.byte_batches(["x" * n for n in (1, 50, 3, 200, 4, 4)], 60))
    assert [i for r in runs for i in r] == list(range(6)) and runs == [[0, 1, 2, 3], [4, 5]]


def test_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs, BPE, piece_chars=200).collect()}
    assert got == {i: (len(t.encode()), count(t), count(t) > 512) for i, t in raw.items()}
    for r in encode_decode(docs, PIECES).collect():
        ids = library.encode(raw[r.doc_id])
        assert r.ids == ids and r.decoded == library.decode(ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_null_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, tc.token_counts(df, BPE).collect()), key=str) == sorted([(None, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False)], key=str)
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in encode_decode(df, PIECES).filter("doc_id is not null").collect()) == [(1, 0, ""), (1, 0, ""), (2, 0, "")]
    assert tc.token_counts(df.limit(0), BPE).count() == 0 and encode_decode(df.limit(0), PIECES).count() == 0
