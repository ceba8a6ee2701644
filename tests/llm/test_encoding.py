"""BPE encoding, token counts: against the libraries themselves."""

import hashlib
import random

import pytest
from public_tokenizers import path

from statloom.llm.bpe import decode, decoded_documents, encode
from statloom.llm.token_counts import PieceCounter, token_counts
from tests.llm.conftest import documents, frame, odd_rows

BPE, PIECES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def expected(tokenizer, rows):
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_odd_documents(odd, tokenizer):
    found = [tuple(r) for r in decoded_documents(odd, BPE).collect()]
    assert sorted(found, key=str) == expected(tokenizer, odd_rows())


def test_table(spark, tokenizer):
    rows = documents(spark)
    found = [tuple(r) for r in decoded_documents(frame(spark, rows), BPE).collect()]
    assert sorted(found, key=str) == expected(tokenizer, rows)


def test_round_trip_keeps_texts(odd):
    back = {r.doc_id: r.text for r in decode(encode(odd, BPE), BPE).where("doc_id IS NOT NULL").collect()}
    assert back == {i: t or "" for i, t in odd_rows() if i is not None}


def test_small_blocks_give_the_same(odd, tokenizer, monkeypatch):
    monkeypatch.setattr("statloom.llm.bpe.BLOCK_BYTES", 500)
    monkeypatch.setattr("statloom.llm.bpe.BUCKET_DOCUMENTS", 1)
    found = [tuple(r) for r in decoded_documents(odd, BPE).collect()]
    assert sorted(found, key=str) == expected(tokenizer, odd_rows())


def test_ids_that_are_no_text(spark, tokenizer):
    half = tokenizer.token_to_id("Ã")  # stands for a byte that begins a letter
    lists = {1: [50256, 220, 50256], 2: [], 3: [half, half, 220]}
    encoded = spark.createDataFrame(list(lists.items()), "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in decode(encoded, BPE).collect()}
    assert texts == {i: tokenizer.decode(ids, skip_special_tokens=False) for i, ids in lists.items()}
    assert texts[1] == "<|endoftext|> <|endoftext|>" and "�" in texts[3]


def test_empty_table(nothing):
    assert decoded_documents(nothing, BPE).collect() == [] and token_counts(nothing, PIECES).collect() == []


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_token_counts(odd, spark, pieces):
    rows = odd_rows() + documents(spark)
    found = [tuple(r) for r in token_counts(frame(spark, rows), PIECES).collect()]
    wanted = []
    for doc_id, text in rows:
        n = len(pieces.encode(text or ""))
        wanted.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_merges_on_random_strings(pieces, monkeypatch):
    monkeypatch.setattr("statloom.llm.token_counts.REMEMBERED", 50)
    own, r = PieceCounter(PIECES), random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice("aeinorst ▁\n.,é日😀0<>/") for _ in range(r.randint(0, 60)))
        assert own.count(text) == len(pieces.encode(text)), repr(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 999, "ab" * 2000 + "é" * 100, "▁▁ ▁ x"])
def test_long_runs(pieces, text):
    assert PieceCounter(PIECES).count(text) == len(pieces.encode(text))
