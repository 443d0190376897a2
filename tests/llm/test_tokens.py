import glob
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from awkward_tables import awkward

from rarelabel.llm.token_counts import token_counts
from rarelabel.llm.tokens import ByteIds, PieceCounter

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "\n", "\n\n", " \n a", "a\n b", "a \nb", "<s> </s> <0x0A> <unk>", "▁a ▁▁ b", "<|endoftext|> hi <|endoftext|>",
    "it's  I'm don't 's 's", "tab\tx \t y", "日本 語 テキスト", "a　b c", "\x1c \x1d a", "a   b", "x\x85y \x85 z", "\r\n a\r\n b ", "ﬁ ½ ²", "\x00 a\x00b", "à ́b",
]


def texts():
    r = random.Random(3)
    parts = [" ", "  ", "\n", "a", "b", "é", "'s", "▁", "1", "\t", "the", "ing", "<", ">", "|", " ", "日", "."]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    tables = glob.glob("/root/testdata/sf0.01/documents.parquet")
    return ODD + made + [t for (t,) in (duckdb.sql(f"select text from '{tables[0]}'").fetchall() if tables else [])]


def test_counts_equal_the_library():
    counter = PieceCounter(PIECES)
    assert counter.splits and counter.whole
    all_texts = texts()
    assert counter.counts(all_texts) == [len(ids) for ids in counter.library.encode(all_texts)]
    assert counter.counts([None, ""]) == [0, 0]


def test_whole_tokens_are_one_token_each():
    counter = PieceCounter(PIECES)
    words = list(counter.whole)[::7]
    assert {len(i) for i in counter.library.encode(words)} == {1}


def test_a_model_that_fails_the_proof_counts_whole_texts():
    counter = PieceCounter(PIECES)
    counter.splits = False
    assert counter.counts(ODD) == [len(ids) for ids in counter.library.encode(ODD)]


def test_full_tables_are_emptied(monkeypatch):
    from rarelabel.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 20)
    counter, coder = PieceCounter(PIECES), ByteIds(BYTES)
    all_texts = texts()[:600]
    assert counter.counts(all_texts) == [len(ids) for ids in counter.library.encode(all_texts)]
    assert [coder.ids(t) for t in all_texts] == [np.array(e.ids, "<u4").tobytes() for e in coder.library.encode_batch(all_texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    coder, all_texts = ByteIds(BYTES), texts()
    assert [coder.ids(t) for t in all_texts] == [np.array(e.ids, "<u4").tobytes() for e in coder.library.encode_batch(all_texts, add_special_tokens=False)]


def test_operator(docs):
    rows = awkward()
    library = PieceCounter(PIECES).library
    found = token_counts(docs(rows), PIECES, limit=100).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert token_counts(docs([]), PIECES).collect() == []


@pytest.mark.parametrize("text", ["x" * 200_000, "word " * 50_000])
def test_very_long(text):
    counter = PieceCounter(PIECES)
    assert counter.counts([text]) == [len(counter.library.encode(text))]
