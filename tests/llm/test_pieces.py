"""Merge-type pieces by backtracking against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from __spark_entry__ import queries
from episodica.llm import piece_bpe


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.piece_model())


@pytest.fixture(scope="module")
def own():
    return piece_bpe.codec(piece_bpe.piece_model())


def ids(own, text):
    return np.frombuffer(own.encode(text), dtype="<u2").tolist()


PARTS = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "é", "▁", "日", "\U0001d538", "\x00", ".", ",", "</s>", "<0x0A>", "12", "==", "_.", "²."]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_encoding_equals_the_library(lib, own, text):
    text = text.encode("utf-8", "ignore").decode()
    want = lib.encode(text)
    assert ids(own, text) == want
    assert own.decode(want) == lib.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31_999)), max_size=10))
def test_decoding_any_ids_equals_the_library(lib, own, some):
    assert own.decode(some) == lib.decode(some)


def test_decoding_rows_at_once(lib, own):
    rng = random.Random(2)
    for pool in (range(259, 32_000), range(32_000), range(259)):
        rows = [[rng.choice(pool) for _ in range(rng.randint(0, 6))] for _ in range(1500)]
        flat = np.array([i for r in rows for i in r], dtype="<i4")
        assert own.decode_all(flat, np.cumsum([len(r) for r in rows])).to_pylist() == [lib.decode(r) for r in rows]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 5000])
def test_runs_and_long_words(lib, own, n):
    rng = random.Random(n)
    for text in (" " * n, " " * n + "word", "a" * n, "ab" * n, "x" + " " * n + "\n", "".join(rng.choice("abcdeinorst") for _ in range(n))):
        assert ids(own, text) == lib.encode(text)


def test_remembered_words_do_not_change_results(lib, own, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED_WORDS", 3)
    fresh = piece_bpe.PieceCodec(piece_bpe.piece_model())
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7))) + rng.choice(["", ".", ","]) for _ in range(500))
    assert ids(fresh, text) == lib.encode(text) == ids(own, text)
    assert len(fresh.plain) <= 3 and len(fresh.plain.old) <= 3


def test_a_place_that_fails_is_tried_once(own):
    # a word whose longest first piece cannot stay forces a step back
    back = [w for w in ("thatnd", "estion", "llesll", "ciónñ", "thheha", "osllra") if own.pieces(w)[0] != max((p for p in own.ids if w.startswith(p)), key=len)]
    assert back and all(own.pieces(w) == own.merge(w) for w in back)


def test_rows_of_every_kind(llm, lib, messy, messy_rows):
    got = piece_bpe.piece_round_trip(messy, piece_bpe.piece_model()).collect()
    want = sorted((str(r[0]), lib.encode(r[1] or ""), lib.decode(lib.encode(r[1] or ""))) for r in messy_rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want


def test_empty_table_and_columns(llm, empty):
    out = piece_bpe.piece_round_trip(empty, piece_bpe.piece_model())
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        piece_bpe.piece_round_trip(empty.drop("text"), piece_bpe.piece_model())


def test_query_equals_the_library(llm, lib, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op11_piece_bpe"](llm, sf).collect()}
    docs = llm.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        x = lib.encode(d["text"] or "")
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, x)), lib.decode(x))]
        assert got[d["doc_id"]] == (len(x), *sha)
