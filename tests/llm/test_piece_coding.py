"""Backtracking encoder and decoder against the library itself."""

import hashlib
import random

import ahocorasick
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from vellum.llm import piece_coding
from vellum.llm.encoding import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
OWN, LIBRARY = piece_coding.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def agrees(text):
    ids = OWN.encode(text)
    expected = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == expected
    assert OWN.decode(ids) == LIBRARY.decode(expected)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\tthein▁é梦<>0", max_size=80),
                 st.lists(st.sampled_from(["the", " ", "   ", "\n", "ing", "tion", "▁", "aaaa", "😀", "̀", "1999"]), max_size=30).map("".join)))
def test_encodes_and_decodes_as_the_library(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=20))
def test_decodes_any_ids_as_the_library(ids):
    assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_spaces_whose_pieces_are_equally_good():
    for n in range(1, 70):
        agrees(" " * n + "word" + " " * (70 - n))


def test_a_text_without_words_and_one_of_many_chunks(monkeypatch):
    draw = random.Random(3)
    agrees("".join(draw.choice("abcdeinorst") for _ in range(30_000)))
    agrees("a" * 20_000)
    monkeypatch.setattr(piece_coding, "CHUNK", 50)
    agrees("".join(draw.choice(["word", "  ", " a", "\n", "   the"]) for _ in range(2_000)))


def test_failed_places_are_taken_back():
    """A model whose longest first piece leads nowhere: the bitfield closes its end, and the shorter piece is used."""
    own = piece_coding.Pieces(MODEL)
    own.score = {"a": -9, "b": -9, "c": -9, "d": -9, "ab": -3, "bc": -1, "abc": -2, "cd": -0.5}
    own.text = [*own.score]
    own.id = {p: i for i, p in enumerate(own.text)}
    own.chars = set("abcd")
    own.shorter, own.sound, own.pairs = {}, {}, {}
    own.found = ahocorasick.Automaton()
    for piece, at in own.id.items():
        own.found.add_word(piece, (len(piece), at))
    own.found.make_automaton()
    for n in range(500):
        text = "".join(random.Random(n).choice("abcd") for _ in range(n % 12))
        assert [own.text[i] for i in own._known(text)] == own.merged(text), text


def test_memories_are_bounded(monkeypatch):
    own = piece_coding.Pieces(MODEL)
    monkeypatch.setattr(piece_coding, "KEPT_CHARS", 200)
    monkeypatch.setattr(piece_coding, "KEPT_PAIRS", 50)
    for n in range(300):
        text = f"word{n} and {'x' * 100}{n}"
        assert own.encode(text).tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert sum(map(len, own.words)) <= 200 + piece_coding.LONGEST_KEPT and len(own.pairs) <= 51


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "a b"), (2, ""), (3, "same"), (3, "same"), (4, "long  text\n" * 30_000)]])
def test_table(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, decoded string, n_tokens int, ids binary")
    made = sorted(map(tuple, piece_coding.digests(docs, MODEL).collect()), key=repr)
    expected = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert made == sorted(expected, key=repr)
