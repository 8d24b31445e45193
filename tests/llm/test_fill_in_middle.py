"""Cuts by the skip list against lists of units, and exact restoring."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from vellum.llm import fill_in_middle as M

TEXTS = st.one_of(st.text(max_size=80), st.text(alphabet="abZ é\n😀[`{@<P>S", max_size=400))


def units_of(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def plain(doc, text):
    """The contract over a list of units."""
    units, drawn = units_of(text), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_every_rank_is_found(text):
    units, made = units_of(text), M.SkipList(text)
    assert made.units == len(units)
    assert [made.place(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


def test_lanes_skip_and_carry_both_widths():
    text = "word, é" * 5_000
    made = M.SkipList(text)
    assert len(made.lanes) > 3
    for (units, chars, _), (above, _, _) in zip(made.lanes, made.lanes[1:]):
        assert units.sum() == len(units_of(text)) and chars.sum() == len(text) and len(above) < len(units) / 4


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 1 << 40)), TEXTS)
def test_outputs_are_those_of_the_contract_and_restore(doc, text):
    made = M.transformed(text, doc)
    assert made == plain(doc, text)
    assert M.restored(made[4], made[1]) == text


@pytest.mark.parametrize("text", ["a<", "<P", "S>", "<", "P>x<S", "<<P>", "<M>"])
def test_near_marks(text):
    for doc in range(60):
        made = M.transformed(text, doc)
        assert M.restored(made[4], made[1]) == text


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "a b"), (2, ""), (3, "same one"), (3, "same one"), (4, "a <P> b"), (5, "long text, é\n" * 40_000)]])
def test_table(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string")
    made = sorted((tuple(r) for r in M.filled(docs).collect()), key=repr)
    assert made == sorted(((i, *plain(i, t or ""), t or "") for i, t in rows), key=repr)
