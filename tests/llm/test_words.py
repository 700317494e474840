import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import words as W


def plain(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check(texts, lower):
    seen = {}
    got = dict(W.row_word_hashes(pa.array(texts, pa.string()), lower))
    assert sorted(got) == list(range(len(texts)))
    for r, text in enumerate(texts):
        ws = plain(text, lower)
        assert len(ws) == len(got[r])
        for w, h in zip(ws, got[r], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)


@pytest.mark.parametrize("piece", [7, 50, 1 << 21])
def test_words_do_not_cross_rows_or_pieces(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    check(["a b  c", "", None, "x" * 200 + " y " + "z" * 30, "A a\tB\x0bb\xa0c", " ", "Ärger ärger"] * 3, True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\tü ", max_size=30)), max_size=8), st.booleans())
def test_words_equal_the_pattern(texts, lower):
    check(texts, lower)


def test_shingles_of_short_texts():
    ws = [h for _, h in W.row_word_hashes(pa.array(["a b", "a b c", "", "a b"]))]
    sh = [W.shingle_hashes(w, 3) for w in ws]
    assert [len(x) for x in sh] == [1, 1, 0, 1]
    assert sh[0][0] == sh[3][0] != sh[1][0]
    assert len(np.unique(W.shingle_hashes(ws[1], 1))) == 3
