import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import words as W
from tests.llm.conftest import lowered, words_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té 1.", max_size=40), max_size=8))
def test_hashes_tell_words_apart(texts):
    known = {}
    for first, found, cuts in W.hashes([t.encode() for t in texts]):
        for i in range(len(cuts) - 1):
            expected = words_of(texts[first + i])
            got = found[cuts[i] : cuts[i + 1]].tolist()
            assert len(got) == len(expected)
            for w, h in zip(expected, got, strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_long_texts_by_segments(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 50)))) for _ in range(300)).encode()
    whole = W.doc_hashes(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        assert np.array_equal(W.doc_hashes(text), whole)
        assert sum(len(f) for _, f, _ in W.hashes([text, b"", text])) == 2 * len(whole)


def test_grams_depend_on_order():
    a = W.doc_hashes(b"a b c a b c")
    g = W.grams(a, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 3
    assert len(W.grams(a, 7)) == 0


def test_lower_case_is_ascii_only():
    assert W.doc_hashes("AÉ".encode(), lower=True)[0] == W.doc_hashes(lowered("AÉ").encode())[0]
