import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from plumbline.llm import phrases as P

from .conftest import lowered

SCHEMA = "lang string, text string, words int, phrase string, seed int, n int, word string"


def brute(rows, least, top=None):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, 6):
                f.setdefault(lang, Counter()).update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 1, 1, "c") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["the", "The", "of", "é", "Ünï", "a b", "x", "new", "york", "\x00odd"]
    out = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text + rng.choice(["", "New york  city HALL is open"])))
    return [*out, (None, None), ("en", ""), ("en", " \t\n"), ("de", "alone"), ("en", "same same same same same same")] + [("en", "rare tail here"), ("fr", "same same")] * 12


@pytest.mark.parametrize("least", [3, 12])
def test_against_brute_force(spark, texts, least):
    got = sorted(map(tuple, P.collocations(frame(spark, texts), least, None).collect()))
    assert got == brute(texts, least) and len({r[0] for r in got}) >= 3


def test_top_and_ties(spark, texts):
    got = sorted(map(tuple, P.collocations(frame(spark, texts), 5, 7).collect()))
    assert got == brute(texts, 5, 7)


def test_empty_and_none(spark):
    assert P.collocations(frame(spark, []), 2).count() == 0
    assert P.collocations(frame(spark, [("en", "a b a b")]), 3).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts of 10**12 words: 1000 * a * n is above 2**63."""
    n, a, left = 3 * 10**12, 10**12 - 7, 10**12 + 9
    words = spark.createDataFrame([(1, "en", "x", left), (2, "en", "y", left + 1)], "word bigint, lang string, text string, n bigint")
    totals = spark.createDataFrame([("en", n)], "lang string, total bigint")
    got = P._scored(spark.createDataFrame([([1, 2], a)], "words array<bigint>, a bigint"), words, totals).first()
    assert got["score"] == 1000 * a * n // (left * (left + 1))


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 100)
    rng = random.Random(1)
    long = " ".join(rng.choice(["aa", "bb.", "cc", "dd,"]) for _ in range(2000)) + " " + "no end " * 100
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array(["x y", long, None])], names=["seed", "text"])
    parts = list(P.chunks(batch))
    monkeypatch.setattr(P, "CHUNK", 1 << 20)
    (whole,) = P.chunks(batch)
    assert len(parts) > 20 and sum(len(c.words) for c in parts) == len(whole.words)
    assert sum(int(c.joined.sum()) for c in parts) == int(whole.joined.sum())
    assert [w for c in parts for w in c.words.tolist()] == whole.words.tolist()


def test_growth_keeps_open_phrases_over_batches():
    import numpy as np

    rows = np.array(sorted([[1, 2, 3, 4, 5]] * 4 + [[1, 2, 3, 4, 0]] * 2 + [[1, 2, 3, 9, 9]] * 3 + [[2, 2, 2, 0, 0]]))
    want = {(1, 2, 3): 9, (1, 2, 3, 4): 6, (1, 2, 3, 4, 5): 4, (1, 2, 3, 9): 3, (1, 2, 3, 9, 9): 3}
    for step in (1, 3, 10):
        growth = P.Growth(3)
        found = [b for i in range(0, len(rows), step) for b in growth.take(rows[i : i + step], np.ones(len(rows[i : i + step]), np.int64))] + list(growth.end())
        assert {tuple(w): a for b in found for w, a in zip(*b.to_pydict().values(), strict=True)} == want
