import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import token_counts as C
from plumbline.llm import token_io as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(tokenizer, rows, monkeypatch):
    odd = ["a  b", "a \nb ", " x", "x ", "\n y", "a\nb\nc\n", "\n\n", "<|endoftext|> z", "  b", "a b", "a\x1c b", "x\x85\ny", "it's  we'll", "\t a", "日本 語\n"]
    texts = [r[1] or "" for r in rows] + odd
    for most in (500_000, 10):
        monkeypatch.setattr(T, "CACHE_WORDS", most)
        e = T.Encoder(PATH)
        for a in range(0, len(texts), 5):
            got = [np.frombuffer(b, "<u2").tolist() for b in e.encode(texts[a : a + 5])]
            assert got == [x.ids for x in tokenizer.encode_batch(texts[a : a + 5], add_special_tokens=False)]


def test_white_space_that_cancels_out(tokenizer):
    """As many separators as single ones would be, but not single spaces and line feeds."""
    texts = ["a  b\tc", "end.  Next\u00a0one", "a\n\n\nb\tc\td", "a \nb\u2003c", " a\u00a0b", "a\u00a0b ", "x\n\n", "\n", "a b\nc", "a\n b\x1dc", "a\u200b b\x85c  d"]
    got = [np.frombuffer(b, "<u2").tolist() for b in T.Encoder(PATH).encode(texts)]
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_records(spark, docs, rows, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 100_000)
    path = f"file://{tmp_path}/r"
    T.write_records(docs, path, PATH)
    got = sorted((tuple(r) for r in T.read_records(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    ids = {}
    for r in rows:
        x = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        ids.setdefault(r[0], []).append((len(x), zlib.crc32(x.tobytes())))
    before = 0
    for doc_id, start, n, crc in got:
        assert start == before and (n, crc) in ids[doc_id]
        before += n
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == len(rows)
    one = next(r for r in index if r["doc_id"] == 9)
    data = (tmp_path / "r/records" / one["file"]).read_bytes()[one["offset"] : one["offset"] + one["length"]]
    assert next(T.frames(data))[2] == 9


def test_broken_frames_are_an_error():
    data = bytearray(T.frame(3, b"\x01\x00") + T.frame(None, b"\x02\x00\x00\x00", wide=True))
    found = [(i, x.tolist()) for _, _, i, x in T.frames(bytes(data))]
    assert found == [(3, [1]), (None, [2])]
    data[22] ^= 1
    with pytest.raises(ValueError, match="body checksum"):
        list(T.frames(bytes(data)))


def test_empty_tables(empty):
    assert T.records_digest(empty, PATH).count() == 0
    assert C.token_counts(empty, PATH).count() == 0


def greedy(word, pieces):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_automaton_against_greedy_search():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        machine = C.Automaton(sorted(pieces))
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert machine.count(word) == greedy(word, pieces), (pieces, word)


def test_token_counts(docs, rows):
    machine, _ = C.automaton(PATH)
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in C.token_counts(docs, PATH).collect()}
    expected = set()
    for r in rows:
        words = (r[1] or "").encode().split()
        expected.add((r[0], len(words), sum(machine.count(b" " + w) for w in words)))
    assert got == expected


def test_words_in_parts_and_after_forgetting(monkeypatch):
    """Long texts are cut between words, and a full memory starts afresh."""
    monkeypatch.setattr(T, "PART_BYTES", 200)
    monkeypatch.setattr(T, "CACHE_WORDS", 40)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    texts = [rng.choice(["", "", "\n"]).join([" ".join(rng.choice(words) for _ in range(n)), ""]) for n in (3, 500, 40, 1, 0, 80, 7)] + ["x" * 900, "a\nb " * 100 + "c", "a " + "y" * 700 + " b\n"]
    e = T.Encoder(PATH)
    got = [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
