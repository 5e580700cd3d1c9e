import hashlib
import re

import pytest

from plumbline.llm import decontam as D
from tests.llm.conftest import lowered


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(min(1, len(w)), len(w) - 9)):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([] if item is None else [str(item)])
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    long = rows[13][1].split()
    return [(1, " ".join(long[100:140])), (10, "TWO words!"), (2, rows[10][1]), (None, "one"), (3, None), (4, "..."), (10, " ".join(long[110:125])), (5, "café über")]


@pytest.mark.parametrize("block", [500_000, 8])
def test_against_brute_force(spark, docs, rows, items, block, tmp_path):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.find_spans(docs.select("doc_id", "text"), bench, block_words=block)
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), len(r["spans"]) > 0) for r in found.collect()]
    assert sorted(got, key=str) == brute([(r[0], r[1]) for r in rows], items)


def test_small_shards(monkeypatch, rows, items):
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    phrases = D.Phrases(items)
    texts = [(r[1] or "").encode() for r in rows]
    once = D.search_texts(texts, phrases)
    monkeypatch.setattr(D, "SHARD_WORDS", 10**9)
    assert once == D.search_texts(texts, phrases)


def test_removed_words(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = D.remove_spans(docs, bench)
    assert out.columns == docs.columns and out.count() == len(rows)
    again = D.find_spans(out.filter("doc_id = 13 or doc_id = 10").select("doc_id", "text"), bench)
    assert all(not r["spans"] for r in again.collect())


def test_empty(spark, empty, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_spans(empty, none).count() == 0
    assert all(not r["spans"] for r in D.find_spans(docs, none).collect())
