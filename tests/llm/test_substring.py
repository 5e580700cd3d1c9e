import hashlib
import random

from plumbline.llm import substring as S
from tests.llm.conftest import prose, words_of


def brute(rows):
    first = {}
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in docs:
        w = words_of(text)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (True, 1 << 60, 0, None)), (doc_id is not None, doc_id or 0, i, text))
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (doc_id is not None, doc_id or 0, i, text):
                gone.update(range(i, i + 20))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs, rows):
    got = S.repeated_words(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in rows])
    assert sum(r["n_removed"] for r in got) > 0


def test_empty(empty):
    assert S.repeated_words(empty).count() == 0


def test_exact_window_length(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:40])), (2, " ".join(["a", *w[5:25], "b"])), (3, " ".join(["c", *w[5:24], "d"])), (4, " ".join(w[:20] + w[:20]))]
    got = {r["doc_id"]: r["n_removed"] for r in S.repeated_words(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 20, 3: 0, 4: 40}


def test_kept_text_and_removed_spans(spark, docs, rows):
    """Every row's spans and text are there, agree with each other and with the digests."""
    got = S.remove_repeats(docs).collect()
    assert len(got) == len(rows) and sum(bool(r["removed"]) for r in got) > 0
    digests = [(r["doc_id"], r["n_words"], sum(b - a for a, b in r["removed"]), hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got]
    assert sorted(digests, key=str) == brute([(r[0], r[1]) for r in rows])
    w = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(w[:40])), (2, " ".join(["a", *w[5:25], "b", "c", *w[:20], "d"])), (3, None)]
    got = {r["doc_id"]: ([tuple(s) for s in r["removed"]], r["kept_text"]) for r in S.remove_repeats(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: ([], texts[0][1]), 2: ([(1, 21), (23, 43)], "a b c d"), 3: ([], "")}


def test_hot_passage(spark, monkeypatch):
    """One passage in a third of the rows: its anchors go the broadcast way and the result stays the same."""
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    rng = random.Random(9)
    passage = prose(rng, 45)
    rows = [(i, f"{prose(rng, 25)} {passage} {prose(rng, 25)}" if i % 3 == 0 else prose(rng, 60)) for i in range(150)]
    got = S.repeated_words(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(r["n_removed"] for r in got) >= 49 * 45


def automaton(words):
    """A suffix automaton of words: links, lengths, and the transitions of each state."""
    link, length, step, last = [-1], [0], [{}], 0
    for w in words:
        now = len(length)
        link.append(0), length.append(length[last] + 1), step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w], p = now, link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q]))
                while p >= 0 and step[p].get(w) == q:
                    step[p][w], p = copy, link[p]
                link[q] = link[now] = copy
        last = now
    return link, length, step


def matching_statistics(words, link, length, step):
    """For each word, how many words up to it occur in the automaton's text."""
    out, at, n = [], 0, 0
    for w in words:
        while at and w not in step[at]:
            at = link[at]
            n = length[at]
        if w in step[at]:
            at, n = step[at][w], n + 1
        out.append(n)
    return out


def test_against_a_suffix_automaton(spark):
    """A later text loses exactly the spans that matching statistics against the earlier one's automaton give."""
    rng = random.Random(10)
    first = prose(rng, 400).split()
    second = [*prose(rng, 20).split(), *first[50:90], *prose(rng, 15).split(), *first[200:219], *prose(rng, 3).split(), *first[300:], *prose(rng, 9).split()]
    gone = set()
    for i, n in enumerate(matching_statistics(second, *automaton(first))):
        if n >= S.WINDOW:
            gone.update(range(i - n + 1, i + 1))
    rows = [(1, " ".join(first)), (2, " ".join(second))]
    got = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {p for a, b in got[2]["removed"] for p in range(a, b)} == gone and got[1]["removed"] == [] and len(gone) == 140
