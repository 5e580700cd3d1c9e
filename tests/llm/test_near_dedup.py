from itertools import combinations

import numpy as np
import pytest

from plumbline.llm import near_dedup as N
from plumbline.llm.graph import components
from tests.llm.conftest import lowered, words_of


def shingles(text):
    w = words_of(lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4)))


def brute(rows):
    """(n_shingles, least id of the component, kept) of each row."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids and sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=str)


def test_against_brute_force(docs, rows):
    got = N.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_links_that_miss_the_star(spark, monkeypatch):
    """A chain: every text is a near copy of the next only, so no star's centre is linked with all."""
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(12):
        texts.append(" ".join(base))
        base = base[10:] + [f"n{k}_{i}" for i in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(N, "TILE", 3)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r["component_id"] for r in got} == {0}


def test_empty(empty):
    assert N.near_duplicates(empty).count() == 0


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 1 << 63, 40, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, own[:10]])), np.sort(np.concatenate([common, own[10:]]))]
    text = np.repeat([0, 1, 2], [50, 50, 0])
    s = N.sketches(text, np.concatenate(sets), 3, bins=600)
    assert (s[:2] != N.EMPTY).all() and (s[2] == N.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 40 / 60) < 0.12


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, 60, (45, 2)).tolist()
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} | {i: find(i) for i in got}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_drop_duplicates_keeps_one(docs):
    kept = N.drop_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and not {6, 7, 8, 16} & set(ids) - {7} and 0 in ids


def test_pipeline_links_from_80_percent(spark):
    """Pairs at 0.79, 0.80, 0.82 and 0.85, by shared shingles of all: the pipeline drops all but the first, op4 links only the last."""
    import corpus_pipeline

    rows = []
    for k, (shared, own) in enumerate([(79, 21), (80, 20), (82, 18), (85, 15)]):
        w = [f"p{k}w{i}" for i in range(104)]  # 100 shingles, of which the shorter text has the first
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[: shared + 4]))]
        assert len(shingles(rows[-2][1])) == shared + own and len(shingles(rows[-1][1])) == shared
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {0, 1, 10, 20, 30}
    assert {r["doc_id"] for r in N.near_duplicates(docs).filter("not kept").collect()} == {31}


def test_bands_follow_the_percentage():
    assert N.band_shape(85) == (32, 6) and N.band_shape(80) == (38, 5)
    for percent in (20, 50, 70, 79, 80, 84, 85, 95):
        bands, rows = N.band_shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= N.MISSED
