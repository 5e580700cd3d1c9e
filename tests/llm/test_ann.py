import numpy as np
import pytest

from plumbline.llm import ann as A
from plumbline.llm.common import stored

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, dim int"


def vectors(kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    if kind == "clusters":
        x[:250] = x[0] + 0.02 * x[:250]
        x[300:306] = x[300]
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def rows(kind):
    out = [(i, v.tolist(), 0, "clash", 1) for i, v in enumerate(vectors(kind))]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [0.0] * 15), (1080, [None] * 16), (1100, []), (None, [1.0] * 16), (1120, [1.0, 2.0])]
    return [*out, *((i, v, 0, "c", 1) for i, v in odd), out[3], out[20]]


def dealt(spark, rows):
    """Stored, so that row numbers stay."""
    return stored(A.usable(spark.createDataFrame(rows, SCHEMA)), "vectors")


@pytest.mark.parametrize("kind", ["unit", "scaled", "clusters"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 300)
    usable = dealt(spark, rows(kind))
    got = A.neighbours(usable, usable.filter("vec_id % 20 = 0")).collect()
    x = vectors(kind).astype(np.float64)
    ids = np.append(np.arange(700), [3, 20])
    x = np.vstack([x, x[[3, 20]]])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    assert set(by) == set(range(0, 700, 20))
    hits = asked = 0
    for q, found in by.items():
        s = x @ x[q]
        if q != 20:
            s[q] = -np.inf
        times = 2 if q == 20 else 1  # row 20 is there twice, and each is the other's neighbour
        found.sort()
        assert [f[2] for f in found] == [r for r in range(1, 21) for _ in range(times)]
        assert all(abs(-f[0] - x[f[1]] @ x[q]) < 1e-9 for f in found)
        if q == 20:
            assert [f[1] for f in found if f[2] == 1] == [20, 20] or max(s) > s[20]
            continue
        best = np.lexsort((ids, -s.round(9)))[:20]
        hits += len({f[1] for f in found} & set(ids[best].tolist()))
        asked += len(set(ids[best].tolist()))
    assert hits / asked >= 0.9


def test_few_and_none(spark):
    few = dealt(spark, rows("unit")[:5])
    got = A.neighbours(few, few.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 4
    none = dealt(spark, [])
    assert A.neighbours(none, none).count() == 0


def test_recall_and_verified_share_of_a_large_block():
    """Random directions, the least contrast there is: recall stays above 0.9 while less than six tenths are verified."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 8_000, 100)
    index = A.CollisionIndex(x, 1.0)
    found = index.search(x[asked], 20, [np.array([i]) for i in asked])
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(scores, axis=1)[:, -20]
    recall = np.mean([(s >= t - 1e-9).sum() / 20 for (_, s), t in zip(found, least, strict=True)])
    assert recall >= 0.9 and index.verified < len(asked) * 8_000 * 0.6
