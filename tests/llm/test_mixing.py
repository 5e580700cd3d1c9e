from collections import defaultdict

from plumbline.llm import mixing
from tests.llm.conftest import words_of


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing, one source at a time."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_plan(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    targets, taken = water(sizes), defaultdict(int)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((False, r[0], len(words_of(r[1]))) for r in rows if r[0] is not None)
    for r in got:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs).collect()))


def test_caps_pass_the_excess_on(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 100, "b"), (3, None, "c"), (4, "d " * 400, "d")], "doc_id bigint, text string, source string")
    got = {r["source"]: r for r in mixing.mix_plan(docs).collect()}
    expected = water({"a": 10, "b": 100, "c": 0, "d": 400})
    assert {s: round(r["target"], 6) for s, r in got.items()} == {s: round(v, 6) for s, v in expected.items()}
    assert got["a"]["taken"] == 30 and got["c"]["taken"] == 0


def test_empty(empty):
    assert mixing.mix_plan(empty).count() == 0


def test_applied_mix_has_the_planned_words(spark, docs):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(unique).collect()}
    out = mixing.apply_mix(unique)
    assert out.columns == unique.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in plan.items() if v} == dict(words)
