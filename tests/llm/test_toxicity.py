import random
import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity as T
from tests.llm.conftest import SCHEMA, prose

BAD = ("grumblewort", "snarkfin", "dolthead")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(20, 60)).split()
        if toxic:
            words[3:3] = rng.choices(BAD, k=3)
        rows.append((i, " ".join(words), "en", "s", 1, *["c"] * 3, 1, "c", 2))
        if i % 2 == 0:
            labels.append((i, int(toxic), "extra"))
    rows += [(None, None, "en", "s", 0, *["c"] * 3, 1, "c", 2), (901, "", "en", "s", 0, *["c"] * 3, 1, "c", 2), (902, None, "en", "s", 0, *["c"] * 3, 1, "c", 2), (0, rows[0][1], "en", "s", 0, *["c"] * 3, 1, "c", 2)]
    labels += [(None, 1, "x"), (5, None, "x"), (0, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    right = sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert right / len(held) > 0.97


def test_dropped_rows(corpus):
    docs, labels, _ = corpus
    kept = T.drop_toxic(docs, T.fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {901, 902, None} <= ids and sum(i % 6 == 0 for i in ids if i is not None and i < 900) < 10


def test_nothing_to_learn_from(spark, corpus, empty):
    docs, labels, _ = corpus
    none = T.fit(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in T.score(docs, none).collect()} == {0}
    assert T.score(empty, T.fit(empty, labels)).count() == 0


def test_risk_never_rewards_negative_parts():
    """Unlabelled rows hold positives; the corrected risk still tells the kinds apart."""
    rng = np.random.default_rng(0)
    positive = [[0] + rng.choice(range(2, 30), 3).tolist() for _ in range(200)]
    unlabelled = [([0] if rng.random() < 0.3 else [1]) + rng.choice(range(2, 30), 3).tolist() for _ in range(600)]
    w, b = T.fit_nnpu(positive, unlabelled, 30, 0.3)
    assert w[0] + b > 1 and w[1] + b < -1


def test_beginnings_count_words():
    assert {"abcdefg*1", "abcdefg*2", "abcde*2"} <= T.features("abcdefgh abcdefgi") and "abcdefg*3" not in T.features("abcdefgh abcdefgi abcdefgh")


def test_labels_of_positives_only(corpus):
    """Only confirmed toxic texts are labelled: the estimated prior keeps clean ones clean."""
    docs, labels, _ = corpus
    got = T.score(docs, T.fit(docs, labels.filter("toxic = 1"))).filter("doc_id < 900").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) / len(held) > 0.97


def test_prior_of_the_best_bin():
    rng = np.random.default_rng(1)
    for share in (0.05, 0.3):
        positive = rng.normal(3, 1, 1500)
        unlabelled = np.where(rng.random(6000) < share, rng.normal(3, 1, 6000), rng.normal(-3, 1, 6000))
        assert abs(T.best_bin_prior(positive, unlabelled) - share) < 0.06


def test_share_of_a_huge_table(spark):
    """The threshold is fine enough for 2e10 rows: about one in 1.7 million hashes is below it."""
    share = T.MAX_UNLABELLED / 2e10
    threshold = int(share * (1 << 63))
    assert threshold > 1 << 40
    assert spark.range(4_000_000).filter(T._below(1e-4, "id")).count() == pytest.approx(400, abs=120)


def test_scorer_by_brute_force():
    rng = random.Random(8)
    names = ["grumblewort", "ba", "grumb*1", "grumb*2", "keloban*1", "x"]
    scorer = T.Scorer({n: rng.uniform(-2, 2) for n in names}, -0.3)
    for text in ("", "grumblewort grumbling ba", "GRUMBLEWORT x x", "kelobans kelobant", prose(rng, 3000) + " grumbles"):
        total = -0.3 + sum(w for n, w in scorer.weights.items() if n in T.features(text))
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-total)))


def test_nothing_tells_rows_apart(spark):
    """Seven rows, one toxic label: nobody is called toxic; null, empty and very long texts get a score, ties too."""
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "z " * 300_000), (6, "a b"), (6, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = T.score(docs, T.fit(docs, spark.createDataFrame([(i, int(i == 1)) for i in range(1, 7)], "doc_id bigint, toxic int"))).collect()
    assert len(got) == 7 and {r["predicted"] for r in got} == {0} and all(0 <= r["score"] <= T.FLAT for r in got)
