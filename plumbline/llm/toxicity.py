"""Toxicity by non-negative positive-unlabelled learning (operator 1).

Confirmed toxic texts are the positives; all other texts that may be learnt from are unlabelled. A linear scorer over the
presence of words and word beginnings is fitted in numpy by the non-negative risk estimator of Kiryo et al. (2017):
    risk = prior * mean_P loss(+f) + max(0, mean_U loss(-f) - prior * mean_P loss(-f))
with the sigmoid loss; where the corrected negative part falls below zero, a step is taken to raise it again. Labels that
say "not toxic" are not used. The class prior is a parameter; by default it is estimated from positives and unlabelled
texts alone by the best bin of a scorer's tail (Garg et al., 2021): of a scorer fitted on two thirds of the sample, the
least ratio, over all thresholds and with a bound for chance, of the share of unlabelled texts above it to that of
positives, both of the other third.

Fitting uses a bounded sample of rows (MAX_POSITIVE, MAX_UNLABELLED, by a hash of doc_id and text); at most MAX_FEATURES
features, those that differ most between the two kinds and by at least LEAST_Z standard errors, are chosen and fitted on
that sample, and every whole text of the table is scored.

Defined results: null and empty texts have no features and get the score of the offset alone, texts of any length are
scored whole; a null doc_id is not held out and never learnt from; doc_ids labelled twice count as toxic if any label says
so; rows repeated in doc_id and text are learnt from once; with no toxic label at all every score is 0, and where no
feature tells the kinds apart every score is the prior, at most 0.25; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, stored, table

MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
MAX_FEATURES, LEAST_Z = 1_200, 5
#: Highest score of texts when nothing tells them apart, and bounds of an estimated class prior.
FLAT, LEAST_PRIOR, MOST_PRIOR = 0.25, 1e-4, 0.5
#: Word beginnings of these lengths are features beside whole words, once for each of so many different words they begin.
STEMS, OFTEN = (5, 7), (1, 2, 3)
HELD_OUT_OF = 5
WORD = re.compile(r"\w+")


def features(text: str) -> set[str]:
    """Words of a text in lower case, and beginnings that at least n different words have, as beginning*n."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        for stem, times in Counter(w[:n] for w in words if len(w) > n).items():
            out.update(f"{stem}*{k}" for k in OFTEN if k <= times)
    return out


class Scorer:
    """offset + sum of the weights of the features present, as a probability."""

    def __init__(self, weights: dict[str, float], offset: float) -> None:
        self.weights, self.offset = weights, offset
        self.words = {f: w for f, w in weights.items() if "*" not in f}
        self.stems: dict[str, list[float]] = {}
        for name, weight in weights.items():
            stem, star, k = name.partition("*")
            if star:
                self.stems.setdefault(stem, [0.0] * len(OFTEN))[OFTEN.index(int(k))] = weight

    def score(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        total, stems = self.offset, self.stems
        for word in sorted(words.intersection(self.words)):
            total += self.words[word]
        seen = Counter(s for n in STEMS for w in words if len(w) > n and (s := w[:n]) in stems)
        for stem in sorted(seen):
            total += sum(w for k, w in zip(OFTEN, stems[stem], strict=True) if k <= seen[stem])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.uint8)
    for i, row in enumerate(rows):
        out[i, row] = 1
    return out


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, epochs: int = 80, batch: int = 2048, rate: float = 0.1, decay: float = 1e-5, beta: float = 0.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear scorer by non-negative PU risk; Adam over batches that hold both kinds of rows."""
    rng = np.random.default_rng(seed)
    w = np.zeros(width + 1, dtype=np.float32)
    x_p, x_u = _matrix(positive, width), _matrix(unlabelled, width)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    n_batches = max(1, math.ceil(len(unlabelled) / batch))
    for _ in range(epochs):
        for up, uu in zip(np.array_split(rng.permutation(len(positive)), n_batches), np.array_split(rng.permutation(len(unlabelled)), n_batches), strict=True):
            if not len(up):
                up = rng.integers(len(positive), size=min(len(positive), 64))
            xp, xu = x_p[up].astype(np.float32), x_u[uu].astype(np.float32)
            fp, fu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            sp, su = _sigmoid(fp), _sigmoid(fu)
            # The sigmoid loss of label y is sigmoid(-y f); its slope in f is -y s (1 - s).
            dp, du = sp * (1 - sp), su * (1 - su)
            negative = su.mean() - prior * sp.mean()
            gp, gu = prior * dp / len(up), du / len(uu)
            if negative >= -beta:
                on_p, on_u = -gp - gp, gu  # prior * P loss, then the corrected part
            else:
                on_p, on_u = gp, -gu
            grad = np.append(on_p @ xp + on_u @ xu, on_p.sum() + on_u.sum()).astype(np.float32) + decay * np.append(w[:-1], np.float32(0))
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT_OF)) == 0, F.lit(False))


def _below(share: float, *by):
    """Whether a row's 63-bit hash is below the share of all such hashes: fine enough for any number of rows."""
    return F.xxhash64(*by).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, int(share * (1 << 63))))


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """The class prior among the unlabelled, from scores of positives and unlabelled texts that the scorer wasn't fitted on."""
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = math.sqrt(math.log(4 / chance) / 2 / len(positive)) + math.sqrt(math.log(4 / chance) / 2 / len(unlabelled))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], LEAST_PRIOR, MOST_PRIOR))


def estimated_prior(positive: list[list[int]], unlabelled: list[list[int]], width: int) -> float:
    """`best_bin_prior` of a scorer fitted on two thirds of the rows, for the other third."""
    fit_on = lambda rows: [r for i, r in enumerate(rows) if i % 3]
    if len(positive) < 3 or len(unlabelled) < 3:
        return LEAST_PRIOR
    weights, offset = fit_nnpu(fit_on(positive), fit_on(unlabelled), width, MOST_PRIOR, epochs=30)
    scores = [np.array([weights[r].sum() + offset for r in rows[::3]]) for rows in (positive, unlabelled)]
    return best_bin_prior(*scores)


def _with_features(rows: DataFrame) -> DataFrame:
    """(doc_id, twin, kind, features): each sampled text's distinct features."""

    def found(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            names = pa.array([sorted(features(t or "")) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("twin"), part.column("kind"), names], names=["doc_id", "twin", "kind", "features"])

    return arrow_map(rows.select("doc_id", "twin", "kind", "text"), found, "doc_id bigint, twin bigint, kind int, features array<string>")


def _places(rows: DataFrame, at: dict[str, int]) -> DataFrame:
    """(doc_id, twin, kind, places): which of the chosen features each text has."""

    def found(batch: pa.RecordBatch):
        places = [sorted(at[f] for f in names if f in at) for names in batch.column("features").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), batch.column("kind"), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "twin", "kind", "places"])

    return arrow_map(rows.select("doc_id", "twin", "kind", "features"), found, "doc_id bigint, twin bigint, kind int, places array<int>")


def _without_twins(found: list[tuple[str, int, int]]) -> list[str]:
    """Of a word and its beginnings that are in equally many texts, the shortest."""
    out: dict[tuple, str] = {}
    for name, p, u in sorted(found, key=lambda x: (len(x[0]), x[0])):
        out.setdefault((name[: STEMS[0]], p, u), name)
    return list(out.values())


def flat(prior: float) -> Scorer:
    prior = min(FLAT, max(LEAST_PRIOR, prior))
    return Scorer({}, math.log(prior / (1 - prior)))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, prior: float | None = None) -> Scorer:
    """Learns from labels (doc_id, toxic) and docs (doc_id, text) whose doc_id isn't held out. What reaches the driver is bounded by the parameters."""
    known = F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    toxic = labels.filter(known & (F.col("toxic") == 1)).select("doc_id").distinct()
    # At most max_positive ids, so this side is small enough to broadcast.
    wanted = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).withColumn("wanted", F.lit(True))
    train = docs.filter(known).select("doc_id", "text")
    n_docs = train.select("doc_id").count()
    kinds = F.array_compact(F.array(F.when(F.col("wanted"), F.lit(1)), F.when(_below(min(1.0, max_unlabelled / max(1, n_docs)), "doc_id", F.lit(7)), F.lit(0))))
    sampled = train.join(F.broadcast(wanted), "doc_id", "left").select("doc_id", "text", F.xxhash64("text").alias("twin"), F.explode(kinds).alias("kind"))
    rows = stored(_with_features(sampled), "toxic-features").dropDuplicates(["doc_id", "twin", "kind"])
    n = dict(map(tuple, rows.groupBy("kind").count().collect()))
    if not n.get(1):
        return Scorer({}, -500.0)
    if not n.get(0):
        return flat(FLAT if prior is None else prior)
    rates = rows.select("kind", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    p, u = (F.col("p") + 0.5) / (n[1] + 1), (F.col("u") + 0.5) / (n[0] + 1)
    pooled = (F.col("p") + F.col("u") + 1) / (n[1] + n[0] + 2)
    z = F.abs(p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n[1] + 1 / n[0]))
    best = rates.filter((F.col("p") + F.col("u")) >= 4).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(max_features)
    best = _without_twins([tuple(r) for r in best.select("feature", "p", "u").collect()])
    if not best:
        return flat(FLAT if prior is None else prior)
    found = stored(_places(rows, {f: i for i, f in enumerate(best)}), "toxic-places")
    held = lambda kind, most: [r["places"] for r in found.filter(F.col("kind") == kind).orderBy(F.xxhash64("doc_id", "twin"), "doc_id", "twin").limit(most).select("places").collect()]
    positive, unlabelled = held(1, max_positive), held(0, max_unlabelled)
    weights, offset = fit_nnpu(positive, unlabelled, len(best), estimated_prior(positive, unlabelled, len(best)) if prior is None else prior)
    return Scorer({f: float(w) for f, w in zip(best, weights, strict=True) if abs(w) > 1e-6}, offset)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""

    def rows(batch: pa.RecordBatch):
        scores = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text"), rows, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs whose text the scorer does not call toxic."""

    def rows(batch: pa.RecordBatch):
        keep = [scorer.score(t or "") < 0.5 for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, rows, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
