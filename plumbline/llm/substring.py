"""Substring dedup: removal of words in windows of WINDOW words that also start earlier (operator 9).

The corpus is its own reference, so its suffix automata could be broadcast only while the corpus is small; README says,
with measured bytes a state, what takes their place:
1. Every window of WINDOW words has a least GRAM-gram (its anchor). Equal windows have equal anchors, so only anchors that
   occur twice or more can lie in repeated windows. Anchors are about a seventh of the words. Anchors above a row limit
   are at most MOST_HOT, so they are broadcast and their rows never meet in one task.
2. Consecutive windows of a text with the same repeated anchor are a run. Of equal runs the earliest is found by a
   pre-aggregated least; the windows of all others start earlier there.
3. The earliest place of each window of those runs is found in the same way; no group of occurrences is ever gathered.
   Runs and windows are keyed by 128 bits of hash.
4. A window that isn't its key's earliest place is a match; runs of matches make the maximal spans that are removed.
`remove_repeats` gives the spans and the text that stays; the query takes its counts and digests from the same columns, each
made where the text is, so that no text is dealt out for them.

Defined results: null and blank texts have no words; rows that are alike in doc_id and text are judged as one; other rows
with equal doc_ids are two documents of which either may count as the earlier where both hold a window at the same place;
a null doc_id comes before all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, delete_path, release_shuffles, stored, stored_path, table, text_bytes
from plumbline.llm.words import BLANK_SPLIT, U64, doc_hashes, grams, hashes, other_hashes, spans

WINDOW, GRAM = 20, 8
#: Rows from which an anchor may count as hot, and how many can be.
HOT_ROWS, MOST_HOT = 4_000, 100_000
SPAN = WINDOW - GRAM + 1
TOP = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every width consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors_of_windows(words: np.ndarray) -> np.ndarray:
    """The least gram of every window."""
    return _sliding(grams(words, GRAM), SPAN, np.minimum)


def anchors(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every gram that is least in some window of texts that lie one after another."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, U64)
    every = grams(words, GRAM)
    least = _sliding(every, SPAN, np.minimum)
    text = np.searchsorted(cuts, np.arange(len(every)), side="right") - 1
    n = len(least)
    crosses = cuts[text[:n] + 1] < np.arange(n) + WINDOW
    least = np.where(crosses, U64(0), least)
    pad = np.zeros(SPAN - 1, dtype=U64)
    most = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
    chosen = np.flatnonzero((most == every) & (every != 0))
    return text[chosen], every[chosen]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch):
        ids, twins = batch.column("doc_id"), batch.column("twin")
        for first, words, cuts in hashes(text_bytes(batch.column("text")), BLANK_SPLIT):
            text, found = anchors(words, cuts)
            at = pa.array(text + first)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids.take(at), twins.take(at)], names=["anchor", "doc_id", "twin"])

    return arrow_map(docs, rows, "anchor bigint, doc_id bigint, twin bigint")


def _candidates(text: bytes, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes, the starts of windows whose anchor is among the repeated ones, and where in those a run of one anchor begins."""
    words = doc_hashes(text, BLANK_SPLIT)
    if len(words) < WINDOW:
        return words, np.empty(0, np.int64), np.empty(0, np.int64)
    anchor = anchors_of_windows(words)
    starts = np.flatnonzero(np.isin(anchor, repeated))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) > 1) | (anchor[starts[1:]] != anchor[starts[:-1]])
    return words, starts, np.flatnonzero(new)


def _placed(node: int, doc_id: int | None, starts: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys of 128 bits with the places that they stand at."""
    for a in range(0, len(starts), 100_000):
        n = len(starts[a : a + 100_000])
        key_a, key_b = (pa.array(k[a : a + n].view(np.int64)) for k in keys)
        yield pa.RecordBatch.from_arrays([key_a, key_b, pa.array([doc_id] * n, pa.int64()), pa.array(starts[a : a + n].astype(np.int32)), pa.array(np.full(n, node, dtype=np.int64))], names=["key_a", "key_b", "doc_id", "start", "node"])


PLACED = "key_a bigint, key_b bigint, doc_id bigint, start int, node bigint"


def _run_rows(held: DataFrame) -> DataFrame:
    """A row for each run of windows with one repeated anchor: the key of its words and its place."""

    def rows(batch: pa.RecordBatch):
        for node, doc_id, text, repeated in zip(batch.column("node").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("anchors"), strict=True):
            words, starts, first = _candidates(text, repeated.values.to_numpy().view(U64))
            if len(first):
                last = starts[np.append(first[1:], len(starts)) - 1] + WINDOW
                yield from _placed(node, doc_id, starts[first], tuple(spans(w, starts[first], last) for w in (words, other_hashes(words))))

    return arrow_map(held.select("node", "doc_id", "text", "anchors"), rows, PLACED)


def _window_rows(held: DataFrame) -> DataFrame:
    """A row for each window of the runs that begin at `runs`."""

    def rows(batch: pa.RecordBatch):
        for node, doc_id, text, repeated, runs in zip(batch.column("node").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), batch.column("anchors"), batch.column("runs"), strict=True):
            words, starts, first = _candidates(text, repeated.values.to_numpy().view(U64))
            if len(first):
                sizes = np.diff(np.append(first, len(starts)))
                starts = starts[np.repeat(np.isin(starts[first], runs.values.to_numpy()), sizes)]
                yield from _placed(node, doc_id, starts, tuple(grams(w, WINDOW)[starts] for w in (words, other_hashes(words))))

    return arrow_map(held.select("node", "doc_id", "text", "anchors", "runs"), rows, PLACED)


def _earliest(rows: DataFrame, name: str) -> DataFrame:
    """(node, name): the starts in each text at which a key has its earliest place of all."""
    first = F.min(F.struct("doc_id", "start", "node")).alias("first")
    return rows.groupBy("key_a", "key_b").agg(first).groupBy("first.node").agg(F.collect_list("first.start").alias(name))


def covered(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Whether each word lies in a window that begins at one of starts."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return np.cumsum(step[:-1]) > 0


#: Bytes of kept text in a batch.
KEPT_BYTES = 1 << 22


def spans_of(gone: np.ndarray) -> np.ndarray:
    """(first word, word after the last) of each run of removed words."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows, whose last value is a kept text, in batches of bounded size."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1])
        if size > KEPT_BYTES or len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


_KEY = [("doc_id", pa.int64()), ("twin", pa.int64())]
_WHOLE = pa.schema([*_KEY, ("n_words", pa.int64()), ("whole_text", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_CUT = pa.schema([*_KEY, ("removed", _SPANS), ("kept_text", pa.binary())])


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, n_words, whole_text): what a text yields if nothing is removed."""

    def made(batch: pa.RecordBatch):
        for doc_id, twin, text in zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), text_bytes(batch.column("text")), strict=True):
            words = text.split()  # one text's words at a time
            yield doc_id, twin, len(words), b" ".join(words)

    return arrow_map(docs, lambda batch: _in_batches(made(batch), _WHOLE), "doc_id bigint, twin bigint, n_words bigint, whole_text binary")


def _cleaned(held: DataFrame) -> DataFrame:
    """(doc_id, twin, removed, kept_text) of texts with matches; firsts: starts of windows that stay."""

    def made(batch: pa.RecordBatch):
        for doc_id, twin, text, repeated, firsts in zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), text_bytes(batch.column("text")), batch.column("anchors"), batch.column("firsts"), strict=True):
            _, starts, _ = _candidates(text, repeated.values.to_numpy().view(U64))
            if firsts.is_valid:
                starts = np.setdiff1d(starts, firsts.values.to_numpy(), assume_unique=True)
            if len(starts):
                words = text.split()
                gone = covered(starts, len(words))
                yield doc_id, twin, [{"start": a, "end": b} for a, b in spans_of(gone).tolist()], b" ".join(compress(words, ~gone))

    return arrow_map(held.select("doc_id", "twin", "text", "anchors", "firsts"), lambda batch: _in_batches(made(batch), _CUT), "doc_id bigint, twin bigint, removed array<struct<start bigint, end bigint>>, kept_text binary")


def _alike(docs: DataFrame, other: DataFrame):
    return docs["doc_id"].eqNullSafe(other["id_"]) & (docs["twin"] == other["twin_"])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "id_").withColumnRenamed("twin", "twin_")


def _with_repeated(found: DataFrame, often: DataFrame) -> DataFrame:
    """The rows of found (anchor, ...) whose anchor is in often (anchor, times).

    Anchors of more than `limit` rows are at most MOST_HOT, which bounds what is broadcast; their rows stay where they are.
    No other anchor brings more than `limit` rows to a task.
    """
    total = often.agg(F.sum("times")).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = F.broadcast(often.filter(F.col("times") > limit).select("anchor"))
    cold = often.filter(F.col("times") <= limit).select("anchor")
    return found.join(hot, "anchor", "left_semi").unionAll(found.join(hot, "anchor", "left_anti").join(cold, "anchor"))


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every text yields as a whole, and what those with matches yield without them: `_whole` and `_cleaned`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text")
    path = stored_path(_anchor_rows(docs), "anchors")
    found = spark.read.schema("anchor bigint, doc_id bigint, twin bigint").parquet(path)
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1"), "often")
    lists = stored(_with_repeated(found, often).groupBy("doc_id", "twin").agg(F.collect_set("anchor").alias("anchors")), "repeated")
    delete_path(spark, path)
    release_shuffles(spark)
    keyed = _keyed(lists)
    held = docs.join(keyed, _alike(docs, keyed)).select("doc_id", "twin", "text", "anchors").dropDuplicates(["doc_id", "twin"])
    held = stored(held.withColumn("node", F.monotonically_increasing_id()), "held")
    release_shuffles(spark)
    runs = stored(_earliest(_run_rows(held), "runs"), "runs")
    release_shuffles(spark)
    firsts = stored(_earliest(_window_rows(held.join(runs, "node")), "firsts"), "firsts")
    release_shuffles(spark)
    return _whole(docs), _cleaned(held.join(firsts, "node", "left"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, removed, kept_text) for every row of docs (doc_id, text).

    removed: the spans of words that go, (start, end) counted from 0, end not included; kept_text: the other words.
    """
    whole, cut = _judged(docs)
    cut = _keyed(cut)
    joined = whole.join(cut, _alike(whole, cut), "left")
    none = F.array().cast("array<struct<start bigint, end bigint>>")
    return joined.select("doc_id", "n_words", F.coalesce("removed", none).alias("removed"), F.coalesce("kept_text", "whole_text").cast("string").alias("kept_text"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text): what `remove_repeats` gives, counted and digested."""
    whole, cut = _judged(docs)
    whole = whole.select("doc_id", "twin", "n_words", F.sha2("whole_text", 256).alias("whole_sha256"))
    n_removed = F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed")
    cut = _keyed(cut.select("doc_id", "twin", n_removed, F.sha2("kept_text", 256).alias("cut_sha256")))
    joined = whole.join(cut, _alike(whole, cut), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
