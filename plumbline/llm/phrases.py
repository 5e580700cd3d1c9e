"""Phrase collocations by contiguous pattern growth (operator 13).

1. Words are counted per language; every word is a 64-bit number made of its bytes and its language. Words below the least
   count end every phrase, as no frequent phrase holds them.
2. Pairs of frequent words that stand together are the prefixes of two words; they are counted likewise.
3. Each occurrence of three words whose pairs are frequent is a pointer into its piece; with it go the words to its right as
   far as pairs stay frequent, at most MOST_WORDS in all. This is the projection of the prefix: equal ones of a chunk of text
   are one row with a count.
4. A task takes all rows of its prefixes, sorted. Sorted rows meet phrases depth-first: a phrase is open while rows have its
   words, its extensions to the right lie inside it, and it is kept at its end if its occurrences suffice. Only the open
   phrase of each length is held, so a frequent prefix costs no memory, and as prefixes of three words are dealt, a word or a
   pair that holds a third of all text is spread over tasks.
5. Counts of the parts of every cut are joined to the phrases; the lowest score counts.

Words and pairs that are frequent reach the tasks as bitmaps of 2**BITS bits (8 MB) each, whatever the vocabulary: a bit
that is set by another word lets a rare word pass, which its exact count drops later, so results don't hang on the size.

Defined results: null texts are empty, blank ones have no words; a null lang is `und` and one with lang `und`; rows repeated
count each; texts of any length are handled whole, cut for memory's sake only where a piece ends; ties go to the smaller k, and to
the phrase that is first in UTF-8 byte order; other columns are ignored; without rows, or phrases of the least count, there
are no results. Two words are taken as equal when their 64-bit numbers are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import arrow_map, stored, table
from plumbline.llm.words import BYTES, LOWER, U64, mix, word_spans

LEAST, MOST_WORDS, TOP = 100, 5, 2000
BITS = 26
#: Bytes of text whose words are pre-aggregated at once.
CHUNK = 1 << 21
BREAK = np.isin(BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8))
WORD = ~(BREAK | (BYTES == 0x20) | (BYTES == 0x09))
ODD = U64(0x9E3779B97F4A7C15)
SALTS = 64


class Chunk(NamedTuple):
    words: np.ndarray  #: number of each word, of its language
    joined: np.ndarray  #: whether a word and the next are of one piece; one less than words
    starts: np.ndarray
    ends: np.ndarray
    lower: np.ndarray  #: lower-cased bytes
    row: np.ndarray  #: the batch's row that each word is of


def _cut(text: bytes) -> Iterator[bytes]:
    """text in parts of about CHUNK bytes that end where a piece does."""
    at = 0
    while len(text) - at > CHUNK:
        breaks = np.flatnonzero(BREAK[np.frombuffer(text, dtype=np.uint8, count=CHUNK, offset=at)])
        if len(breaks):
            end = at + int(breaks[-1]) + 1
        else:
            end = min((p for b in b".,;:!?\n\x0b\x0c\r" if (p := text.find(b, at + CHUNK)) >= 0), default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def chunks(batch: pa.RecordBatch) -> Iterator[Chunk]:
    """The words of a batch (seed, text): as many whole texts at a time as CHUNK bytes hold, or a part of a longer one."""
    seeds = batch.column("seed").to_numpy().view(U64)
    run, rows, size = [], [], 0
    for row, value in enumerate(batch.column("text").cast(pa.large_binary())):
        for part in _cut(value.as_py() or b""):
            if run and size + len(part) > CHUNK:
                yield _parsed(run, rows, seeds)
                run, rows, size = [], [], 0
            run.append(part)
            rows.append(row)
            size += len(part) + 1
    if run:
        yield _parsed(run, rows, seeds)


def _parsed(run: list[bytes], rows: list[int], seeds: np.ndarray) -> Chunk:
    lower = LOWER[np.frombuffer(b"\n".join(run), dtype=np.uint8)]
    starts, ends, hashes = word_spans(lower, WORD)
    row = np.array(rows)[np.searchsorted(np.cumsum([len(t) + 1 for t in run]), starts, "right")]
    words = np.maximum(mix(hashes ^ mix(seeds[row])), U64(1))  # 0 stands for no word
    pieces = np.cumsum(BREAK[lower], dtype=np.int32)[starts]
    return Chunk(words, pieces[1:] == pieces[:-1], starts, ends, lower, row)


def _signed(words: np.ndarray) -> pa.Array:
    return pa.array(words.view(np.int64))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(word, lang, text, n): words that occur at least so often in their language, and a row without word for all of a lang."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = batch.column("lang")
        for c in chunks(batch):
            words, first, n = np.unique(c.words, return_index=True, return_counts=True)
            lower = c.lower.tobytes()
            texts = [lower[a:b] for a, b in zip(c.starts[first].tolist(), c.ends[first].tolist(), strict=True)]
            columns = [_signed(words), langs.take(pa.array(c.row[first])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "lang", "text", "n"])
            of, n = np.unique(c.row, return_counts=True)
            none = pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.string())
            yield pa.RecordBatch.from_arrays([none[0], langs.take(pa.array(of)), none[1], pa.array(n)], names=["word", "lang", "text", "n"])

    counted = arrow_map(docs, rows, "word bigint, lang string, text string, n bigint").groupBy("word", "lang", "text").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("word").isNull() | (F.col("n") >= least))


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * ODD + right)


class Bitmap:
    """2**BITS bits by the leading digits of mixed numbers."""

    def __init__(self, numbers: DataFrame, column: Column) -> None:
        """column: the leading BITS digits of each number; gathered as at most 2**(BITS - 6) sums of 64 bits."""
        of = numbers.select(column.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask")).toArrow()
        bits = np.zeros(1 << (BITS - 6), dtype=U64)
        bits[of.column("word").to_numpy()] = of.column("mask").to_numpy().view(U64)
        self.bits = numbers.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"bits": self.bits}

    def has(self, mixed: np.ndarray) -> np.ndarray:
        at = mixed >> U64(64 - BITS)
        return (self.bits.value[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)


def pair_counts(docs: DataFrame, words: Bitmap, least: int) -> DataFrame:
    """(w1, w2, n, at) of pairs that stand together at least so often; at: the leading digits of the pair's number."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            fine = words.has(c.words)
            at = np.flatnonzero(fine[:-1] & fine[1:] & c.joined)
            pairs, first, n = np.unique(_pairs(c.words[at], c.words[at + 1]), return_index=True, return_counts=True)
            columns = [_signed(c.words[at[first]]), _signed(c.words[at[first] + 1]), pa.array(n), pa.array((pairs >> U64(64 - BITS)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "n", "at"])

    counted = arrow_map(docs, rows, "w1 bigint, w2 bigint, n bigint, at bigint").groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    return counted.filter(F.col("n") >= least)


WORDS = [f"w{i}" for i in range(1, MOST_WORDS + 1)]


def projections(docs: DataFrame, pairs: Bitmap) -> DataFrame:
    """(w1 to w5, n): the occurrences of prefixes of three words with what stands to their right; 0 where no frequent pair leads on."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in chunks(batch):
            linked = c.joined.copy()
            linked[c.joined] = pairs.has(_pairs(c.words[:-1][c.joined], c.words[1:][c.joined]))
            at = np.flatnonzero(linked[:-1] & linked[1:])
            more, words = np.ones(len(at), dtype=bool), np.append(c.words, np.zeros(MOST_WORDS, U64))
            linked = np.append(linked, np.zeros(MOST_WORDS, bool))
            found = [words[at + i] for i in range(3)]
            for i in range(3, MOST_WORDS):
                more &= linked[at + i - 1]
                found.append(np.where(more, words[at + i], U64(0)))
            key = found[0]
            for w in found[1:]:
                key = _pairs(key, w)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(_signed(w[first]) for w in found), pa.array(n)], names=[*WORDS, "n"])

    return arrow_map(docs, rows, ", ".join(f"{w} bigint" for w in WORDS) + ", n bigint")


class Growth:
    """Depth-first growth over sorted projections: the open phrase of each length and its occurrences so far."""

    def __init__(self, least: int) -> None:
        self.least, self.open = least, {d: None for d in range(3, MOST_WORDS + 1)}

    def _kept(self, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(sums >= self.least)
        if len(found):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys[found].ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(sums[found])], names=["words", "a"])

    def take(self, rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: a row of words each, sorted; the phrases that end among them."""
        for depth in self.open:
            has = rows[:, depth - 1] != 0
            keys, counts = rows[has, :depth], n[has]
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            sums, runs = np.add.reduceat(counts, cuts), keys[cuts]
            if self.open[depth] is not None:
                key, total = self.open[depth]
                if (key == runs[0]).all():
                    sums[0] += total
                else:
                    runs, sums = np.vstack([key[None], runs]), np.append(total, sums)
            self.open[depth] = runs[-1], sums[-1]
            yield from self._kept(runs[:-1], sums[:-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        for key, total in filter(None, self.open.values()):
            yield from self._kept(key[None], np.array([total]))


def grown(projected: DataFrame, least: int) -> DataFrame:
    """(words, a): the phrases of three words and more of at least so many occurrences."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growth = Growth(least)
        for batch in batches:
            if batch.num_rows:
                yield from growth.take(np.column_stack([batch.column(w).to_numpy() for w in WORDS]), batch.column("n").to_numpy())
        yield from growth.end()

    return projected.repartition(*WORDS[:3]).sortWithinPartitions(*WORDS).mapInArrow(grow, "words array<bigint>, a bigint")


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) of phrases (words, a) of two words and more by their lowest-scoring cut."""
    every = phrases.unionAll(words.select(F.array("word").alias("words"), F.col("n").alias("a")))
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(every.select(F.col("words").alias("left"), F.col("a").alias("l")), "left").join(every.select(F.col("words").alias("right"), F.col("a").alias("r")), "right")
    lang = words.join(totals, "lang").select(F.col("word").alias("of"), "lang", F.col("total").alias("n"))
    cuts = cuts.withColumn("of", F.element_at("words", 1)).join(lang, "of")
    # Products of 64-bit counts need up to 38 digits; the quotient is at most 1000 n / least.
    exact = F.expr("(cast(a as decimal(18,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", exact).groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("best"))
    return best.select("words", "best.*")


def _closed(phrases: DataFrame) -> DataFrame:
    """phrases (words, a) that no longer one of as many occurrences holds.

    Where a longer one holds a phrase as often, so does one that is longer by a word: it lies between them, and its count too.
    """
    size = F.size("words")
    parts = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    held = phrases.filter(size > 2).select(F.explode(parts).alias("words"), F.col("a").alias("longer")).groupBy("words").agg(F.max("longer").alias("longer"))
    return phrases.join(held, "words", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("words", "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text): the first phrases of each language; top None: all of them."""
    lang = F.coalesce("lang", F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("seed"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(texts, least), "words")
    words = counts.filter("word is not null")
    totals = counts.filter("word is null").select("lang", F.col("n").alias("total"))
    leading = F.expr(f"shiftrightunsigned(word, {64 - BITS})")
    pairs = stored(pair_counts(texts, Bitmap(words, leading), least), "pairs")
    longer = grown(projections(texts, Bitmap(pairs, F.col("at"))), least)
    phrases = stored(pairs.select(F.array("w1", "w2").alias("words"), F.col("n").alias("a")).unionAll(longer), "phrases")
    scored = _scored(phrases, words, totals).join(_closed(phrases).select("words"), "words")
    spelt = scored.select("*", F.posexplode("words").alias("at", "word")).join(words.select("word", "text"), "word")
    spelt = spelt.groupBy("words", "lang", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("spelt"))
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", "spelt.text"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    if top is not None:  # each salt's first ones meet, so no task sorts a whole language
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(SALTS))).orderBy(*order)
        spelt = spelt.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
