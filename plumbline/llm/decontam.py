"""Benchmark decontamination by an FM-index of every training shard (operator 6).

A shard is what a task holds of the documents at once. Words that no benchmark phrase has can't be part of a match, so a
shard keeps only runs of benchmark words that are long enough for the shortest phrase, each run closed by a separator.
Over these runs stands an FM-index: suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix,
and the suffix positions sampled at every eighth place and at run beginnings. All phrases are searched backwards at once
through the wavelet ranks, occurrences are located from the samples, and overlapping ones merge into removal spans.

Benchmarks go to the executors in blocks of at most BLOCK_WORDS words; each block is one pass in the same stage.

Defined results: null and blank texts have no words and no hits; benchmark items without words are no phrases; an item
with a null id hits words but is not listed; items that share an id are one; repeated documents are each judged; empty
tables give no rows or no hits; further columns are ignored, or kept by `remove_spans`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, fresh, stored, table, text_bytes
from plumbline.llm.words import ALNUM, doc_hashes, hashes

WINDOW = 10
#: Words of benchmark text in one broadcast block: some tens of MB at most.
BLOCK_WORDS = 500_000
#: Words a shard's index may hold.
SHARD_WORDS = 1_000_000
SAMPLE = 8
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Phrases:
    """The distinct windows of benchmark items, as numbers of words, and the items each belongs to."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        found = [(item, doc_hashes((text or "").encode(), ALNUM, lower=True)) for item, text in items]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in found)]))
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.vocabulary & np.uint64(len(self.seen) - 1)).astype(np.int64)] = True
        owners: dict[tuple, set] = {}
        for item, h in found:
            ids = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            for i in range(max(min(1, len(ids)), len(ids) - window + 1)):
                owners.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [str(item)])
        self.by_length = {n: [p for p in owners if len(p) == n] for n in sorted({len(p) for p in owners})}
        self.items = {n: [sorted(owners[p]) for p in found] for n, found in self.by_length.items()}
        self.by_length = {n: np.array(found, dtype=np.int64) for n, found in self.by_length.items()}
        self.shortest = min(self.by_length, default=0)

    def number(self, words: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        out = np.zeros(len(words), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(words & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words[maybe]
        out[maybe[hit]] = at[hit] + 1
        return out


class WaveletMatrix:
    """Ranks and access over a sequence of small numbers; every call takes many places at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def mapped(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each place falls on the last level along its symbol's path; differences along one path are ranks."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            before = ones[places]
            places = np.where(bit == 1, zeros + before, places - before)
        return places

    def access(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[places]
            bit = ones[places + 1] - before
            out = out << 1 | bit
            places = np.where(bit == 1, zeros + before, places - before)
        return out


class FMIndex:
    """Backward search and location over words, 0 standing for separators; the last word must be a separator."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        gaps = words == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, words + int(gaps.sum()))
        step = 1
        while True:  # separators all differ, so runs are told apart within log2(longest run) rounds
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            changed = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = changed
            if changed[-1] == n - 1 or step >= n:
                break
            step *= 2
        before = words[order - 1]
        self.n, self.tree = n, WaveletMatrix(before)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=1 << self.tree.bits))])
        # A separator must not be stepped over, as separators rank by place: the word after one is always sampled.
        marked = (order % SAMPLE == 0) | (before == 0)
        self.marked, self.before_mark, self.samples = marked, np.concatenate([[0], np.cumsum(marked)]), order[marked]

    def step(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.smaller[symbols] + self.tree.mapped(symbols, places) - self.tree.mapped(symbols, np.zeros_like(places))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, row after the last) of the phrases that occur."""
        alive = np.flatnonzero((phrases < len(self.smaller) - 1).all(axis=1))
        low, high = np.zeros(len(alive), dtype=np.int64), np.full(len(alive), self.n, dtype=np.int64)
        for at in reversed(range(phrases.shape[1])):
            symbols = phrases[alive, at]
            low, high = self.step(symbols, low), self.step(symbols, high)
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, open_, walked = np.empty(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(open_):
            here = self.marked[rows]
            out[open_[here]] = self.samples[self.before_mark[rows[here]]] + walked
            open_, rows = open_[~here], rows[~here]
            rows = self.step(self.tree.access(rows), rows)
            walked += 1
        return out


class Shard:
    """Collects the runs of several texts, then finds all phrases in them."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.parts, self.docs, self.places, self.size = phrases, [], [], [], 0

    def add(self, doc: int, numbers: np.ndarray, cuts: np.ndarray) -> None:
        """numbers: words of several texts one after another, the first being text doc; cuts: where each begins."""
        if not self.phrases.shortest:
            return
        edge = np.zeros(len(numbers) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[cuts] = True
        inside = numbers > 0
        start = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
        end = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        long = ends - starts >= self.phrases.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return
        lengths = ends - starts + 1
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.repeat(starts - begin, lengths) + np.arange(int(lengths.sum()))
        words = numbers[np.minimum(at, len(numbers) - 1)]
        words[begin + lengths - 1] = 0
        text = np.searchsorted(cuts, at, side="right") - 1
        text[begin + lengths - 1] = text[begin + lengths - 2]
        self.parts.append(words)
        self.docs.append(text + doc)
        self.places.append(at - cuts[text])
        self.size += len(words)

    def hits(self) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Merged spans of words, and items found, by text."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.parts:
            words, docs, places = map(np.concatenate, (self.parts, self.docs, self.places))
            index = FMIndex(words)
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            for n, phrases in self.phrases.by_length.items():
                which, low, high = index.search(phrases)
                times = high - low
                if not len(which):
                    continue
                rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
                found = index.locate(rows)
                np.add.at(cover, found, 1)
                np.add.at(cover, found + n, -1)
                pairs = np.unique(np.stack([docs[found], np.repeat(which, times)]), axis=1)
                for doc, phrase in pairs.T.tolist():
                    items.setdefault(doc, set()).update(self.phrases.items[n][phrase])
            hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
            for a, b in zip(np.flatnonzero(hit[1:] & ~hit[:-1]).tolist(), np.flatnonzero(hit[:-1] & ~hit[1:]).tolist(), strict=True):
                spans.setdefault(int(docs[a]), []).append((int(places[a]), int(places[b - 1]) + 1))
        self.parts, self.docs, self.places, self.size = [], [], [], 0
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_texts(texts: list[bytes], phrases: Phrases) -> tuple[list[int], dict, dict]:
    """Words of each text, merged spans and items by the text's number."""
    n_words, spans, items, shard = [], {}, {}, Shard(phrases)

    def flush() -> None:
        new_spans, new_items = shard.hits()
        for doc, found in new_spans.items():
            spans.setdefault(doc, []).extend(found)
        for doc, names in new_items.items():
            items.setdefault(doc, set()).update(names)

    for first, words, cuts in hashes(texts, ALNUM, lower=True):
        n_words += np.diff(cuts).tolist()
        shard.add(first, phrases.number(words) if phrases.shortest else words, cuts[:-1])
        if shard.size >= SHARD_WORDS:
            flush()
    flush()
    return n_words, spans, items


SPANS = ("bigint", "array<struct<start:int,end:int>>", "array<string>")
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_spans(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, into: tuple[str, str, str] = ("n_words", "spans", "items"), then=None) -> DataFrame:
    """docs with n_words, the spans of words that benchmark (item_id, text) phrases cover, and the items found; into: their columns' names.

    Phrases come in blocks of bounded size, one after another: the result of each block but the last is written, so that
    one block at a time is on driver and executors. then: what the last block's pass makes of its batches, docs' own
    columns being left; a pass of its own would take a second Python worker for each task.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_words * 4)))
    names, columns = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs
    for block in range(blocks):
        rows_here = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows_here.select("item_id", "text").collect()]))

        def rows(batch: pa.RecordBatch, phrases=phrases, again=block > 0, last=block == blocks - 1):
            n_words, spans, items = search_texts(list(text_bytes(batch.column("text"))), phrases.value)
            if again:
                for i, (old_spans, old_items) in enumerate(zip(batch.column(into[1]).to_pylist(), batch.column(into[2]).to_pylist(), strict=True)):
                    if old_spans:
                        spans[i] = [*spans.get(i, []), *((s["start"], s["end"]) for s in old_spans)]
                        items[i] = items.get(i, set()) | set(old_items)
            every = range(batch.num_rows)
            found = pa.array([[{"start": a, "end": b} for a, b in merged(spans[i])] if i in spans else [] for i in every], _SPAN_TYPE)
            listed = pa.array([sorted(items.get(i, ())) for i in every], pa.list_(pa.string()))
            done = pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(n_words, pa.int64()), found, listed], names=[*names, *into])
            yield then(done) if last and then else done

        last = block == blocks - 1
        if last and then:
            return arrow_map(out, rows, docs.schema)
        out = arrow_map(out, rows, f"{columns}, {', '.join(f'`{n}` {t}' for n, t in zip(into, SPANS, strict=True))}")
        if not last:
            out = stored(out, "spans")
            phrases.unpersist()
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what lies between them."""
    places = [m.span() for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with benchmark passages cut out of the text (and n_chars set anew); all rows stay."""
    names, into = docs.columns, fresh(docs.columns, "n_words", "spans", "items")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [i for i, s in enumerate(batch.column(into[1])) if len(s)]
        out = batch.select(names)
        if hit:
            texts = out.column("text").to_pylist()
            for i in hit:
                texts[i] = cut_words(texts[i], [(s["start"], s["end"]) for s in batch.column(into[1])[i].as_py()])
            at = names.index("text")
            out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            if "n_chars" in names:
                at, chars = names.index("n_chars"), out.column("n_chars").to_pylist()
                for i in hit:
                    chars[i] = len(texts[i])
                out = out.set_column(at, out.schema.field(at), pa.array(chars, out.schema.field(at).type))
        return out

    return find_spans(docs, benchmark, into=into, then=cut)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
