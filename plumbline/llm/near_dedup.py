"""MinHash near-duplicates by one-permutation hashing with optimal densification (operator 4).

1. Each text's distinct 5-word shingles are hashed once. The hash space is cut into BINS bins; a bin keeps its least hash,
   and an empty bin copies a full one that a fixed pseudo-random sequence of bins leads to (Shrivastava, 2017).
2. Texts with the same set form a class by a 128-bit digest of the set, pre-aggregated; only classes go on.
3. BANDS bands of ROWS bins give buckets. Links inside a bucket are tried as a star: every member against the member with
   the least random rank, so pairs grow with the members and not with their square.
4. Pairs are confirmed on full sets; components of confirmed links follow.
5. Where a bucket still has members in different components, a star may have missed links that don't pass its centre.
   Those members are compared in tiles of bounded size, numpy against numpy: only links leave a task, never all pairs.
   Then components are found once more.

The least similarity is a parameter: 85 % in the op4 query, 80 % in the pipeline. Bands follow from it: with 32 bands of 6
bins a pair at 0.85, and with 38 of 5 a pair at 0.80, shares no bucket with a chance of 3e-7; all else is exact.

Defined results: null and blank texts have no shingles and stand alone; rows with equal text are of one class even when
their doc_ids are equal or null; a component's id is its least doc_id that isn't null; a row with a null id is kept only
where its component has no other id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, fresh, stored, table, text_bytes
from plumbline.llm.graph import components
from plumbline.llm.words import BLANK_SPLIT, U64, grams, hashes, mix

SHINGLE = 5
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Links have 100 * intersection >= percent * union; this is the percent of the op4 query.
PERCENT = 85
#: Chance at most with which a pair of the least similarity may share no bucket, and bands that rows are chosen for.
MISSED, MOST_BANDS = 3e-7, 38
#: Members of a bucket that one task compares with as many others.
TILE = 192
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted, of the distinct shingles of texts that lie one after another in words."""
    lengths = np.diff(cuts)
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - SHINGLE + 1, 0))
    first = np.repeat(cuts[:-1], np.maximum(lengths - SHINGLE + 1, 0))
    ends = np.cumsum(np.maximum(lengths - SHINGLE + 1, 0))
    at = np.arange(len(text)) - np.repeat(ends - np.maximum(lengths - SHINGLE + 1, 0), np.maximum(lengths - SHINGLE + 1, 0)) + first
    all_grams = grams(words, SHINGLE)
    shingles = all_grams[at] if len(at) else np.empty(0, U64)
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        shingles = np.append(shingles, grams(words[cuts[i] : cuts[i + 1]], int(lengths[i])))
        text = np.append(text, i)
    order = np.lexsort((shingles, text))
    text, shingles = text[order], shingles[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    return text[new], shingles[new]


def sketches(text: np.ndarray, shingles: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n rows of bins: least hash of each bin, empty bins filled from full ones; a row without shingles stays EMPTY."""
    low = np.full((n, bins), EMPTY, dtype=U64)
    where = ((shingles >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (where[1:] != where[:-1])  # hashes ascend, and bins with them
    low[text[first], where[first]] = shingles[first]
    out = low.copy()
    rows, cols = np.nonzero((low == EMPTY) & (low != EMPTY).any(axis=1)[:, None])
    attempt = 1
    while len(rows):
        other = (mix((cols.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(bins)).astype(np.int64)
        found = low[rows, other]
        full = found != EMPTY
        out[rows[full], cols[full]] = found[full]
        rows, cols = rows[~full], cols[~full]
        attempt += 1
    return out


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows) for pairs of percent and more: the most rows that MOST_BANDS bands allow, and as many bands as it takes."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent}")
    if percent >= PERCENT:
        return BANDS, ROWS
    need = lambda rows: math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** rows)))
    rows = max((r for r in range(1, ROWS + 1) if need(r) <= MOST_BANDS), default=1)
    return need(rows), rows


def bands(sketch: np.ndarray, shape: tuple[int, int] = (BANDS, ROWS)) -> np.ndarray:
    """The bucket of each band, the band itself being part of it."""
    parts = sketch.reshape(len(sketch), *shape)
    out = np.broadcast_to(np.arange(1, shape[0] + 1, dtype=U64), parts.shape[:2]).copy()
    for row in range(shape[1]):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch_table(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, twin, n_shingles, set_a, set_b, bands) of docs (doc_id, text); twin: a hash of the text."""
    shape = band_shape(percent)

    def rows(batch: pa.RecordBatch):
        at = 0
        for _, words, cuts in hashes(text_bytes(batch.column("text")), BLANK_SPLIT, lower=True):
            n = len(cuts) - 1
            text, shingles = shingle_sets(words, cuts)
            count = np.bincount(text, minlength=n)
            sums = np.zeros((2, len(shingles) + 1), dtype=U64)
            np.cumsum(mix(shingles), out=sums[0, 1:])
            np.cumsum(mix(shingles ^ U64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            ends = np.cumsum(count)
            keys = sums[:, ends] - sums[:, ends - count]
            buckets = bands(sketches(text, shingles, n, shape[0] * shape[1]), shape)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shape[0]), pa.array(signed(buckets.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("twin").slice(at, n), pa.array(count.astype(np.int64)), pa.array(signed(keys[0])), pa.array(signed(keys[1])), listed], names=["doc_id", "twin", "n_shingles", "set_a", "set_b", "bands"])
            at += n

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("twin"), "text"), rows, "doc_id bigint, twin bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles) of docs (node, text), shingles ascending as unsigned numbers."""

    def rows(batch: pa.RecordBatch):
        at = 0
        for _, words, cuts in hashes(text_bytes(batch.column("text")), BLANK_SPLIT, lower=True):
            n = len(cuts) - 1
            text, shingles = shingle_sets(words, cuts)
            offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(shingles)))], names=["node", "shingles"])
            at += n

    return arrow_map(docs.select("node", "text"), rows, "node bigint, shingles array<bigint>")


def tile_links(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between (node, component, set) of two tiles, or inside one, that join components not yet joined here."""
    both = left + (right or [])
    members = np.concatenate([s for _, _, s in both])
    values, place = np.unique(members, return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for _, _, s in both])
    n, cut = len(both), len(left)
    shared = np.zeros((n, n), dtype=np.float32)
    for a in range(0, len(values), 4096):  # a slice of the values at a time bounds the matrix
        here = (place >= a) & (place < a + 4096)
        matrix = np.zeros((n, min(4096, len(values) - a)), dtype=np.float32)
        matrix[owner[here], place[here] - a] = 1
        shared += matrix @ matrix.T
    size = np.array([len(s) for _, _, s in both], dtype=np.float32)
    union = size[:, None] + size[None, :] - shared
    ok = 100 * shared >= percent * union
    if right is not None:
        ok[:cut, :cut] = ok[cut:, cut:] = False
    root = {c: c for _, c, _ in both}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        a, b = find(both[i][1]), find(both[j][1])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((both[i][0], both[j][0]))
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def _missed_links(crowds: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different components. crowds: (bucket, node)."""
    placed = crowds.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("most")).withColumn("main", F.col("most.root")).withColumn("in_main", F.col("most.n"))
    # Two members in a bucket are a star and have been tried.
    mixed = mixed.filter("roots > 1 and members > 2")
    # Pairs inside the main component need no trial: members of the others meet all, main ones meet only others.
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    held = placed.join(mixed, "bucket").withColumn("query", F.col("root") != F.col("main"))
    held = held.withColumn("qs", tiles(F.col("members") - F.col("in_main"))).withColumn("ms", tiles(F.col("in_main")))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("query"), F.col("qs")).otherwise(F.col("ms"))).cast("int")
    held = held.withColumn("tile", F.when(F.col("query"), own).otherwise(F.col("qs") + own))
    met = F.expr("transform(sequence(0, if(query, qs + ms, qs) - 1), t -> struct(least(t, tile) as i, greatest(t, tile) as j))")
    dealt = held.select("bucket", "node", "root", "tile", F.explode(met).alias("at")).select("bucket", "at.i", "at.j", "node", "root", "tile")
    dealt = dealt.join(sets, "node")

    def links(pdf):
        here = {t: [(n, r, np.asarray(s)) for n, r, s in zip(g["node"], g["root"], g["shingles"], strict=True)] for t, g in pdf.groupby("tile")}
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        found = tile_links(here.get(i, []), None if i == j else here.get(j, []), percent) if i in here or j in here else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


    return dealt.groupBy("bucket", "i", "j").applyInPandas(links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, twin, n_shingles, component_id, kept) for every row of docs (doc_id, text); links from percent on."""
    docs = docs.select("doc_id", "text")
    sketch = stored(sketch_table(docs, percent), "sketch")
    classes = sketch.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "twin")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    rank = F.struct(F.xxhash64("node").alias("rank"), F.col("node"), F.col("n"))
    stars = members.groupBy("bucket").agg(F.min(rank).alias("hub"), F.count("*").alias("members")).filter("members > 1")
    crowds = stored(members.join(stars, "bucket").select("bucket", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "crowds")
    near = F.expr(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = stored(crowds.filter((F.col("node") != F.col("hub")) & near).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    chosen = nodes.join(crowds.select("node").distinct(), "node", "left_semi").select("node", F.col("one.doc_id").alias("id_"), F.col("one.twin").alias("twin_"))
    texts = docs.withColumn("twin", F.xxhash64("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("twin") == F.col("twin_"))).select("node", "text").dropDuplicates(["node"])
    sets = stored(full_sets(texts), "sets")
    links = stored(_confirmed(pairs, sets, percent), "links")
    roots = stored(components(links), "roots")
    missed = stored(_missed_links(crowds.select("bucket", "node"), roots, sets, percent), "missed")
    if not missed.isEmpty():
        roots = components(links.unionAll(missed))
    placed = nodes.select("node", "set_a", "set_b", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    by_set = placed.join(least, "root").select("set_a", "set_b", "component")
    joined = sketch.select("doc_id", "twin", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "twin", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the rows whose doc_id is its component's."""
    id_, twin_ = fresh(docs.columns, "id", "twin")
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("twin").alias(twin_)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & (F.xxhash64(docs["text"]) == gone[twin_]), "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT).select("doc_id", "n_shingles", "component_id", "kept")
