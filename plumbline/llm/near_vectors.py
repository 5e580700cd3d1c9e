"""Near-duplicate vectors by sorted projection passes (operator 12).

1. Each pass takes BITS random directions; the signs of a vector's projections, concatenated, are its key. Vectors are
   ordered by it, and each is compared with the WINDOW next ones in double precision. Numbers in the order come from range
   partitions and their sizes, so windows don't end where a partition does. Passes are as many as it takes to miss a pair at the
   least cosine with a chance of MISSED: two vectors meet where their keys agree in so many digits that a window's width of
   vectors agree in them, so passes grow with about the fourth root of the table (at 0.9).
2. Verified links of all passes are united: a task gives a forest of its links, one row a vector at most.
3. A window is bounded and a group of near vectors is not, so links inside a group are completed exactly: vectors nearer to the group's
   first vector than half the widest angle are all linked with each other, which needs no comparison; the others are
   compared with the whole group, block by block, and only counts leave a task.

Results hold no pair below the least cosine, and within a component no link is missing; what may be missed is a link between
components that no pass has found.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors meet only
vectors of their own dimension; rows alike in vec_id are rows of their own, and so linked where their vectors are near;
component_id is the least vec_id of the component that isn't null; a row with a null id is kept only where its component has no
other; components so large or so small that squares leave the range of doubles are scaled first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import new_path, release_shuffles, stored, table
from plumbline.llm.graph import components

COSINE = 0.9
BITS, WINDOW, MISSED = 48, 64, 0.02
#: Vectors of a window task, and of a step of its comparison.
BLOCK, STEP = 1024, 256
#: Passes whose copies of the vectors are dealt at once: disk holds so many.
PASSES_AT_ONCE = 3
#: Vectors that a completing task holds, and at most meets.
HELD, MET = 4096, 65_536
SAFE = 1e-9


def passes_for(n: int, cosine: float = COSINE) -> int:
    """Passes that miss a pair of that cosine with a chance of MISSED among n vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** math.log2(max(n / WINDOW, 1))
    return 1 if met > 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-met))


def units(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's vectors of one dimension, scaled to length one in doubles."""
    vectors = batch.column("v").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _runs(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of a batch in which columns are equal, and what they are."""
    if batch.num_rows:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(keys[:, a].tolist()), batch.slice(a, b - a)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """As _runs, over batches that are sorted by columns; for groups of bounded size."""
    held, of = [], None
    for batch in batches:
        for key, part in _runs(batch, *columns):
            if key != of and held:
                yield of, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            of = key
            held.append(part)
    if held:
        yield of, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(df: DataFrame) -> DataFrame:
    """(row, v, dim) of the rows of df (row, embedding) that may link."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False))).select("row", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))


def _keys(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """(row, dim, pass, key): the signs of BITS projections, the first one leading."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for (dim,), part in _runs(batch, "dim"):
                if dim not in lines:
                    lines[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))
                signs = (units(part) @ lines[dim] > 0).reshape(part.num_rows, passes, BITS)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * passes), pa.array((signs @ weights).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("dim"), keys], names=["row", "dim", "keys"])

    found = vectors.mapInArrow(rows, "row bigint, dim int, keys array<bigint>")
    return found.select("row", "dim", F.posexplode("keys").alias("pass", "key"))


def _ranked(keys: DataFrame) -> DataFrame:
    """(row, dim, pass, rank): each row's number in the order of its pass."""
    order = ("dim", "pass", "key", "row")
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    # This number holds the partition, and the place in it.
    placed = stored(dealt.select("row", "dim", "pass", F.monotonically_increasing_id().alias("at")), "order")
    part = F.expr("shiftright(at, 33)").alias("part")
    sizes = placed.groupBy("dim", "pass", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("dim", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("dim", "pass", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))  # a row a partition and pass
    return placed.withColumn("part", part).join(sizes, ["dim", "pass", "part"]).select("row", "dim", "pass", (F.col("at") + F.col("shift")).alias("rank"))


def _forest(one: np.ndarray, other: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links join: each place's row, and the row of the least place of its component."""
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[one], label[other])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, other, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return rows[moved], rows[label[moved]]


def window_links(unit: np.ndarray, owned: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, later place) of the linked pairs among each of the first `owned` vectors and the WINDOW next ones."""
    found = []
    for a in range(0, owned, STEP):
        b = min(a + STEP, owned)
        near = unit[a:b] @ unit[a : b + WINDOW].T >= cosine
        one, other = np.nonzero(near)
        apart = other - one
        fine = (apart > 0) & (apart <= WINDOW)
        found.append((one[fine] + a, other[fine] + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _pass_links(vectors: DataFrame, ranks: DataFrame, cosine: float) -> DataFrame:
    """(a, b): a forest of the links that the windows of these passes find."""
    block, place = F.expr(f"cast(rank div {BLOCK} as bigint)"), F.col("rank") % BLOCK
    # A block's tasks see the WINDOW first vectors of the next one too.
    dealt = ranks.join(vectors.select("row", "v"), "row").withColumn("block", F.explode(F.when((place < WINDOW) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))
    dealt = dealt.repartition("dim", "pass", "block").sortWithinPartitions("dim", "pass", "block", "rank")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, at), part in _groups(batches, "dim", "pass", "block"):
            owned = int((part.column("rank").to_numpy() < (at + 1) * BLOCK).sum())
            one, other = window_links(units(part), owned, cosine)
            a, b = _forest(one, other, part.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.select("dim", "pass", "block", "rank", "row", "v").mapInArrow(links, "a bigint, b bigint")


def linked(vectors: DataFrame, cosine: float = COSINE, seed: int = 0) -> DataFrame:
    """(node, root) of vectors (row, v, dim), stored, that some pass has linked; root: the least row of the component."""
    spark = vectors.sparkSession
    passes = passes_for(vectors.count(), cosine)
    ranks = stored(_ranked(_keys(vectors, passes, seed)), "ranks")
    edges = new_path(spark, "edges")
    for first in range(0, passes, PASSES_AT_ONCE):
        some = ranks.filter(F.col("pass").between(first, first + PASSES_AT_ONCE - 1))
        _pass_links(vectors, some, cosine).distinct().write.mode("append").parquet(edges)
        release_shuffles(spark)
    return stored(components(spark.read.schema("a bigint, b bigint").parquet(edges)), "linked")


def _near_first(groups: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(root, row, v, core): core where a vector is so near to its component's first one that all such ones are linked."""
    least = math.cos(math.acos(cosine) / 2) + SAFE
    with_first = groups.join(vectors.select(F.col("row").alias("node"), "v"), "node").join(vectors.select(F.col("row").alias("root"), F.col("v").alias("first")), "root")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _runs(batch, "dim"):
                first = pa.RecordBatch.from_arrays([part.column("first")], names=["v"])
                core = np.einsum("ij,ij->i", units(part), units(first)) >= least
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("row"), part.column("v"), pa.array(core)], names=["root", "row", "v", "core"])

    kind = dict(vectors.dtypes)["v"]
    return with_first.select("root", F.col("node").alias("row"), "v", "first", F.size("v").alias("dim")).mapInArrow(rows, f"root bigint, row bigint, v {kind}, core boolean")


def _completed(members: DataFrame, cosine: float) -> DataFrame:
    """(row, links): links of each of members (root, row, v, core) with the vectors of its component that aren't core, and theirs with all."""
    sizes = members.groupBy("root").agg(F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("outer"), F.count("*").alias("m")).filter("outer > 0")
    sizes = sizes.select("root", F.expr(f"cast(ceil(outer / {HELD}) as bigint)").alias("blocks"), F.expr(f"cast(ceil(m / {MET}) as bigint)").alias("parts"))
    sized, mixed = members.join(sizes, "root"), F.xxhash64("row")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    held = sized.filter(~F.col("core")).withColumn("block", F.pmod(mixed, F.col("blocks"))).withColumn("part", every("parts")).withColumn("met", F.lit(0))
    met = sized.withColumn("block", every("blocks")).withColumn("part", F.pmod(mixed, F.col("parts"))).withColumn("met", F.lit(1))
    columns = ("root", "block", "part", "met", "row", "core", "v")
    dealt = held.select(*columns).unionAll(met.select(*columns)).repartition("root", "block", "part").sortWithinPartitions("root", "block", "part", "met")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, outer, rows, links = None, [], None, None, None

        def counted(rows: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(links.astype(np.int64))], names=["row", "links"])

        for batch in batches:
            for (*key, is_met), part in _runs(batch, "root", "block", "part", "met"):
                if key != of:
                    if outer is not None:
                        yield counted(rows, links)
                    of, parts, outer = key, [], None
                if not is_met:
                    parts.append(part)
                    continue
                if not parts:  # no vector of the component falls in this block
                    continue
                if outer is None:
                    block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    outer, rows = units(block), block.column("row").to_numpy()
                    links = np.zeros(len(rows), dtype=np.int64)
                for a in range(0, part.num_rows, STEP):
                    some = part.slice(a, STEP)
                    near = outer @ units(some).T >= cosine
                    ids = some.column("row").to_numpy()
                    near &= rows[:, None] != ids[None]
                    links += near.sum(axis=1)
                    core = some.column("core").to_numpy(zero_copy_only=False)
                    yield counted(ids[core], near.sum(axis=0)[core])
        if outer is not None:
            yield counted(rows, links)

    return dealt.mapInArrow(count, "row bigint, links bigint").groupBy("row").agg(F.sum("links").alias("links"))


def near_vectors(df: DataFrame, cosine: float = COSINE, seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of df (vec_id, embedding)."""
    base = stored(df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")
    vectors = usable(base)
    groups = linked(vectors, cosine, seed)
    members = stored(_near_first(groups, vectors, cosine), "members")
    core = members.filter("core").groupBy("root").agg((F.count("*") - 1).alias("sure"))
    roots = groups.join(base.select("row", "vec_id"), groups["node"] == base["row"]).groupBy("root").agg(F.min("vec_id").alias("least"))
    facts = members.select("root", "row", "core").join(roots, "root").join(core, "root").join(_completed(members, cosine), "row", "left")
    links = F.coalesce("links", F.lit(0)) + F.when(F.col("core"), F.col("sure")).otherwise(0)
    out = base.select("row", "vec_id").join(facts.select("row", "least", links.alias("n")), "row", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
