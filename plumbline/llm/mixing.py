"""Mixing sources to target weights (operator 3).

Every document gets a hash-random key. Within a source the keys are range-partitioned by their leading bits (the keys are
uniform, so the ranges' borders are known without sampling), each range is sorted, and prefix sums over ranges and inside
ranges place every document on its source's line of words. A source's budget cuts that line: whole rounds first (epochs),
then the exact remainder, which may end inside a document.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order; rows with equal
doc_id and size are interchangeable; an empty table gives no rows; further columns are ignored by `mix_plan` and kept by
`apply_mix`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import arrow_map, fresh, stored, table
from plumbline.llm.words import BLANK_SPLIT

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Leading hex digits of the key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def _counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, from the column's own bytes."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros(len(texts), dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        last = False
        for at in range(a, b, 1 << 22):
            word = BLANK_SPLIT[data[at : min(b, at + (1 << 22))]]
            out[i] += np.count_nonzero(word[1:] & ~word[:-1]) + int(word[0] and not last)
            last = bool(word[-1])
    return out


def with_sizes(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """docs with the number of `[^\\x20\\x09-\\x0D]+` in its text in a further column."""

    def rows(batch: pa.RecordBatch):
        n = pa.array(_counts(batch.column(text)), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, size])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, rows, f"{fields}, `{size}` bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): no target above max_epochs sizes, the excess by weight.

    Ranks of sources come from a range sort and its partitions' counts; the common level of the uncapped sources is found
    by rounds of sums over the sources. Only one number for each partition and round reaches the driver.
    """
    spark = sizes.sparkSession
    ranked = stored(
        sizes.withColumn("is_null", F.col("source").isNull())
        .repartitionByRange("is_null", "source")
        .sortWithinPartitions("is_null", "source")
        .select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")),
        "sources",
    )
    before, places = 0, {}
    for part, n in sorted(map(tuple, ranked.groupBy("part").count().collect())):
        places[part], before = before, before + n
    first = F.coalesce(*[F.when(F.col("part") == p, F.lit(n)) for p, n in places.items()]) if places else F.lit(0)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(first + F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.withColumn("weight", turn.cast("double"))
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        free = F.col("weight") * F.lit(level) < cap if capped >= 0 else cap > 0
        got = weighed.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, cap)), F.sum(F.when(~free, 1).otherwise(0))).first()
        if got[2] is None or got[2] == capped or not got[0]:
            break
        level, capped = (total - (got[1] or 0.0)) / got[0], got[2]
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def _key(row_id: str, seed: int) -> Column:
    """32 uniform hex digits, the same in every SQL dialect; null ids get one of their own."""
    return F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def mix_plan(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, extra columns, size, source_size, target, taken) for every row of docs (doc_id, text, source)."""
    sized = with_sizes(docs.select("doc_id", "source", *extra, "text")).drop("text")
    sized = stored(sized.withColumn("key", _key("doc_id", seed)).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    lines = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target")
    placed = sized.alias("d").join(lines.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.range") == F.col("l.range")))
    inside = Window.partitionBy("d.source", "d.range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("doc_id", F.col("d.source").alias("source"), *extra, "size", "source_size", "target", (F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", *extra, "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def first_words(text: str, n: int) -> str:
    """text up to the end of its n-th word."""
    at = 0
    for at in (m.end() for m, _ in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), range(n))):  # noqa: B007, B905
        pass
    return text[:at]


def apply_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed documents: each row as often as its whole rounds, then once more cut to the words of a partial round.

    Rows alike in doc_id, source and text share evenly (rounded down) what the plan gives them together.
    """
    id_, source_, twin_, taken_, size_ = fresh(docs.columns, "id", "source", "twin", "taken", "size")
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("twin"))
    plan = mix_plan(keyed, seed, extra=("twin",)).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("twin").alias(twin_))
    plan = plan.agg(F.floor(F.sum("taken") / F.count("*")).alias(taken_), F.max("size").alias(size_)).filter(F.col(taken_) > 0)
    names = docs.columns
    on = docs["doc_id"].eqNullSafe(plan[id_]) & docs["source"].eqNullSafe(plan[source_]) & (F.xxhash64(docs["text"]) == plan[twin_])
    joined = docs.join(plan, on).select(*[docs[c] for c in names], taken_, size_)

    def rows(batch: pa.RecordBatch):
        take, text, chars = [], [], []
        texts = batch.column("text").to_pylist()
        for i, (n, size) in enumerate(zip(batch.column(taken_).to_pylist(), batch.column(size_).to_pylist(), strict=True)):
            whole, part = divmod(n, size)
            copies = [texts[i]] * whole + ([first_words(texts[i], part)] if part else [])
            take += [i] * len(copies)
            text += copies
            chars += map(len, copies)
        for a in range(0, len(take), 1000):
            out = batch.select(names).take(pa.array(take[a : a + 1000], pa.int32()))
            for column, values in (("text", text), ("n_chars", chars)):
                if column in names:
                    k = names.index(column)
                    out = out.set_column(k, out.schema.field(k), pa.array(values[a : a + 1000], out.schema.field(k).type))
            yield out

    return arrow_map(joined, rows, docs.schema)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
