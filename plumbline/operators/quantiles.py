"""Exact percentiles of a column of any size: bins are refined until those that hold the wanted ranks hold one value each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of an interval in a pass; the driver gets at most so many rows for each wanted rank.
BINS = 1024


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The exact percentiles at shares (0 to 1) of a double column, with linear interpolation between neighbours; nulls don't count, NaN is above all numbers; None without values.

    Each pass counts the values in equal bins of the intervals that still matter, a pre-aggregated sum, and keeps the bins in which a wanted rank
    lies, drawn in to the least and the greatest value in them. A pass narrows an interval by the number of bins, so that few are needed; df should be stored.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    whole = values.agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("nan")).first()
    fine = values.filter(~F.isnan("v"))
    n, numbers = whole["n"], whole["n"] - whole["nan"]
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = {r: math.nan for r in ranks if r >= numbers}
    open_ = [(None, None, 0, [r for r in ranks if r < numbers])]  # least and greatest value, values below, ranks
    if not open_[0][3]:
        open_ = []
    elif open_:
        low, high = fine.agg(F.min("v"), F.max("v")).first()
        open_ = [(low, high, 0, open_[0][3])]
    while open_:
        at = None
        for i, (low, high, _, _) in enumerate(open_):
            # An infinite end has a bin of its own; a range beyond the greatest double is measured in halves.
            part = 0.5 if math.isinf(high - low) else 1.0
            if math.isinf(low) or math.isinf(high):
                place = F.when(F.col("v") == -math.inf, 0).when(F.col("v") == math.inf, 3).when(F.col("v") < 0, 1).otherwise(2)
            else:
                place = F.least(F.floor((F.col("v") * part - low * part) / (high * part - low * part) * BINS), F.lit(BINS - 1)) if high > low else F.lit(0)
            inside = F.col("v").between(low, high)
            both = F.struct(F.lit(i).alias("i"), place.cast("int").alias("bin"))
            at = F.when(inside, both) if at is None else at.when(inside, both)
        counted = fine.withColumn("at", at).filter("at is not null").groupBy("at").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        new = []
        for i, (_, _, below, wanted) in enumerate(open_):
            for r in sorted((r for r in counted if r["at"]["i"] == i), key=lambda r: r["at"]["bin"]):
                here = [k for k in wanted if below <= k < below + r["n"]]
                if here and r["low"] == r["high"]:
                    found |= dict.fromkeys(here, r["low"])
                elif here:
                    new.append((r["low"], r["high"], below, here))
                below += r["n"]
        open_ = new
    out = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        part = p - math.floor(p)
        out.append(low if low == high else low * (1 - part) + high * part)
    return out


def with_percentiles(summary: DataFrame, df: DataFrame, column: str, named: dict[str, float]) -> DataFrame:
    """A summary of one row with percentiles of df's column as further columns."""
    cuts = percentiles(df, column, list(named.values()))
    return summary.withColumns({name: F.lit(v).cast("double") for name, v in zip(named, cuts, strict=True)})
