import math
import random

import numpy as np
import pytest

from plumbline.operators import quantiles as Q


@pytest.mark.parametrize("kind", ["normal", "ties", "huge", "tiny", "one", "skewed"])
def test_against_numpy(spark, kind, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 16)
    rng = random.Random(2)
    values = {
        "normal": [rng.gauss(0, 1) for _ in range(997)], "ties": [rng.choice([1.0, 1.0, 2.0, -0.0, 0.0]) for _ in range(300)], "huge": [rng.choice([-1, 1]) * rng.uniform(0, 1.7e308) for _ in range(200)],
        "tiny": [1.0 + k * 2.0**-52 for k in range(40)], "one": [3.5], "skewed": [10.0 ** rng.uniform(-300, 300) for _ in range(300)],
    }[kind]
    shares = [0.0, 0.05, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = Q.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", shares)
    ordered, want = np.sort(values), []
    for p in (s * (len(values) - 1) for s in shares):
        part = p - math.floor(p)
        want.append(float(ordered[math.floor(p)] * (1 - part) + ordered[math.ceil(p)] * part))
    assert got == pytest.approx(want, rel=1e-12)


def test_few_rows_reach_the_driver(spark, monkeypatch):
    """What a pass collects is bounded by the bins, whatever the rows."""
    monkeypatch.setattr(Q, "BINS", 8)
    seen, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(rows := collect(self)) or rows)
    got = Q.percentiles(spark.range(100_000).selectExpr("cast(id as double) / 3 as v"), "v", [0.25, 0.5])
    assert got == pytest.approx([24999.75 / 3, 49999.5 / 3])
    assert max(map(len, seen)) <= 8 * 4


def test_nan_infinity_and_none(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (2.0,)], "v double")
    got = Q.percentiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert Q.percentiles(df.filter("v < -5 and v > -6"), "v", [0.5]) == [None]
