"""Exact percentiles against numpy, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.operators.quantiles import exact_percentiles

WANTED = {"low": ("x", 0.0), "q1": ("x", 0.25), "mid": ("x", 0.5), "p90": ("x", 0.9), "top": ("x", 1.0),
          "other": ("y", 0.5)}


@pytest.mark.parametrize("seed", [4, 5])
def test_equals_numpy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(4000):
        group = rng.choice(["hot"] * 8 + ["a", None])
        x = None if rng.random() < 0.1 else rng.choice([rng.randrange(5), rng.randrange(10**6)])
        rows.append((group, x, rng.random() if group != "a" else None))
    rows.append(("single", 7, 1.5))
    rows.append(("empty", None, None))
    df = spark.createDataFrame(rows, "g string, x int, y double").repartition(5)
    got = exact_percentiles(df, ["g"], {"x": F.col("x"), "y": F.col("y")}, WANTED).collect()
    assert {r.g for r in got} == {"hot", "a", None, "single"}
    for r in got:
        for name, (measure, p) in WANTED.items():
            values = [row[1 if measure == "x" else 2] for row in rows if row[0] == r.g]
            values = [v for v in values if v is not None]
            want = np.quantile(values, p) if values else None
            assert r[name] == (want if want is None else pytest.approx(want)), (r.g, name)


def test_without_keys_and_without_rows(spark):
    df = spark.range(1, 8).select(F.col("id").alias("x"))
    wanted = {"mid": ("x", 0.5)}
    assert exact_percentiles(df, [], {"x": F.col("x")}, wanted).first().mid == 4.0
    none = exact_percentiles(df.filter("x > 99"), ["x"], {"x": F.col("x")}, wanted)
    assert none.count() == 0
