"""Figures of earlier runs, kept by version with the state of the tables they were taken of."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIGURES = "version int, state string, metric string, observed double"


def table_state(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    seen = []
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def recorded_figures(spark: SparkSession, folder: str) -> DataFrame:
    """(version, state, metric, observed) of every run recorded in folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FIGURES)
    return spark.read.schema(FIGURES).json(folder)


def compare_figures(observed: DataFrame, former: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, observed, expected, status) of this run's figures (metric, observed) beside
    a former run's: NEW where it had none, MATCH within the tolerance, else DRIFT. A figure
    without a value matches one without a value."""
    known = former.select("metric", F.col("observed").alias("expected"), F.lit(True).alias("known"))
    near = F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= tolerance, F.lit(False))
    return observed.join(known, "metric", "left").select(
        "metric", "observed", "expected",
        F.when(F.col("known").isNull(), "NEW")
        .when(near | F.col("observed").eqNullSafe(F.col("expected")), "MATCH")
        .otherwise("DRIFT").alias("status"),
    )


def record_figures(observed: DataFrame, folder: str, state: str, tolerance: float = 1e-9) -> DataFrame:
    """Compare figures with the latest run recorded in folder, then record them.

    observed has one row per metric. A version is a folder of its own, so a run that
    fails in between leaves nothing half written, and the comparison is of written rows.
    """
    spark = observed.sparkSession
    every = recorded_figures(spark, folder)
    latest = every.agg(F.max("version").alias("v")).first()["v"] or 0
    observed.select(
        F.lit(latest + 1).alias("version"), F.lit(state).alias("state"), "metric",
        F.col("observed").cast("double").alias("observed"),
    ).coalesce(1).write.json(f"{folder}/run={latest + 1}")
    written = recorded_figures(spark, folder)
    return compare_figures(
        written.filter(F.col("version") == latest + 1).select("metric", "observed"),
        written.filter(F.col("version") == latest), tolerance,
    )
