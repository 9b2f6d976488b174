"""Parquet tables and the validation log."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Create or replace."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_check_log(results: DataFrame, path: str, entry: str | None = None) -> None:
    """Check results are kept as JSON lines, a folder per entry; every entry adds to the
    history, and one written again (a batch or run that is retried) replaces itself."""
    name = re.sub(r"[^A-Za-z0-9_.-]+", "-", entry) if entry else uuid.uuid4().hex
    results.write.mode("overwrite").json(f"{path}/entry={name}")
