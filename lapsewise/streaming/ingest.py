"""Incremental ingestion: the batch transform, split and check, per micro-batch.

The published rows are the keyed state of de-duplication. They lie in one partition per
month of the transaction, a column that copies of a row share, so a batch is compared
with the history of its own months only, and readers find every row once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import cohort_month
from lapsewise.operators.checks import Check, date_sanity, run_checks
from lapsewise.operators.ingest import (
    deduplicate,
    source_counts,
    tag_quarantine,
    transform_transactions,
)
from lapsewise.schema import STAGED_TRANSACTIONS, TRANSACTION_COLUMNS
from lapsewise.session import remove_folder
from lapsewise.sources.raw import SOURCE
from lapsewise.sources.tables import read_table

STAGE = "raw->staged"

_ROWS = T.StructType(
    [
        *[T.StructField(f.name, f.dataType) for f in STAGED_TRANSACTIONS],
        T.StructField("quarantine_reason", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)
_SOURCES = (
    "source_file string, raw_rows long, quarantined long, staged_rows long, duplicates long, batch_id long"
)


def ingest_stream(
    raw: DataFrame, folder: str, params: Params = DEFAULT, log_path: str | None = None
) -> None:
    """Drain a stream of raw transactions into folder, then stop.

    Each batch is written under its own batch id, so that one repeated after a failure
    replaces itself, in the log of checks as well. The typed rows are landed and checked
    first; then rows that no earlier batch has published are written, and last the counts
    per source file, whose presence publishes the batch. A batch that fails raises, which
    stops the stream. The source bounds a batch, for files by maxFilesPerTrigger.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"batch_id={batch_id}"
        if SOURCE not in batch.columns:
            batch = batch.withColumn(SOURCE, F.lit(None).cast("string"))
        tag_quarantine(transform_transactions(batch, params)).write.mode("overwrite").parquet(
            f"{folder}/landed/{own}"
        )
        landed = read_table(spark, f"{folder}/landed/{own}")
        reason = F.col("quarantine_reason")
        clean = landed.filter(reason.isNull()).select(*TRANSACTION_COLUMNS)
        run_checks(
            f"{STAGE} batch {batch_id}", [Check("date_sanity", date_sanity(clean, params))],
            log_path, f"{STAGE} batch {batch_id}",
        )
        month = cohort_month("transaction_date")
        # At most as many values as the batch has months.
        touched = [r[0] for r in clean.select(month.alias("m")).distinct().collect()]
        known = _published(spark, folder).filter(
            F.col("month").isin(touched) & (F.col("batch_id") < batch_id) & reason.isNull()
        )
        fresh = deduplicate(clean).join(
            known.select(*[F.col(c).alias(f"_{c}") for c in TRANSACTION_COLUMNS]),
            _all_equal(TRANSACTION_COLUMNS), "left_anti",
        )
        rows = fresh.withColumn("quarantine_reason", F.lit(None).cast("string")).unionByName(
            landed.filter(reason.isNotNull()).select(*TRANSACTION_COLUMNS, "quarantine_reason")
        )
        rows.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(
            f"{folder}/rows/{own}"
        )
        source_counts(landed).coalesce(1).write.mode("overwrite").parquet(f"{folder}/published/{own}")
        remove_folder(spark, f"{folder}/landed/{own}")

    query = (
        raw.writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _all_equal(columns: list[str]) -> Column:
    equal = F.lit(True)
    for c in columns:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return equal


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A partitioned table by its known schema; no rows before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return spark.createDataFrame([], schema)


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per source file of every published batch."""
    return _read(spark, f"{folder}/published", _SOURCES)


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all published batches; none before the first one."""
    batches = stream_sources(spark, folder).select("batch_id").distinct()
    return _read(spark, f"{folder}/rows", _ROWS).join(batches, "batch_id", "left_semi")


def staged_from_stream(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(staged, quarantined) over all batches published so far."""
    rows = _published(spark, folder)
    reason = F.col("quarantine_reason")
    return (
        rows.filter(reason.isNull()).select(*TRANSACTION_COLUMNS),
        rows.filter(reason.isNotNull()).select(*TRANSACTION_COLUMNS, "quarantine_reason"),
    )
