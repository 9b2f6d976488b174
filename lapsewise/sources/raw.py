"""Raw CSV scans that fail on the first value or header they do not expect."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapsewise import schema


SOURCE = "source_file"


def _strict(reader, expected: StructType):
    """FAILFAST raises on a bad value of any column read (ingestion reads them all);
    enforceSchema=False raises on a header whose names or order differ."""
    return (
        reader.schema(expected)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )


def _strict_csv(spark: SparkSession, path: str | list[str], expected: StructType) -> DataFrame:
    return _strict(spark.read, expected).csv(path)


def with_source(raw: DataFrame) -> DataFrame:
    """raw with the path of the file each row was read from."""
    return raw.withColumn(SOURCE, F.col("_metadata.file_path"))


def read_raw_transactions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _strict_csv(spark, path, schema.RAW_TRANSACTIONS)


def stream_raw_transactions(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The files of a folder as a stream, under the contract of the batch scan: every
    file's header is compared when it is read. Rows name their file."""
    reader = _strict(spark.readStream, schema.RAW_TRANSACTIONS)
    return with_source(reader.option("maxFilesPerTrigger", files_per_batch).csv(path))


def read_raw_members(spark: SparkSession, path: str) -> DataFrame:
    return _strict_csv(spark, path, schema.RAW_MEMBERS)


def pick_source(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """The first transactions file that exists, in order of preference, with its
    path in source_file so that results from different files cannot be confused."""
    for path in candidates:
        try:
            df = read_raw_transactions(spark, path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        return with_source(df)
    raise FileNotFoundError(f"no transactions file among {candidates}")
