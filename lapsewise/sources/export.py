"""The derived raw rows as strict CSV files, the layout raw deliveries come in."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapsewise.schema import RAW_MEMBERS, RAW_TRANSACTIONS
from lapsewise.session import Scratch
from lapsewise.sources import warehouse

TRANSACTION_DATES = ["transaction_date", "membership_expire_date"]


def as_raw(df: DataFrame, schema: StructType, dates: list[str], copies: int = 1) -> DataFrame:
    """Dates as YYYYMMDD integers; with copies, every user that many times over."""
    if copies > 1:
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        df = df.withColumn("msno", F.concat_ws("-", F.col("msno"), F.col("copy")))
    for d in dates:
        df = df.withColumn(d, F.date_format(d, "yyyyMMdd"))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def _write_csv(df: DataFrame, path: str, rows: int, files: int) -> None:
    """df, of about so many rows, in at least so many files. Tasks write what they hold,
    in files of bounded length: rows are not shuffled once more for the number of files."""
    most = max(1, -(-rows // files))
    df.write.option("maxRecordsPerFile", most).csv(path, header=True)


def write_raw_transactions(
    spark: SparkSession, sf_dir: str, path: str, files: int, copies: int = 1
) -> None:
    """All raw transactions."""
    tx = as_raw(
        warehouse.raw_transactions(spark, sf_dir), RAW_TRANSACTIONS, TRANSACTION_DATES, copies
    )
    _write_csv(tx, path, warehouse.line_items(spark, sf_dir) * copies, files)


def write_raw_members(
    spark: SparkSession, sf_dir: str, path: str, files: int, copies: int = 1
) -> None:
    raw = warehouse.raw_members(spark, sf_dir)
    members = as_raw(raw, RAW_MEMBERS, ["registration_init_time"], copies)
    _write_csv(members, path, raw.count() * copies, files)


def write_raw(
    spark: SparkSession, sf_dir: str, folder: str, files: int, copies: int = 1
) -> None:
    """folder/transactions and folder/members, in at least so many files each."""
    write_raw_transactions(spark, sf_dir, f"{folder}/transactions", files, copies)
    write_raw_members(spark, sf_dir, f"{folder}/members", files, copies)


def write_deliveries(
    spark: SparkSession,
    sf_dir: str,
    folder: str,
    spans: dict[str, tuple[date, date]],
    files: int,
) -> None:
    """folder/<name> with the transactions of each span of days. The tables are joined
    once for all spans."""
    scratch = Scratch(spark)
    tx = scratch.write(warehouse.raw_transactions(spark, sf_dir), "raw-rows")
    rows = warehouse.line_items(spark, sf_dir)
    for name, (first, last) in spans.items():
        inside = tx.filter(F.col("transaction_date").between(F.lit(first), F.lit(last)))
        _write_csv(as_raw(inside, RAW_TRANSACTIONS, TRANSACTION_DATES), f"{folder}/{name}", rows, files)
    scratch.drop(tx)
