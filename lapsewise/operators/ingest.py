"""Raw to staged: typing, sentinel nulling, imputation, quarantine, de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql.window import Window

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import days_between, null_sentinel, yyyymmdd_to_date
from lapsewise.schema import MEMBER_COLUMNS, TRANSACTION_COLUMNS
from lapsewise.sources.raw import SOURCE

QUARANTINE_REASON = "expiry_before_transaction_not_cancelled"


def type_dates(df: DataFrame, *columns: str) -> DataFrame:
    """YYYYMMDD integers to dates. A source that already has dates is left alone."""
    raw = [c for c in columns if not isinstance(df.schema[c].dataType, DateType)]
    return df.withColumns({c: yyyymmdd_to_date(c) for c in raw}) if raw else df


def date_transactions(raw: DataFrame) -> DataFrame:
    """Only the dates typed: the shape the audits profile, sentinel included."""
    return type_dates(raw, "transaction_date", "membership_expire_date")


def impute_zero_day(df: DataFrame) -> DataFrame:
    """Recover plan length and price of rows whose plan fields were left at zero.

    The length comes from the dates, and only where the row extends membership;
    otherwise it stays NULL. plan_days_imputed marks every such row.
    """
    zero = F.col("payment_plan_days") == 0
    gained = days_between("transaction_date", "membership_expire_date")
    return df.withColumns(
        {
            "plan_days_imputed": zero,
            "plan_days": F.when(zero, F.when(gained > 0, gained)).otherwise(
                F.col("payment_plan_days")
            ),
            "list_price": F.when(zero, F.col("actual_amount_paid")).otherwise(
                F.col("plan_list_price")
            ),
        }
    )


def transform_transactions(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Raw layout to the staged columns, before quarantine and de-duplication. A column
    that names the source of each row is carried along."""
    return _typed(raw, params).select(
        *TRANSACTION_COLUMNS, *[c for c in (SOURCE,) if c in raw.columns]
    )


def _typed(raw: DataFrame, params: Params) -> DataFrame:
    """All columns of both layouts, and whether an expiry was the sentinel."""
    dated = date_transactions(raw).withColumn(
        "was_sentinel",
        F.coalesce(F.col("membership_expire_date") == F.lit(params.epoch_sentinel), F.lit(False)),
    ).withColumn(
        "membership_expire_date",
        null_sentinel("membership_expire_date", params.epoch_sentinel),
    )
    return impute_zero_day(dated).withColumns(
        {
            "is_auto_renew": F.col("is_auto_renew").cast("boolean"),
            "is_cancel": F.col("is_cancel").cast("boolean"),
        }
    )


def tag_quarantine(df: DataFrame) -> DataFrame:
    """quarantine_reason is set where an expiry precedes its transaction without a
    cancellation (a cancellation may backdate), and NULL everywhere else."""
    backwards = (
        F.col("membership_expire_date") < F.col("transaction_date")
    ) & ~F.col("is_cancel")
    return df.withColumn(
        "quarantine_reason", F.when(backwards, F.lit(QUARANTINE_REASON))
    )


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined). Every input row is in exactly one of the two."""
    tagged = tag_quarantine(df)
    reason = F.col("quarantine_reason")
    return tagged.filter(reason.isNull()).drop("quarantine_reason"), tagged.filter(
        reason.isNotNull()
    )


def deduplicate(df: DataFrame) -> DataFrame:
    """One copy of every distinct row. Copies are combined before the shuffle."""
    return df.dropDuplicates()


def stage_transactions(
    raw: DataFrame, params: Params = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(staged, quarantined). Quarantine comes first: quarantined copies are kept."""
    clean, quarantined = split_quarantine(transform_transactions(raw, params))
    return deduplicate(clean.select(*TRANSACTION_COLUMNS)), quarantined


def source_counts(tagged: DataFrame) -> DataFrame:
    """Rows of every source of a tagged table: read, quarantined, staged, and surplus
    copies. A row delivered by several sources is staged from the first in name order.

    Equal rows meet once, by their columns; a source is a key of the counts only.
    """
    clean = F.col("quarantine_reason").isNull()
    rows = tagged.groupBy(*TRANSACTION_COLUMNS, "quarantine_reason", SOURCE).agg(
        F.count("*").alias("n")
    )
    alike = Window.partitionBy(*TRANSACTION_COLUMNS, "quarantine_reason")
    first = F.col(SOURCE) == F.min(SOURCE).over(alike)
    return rows.withColumn("staged", (clean & first).cast("long")).groupBy(SOURCE).agg(
        F.sum("n").alias("raw_rows"),
        F.sum(F.when(clean, 0).otherwise(F.col("n"))).alias("quarantined"),
        F.sum("staged").alias("staged_rows"),
        F.sum(F.when(clean, F.col("n") - F.col("staged")).otherwise(0)).alias("duplicates"),
    )


def stage_members(raw: DataFrame) -> DataFrame:
    return type_dates(raw, "registration_init_time").select(*MEMBER_COLUMNS)


def ingest_counts(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row: raw, staged, quarantined, sentinels_nulled, duplicates.

    Duplicates are counted as surplus copies, not as a difference of totals, so
    that reconciliation compares independent figures.
    """
    copies = tag_quarantine(_typed(raw, params)).groupBy(
        *TRANSACTION_COLUMNS, "quarantine_reason"
    ).agg(
        F.count("*").alias("copies"), F.count_if(F.col("was_sentinel")).alias("sentinels")
    )
    clean = F.col("quarantine_reason").isNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return copies.agg(
        total(F.col("copies")).alias("raw_rows"),
        total(F.col("sentinels")).alias("sentinels_nulled"),
        F.count_if(clean).alias("staged_rows"),
        total(F.when(~clean, F.col("copies"))).alias("quarantined"),
        total(F.when(clean, F.col("copies") - 1)).alias("duplicates"),
    )


def merge_counts(*parts: DataFrame) -> DataFrame:
    """One-row frames of figures side by side, without a join."""
    types = {f.name: f.dataType for part in parts for f in part.schema}
    stacked = reduce(
        DataFrame.unionByName,
        [
            part.select(
                *[
                    F.col(n) if n in part.columns else F.lit(None).cast(t).alias(n)
                    for n, t in types.items()
                ]
            )
            for part in parts
        ],
    )
    return stacked.agg(*[F.max(n).alias(n) for n in types])
