"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds (days) and names of the plan-length strata.
PLAN_BUCKETS = [(7, "01_<=7d"), (31, "02_8-31d"), (120, "03_32-120d")]
PLAN_LONG = "04_121d+"
PLAN_UNKNOWN = "unknown"
PLAN_TYPES = [name for _, name in PLAN_BUCKETS] + [PLAN_LONG]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yyyymmdd_to_date(c: Column | str) -> Column:
    """Strict YYYYMMDD integer to DATE: NULL stays NULL, anything unparseable raises.

    Integer arithmetic and make_date stay in generated code. The explicit error
    keeps the strictness when a session has ANSI mode off.
    """
    n = as_col(c).cast("int")
    day = F.make_date(
        (n / 10000).cast("int"), (n / 100).cast("int") % 100, n % 100
    )
    bad = F.raise_error(F.concat(F.lit("not a YYYYMMDD date: "), n.cast("string")))
    return (
        F.when(n.isNull(), F.lit(None).cast("date"))
        .when(~n.between(10000102, 99991231), bad.cast("date"))
        .otherwise(F.coalesce(day, bad.cast("date")))
    )


def null_sentinel(c: Column | str, sentinel: date) -> Column:
    return F.nullif(as_col(c), F.lit(sentinel))


def plan_type(plan_days: Column | str) -> Column:
    """Stratum of a plan length. NULL is a bucket of its own."""
    days = as_col(plan_days)
    bucket = F.when(days.isNull(), F.lit(PLAN_UNKNOWN))
    for upper, name in PLAN_BUCKETS:
        bucket = bucket.when(days <= upper, F.lit(name))
    return bucket.otherwise(F.lit(PLAN_LONG))


def cohort_month(d: Column | str) -> Column:
    return F.date_format(as_col(d), "yyyy-MM")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from start to end (negative when end is earlier)."""
    return F.datediff(as_col(end), as_col(start))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as DOUBLE that is NULL, not an error, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows equal to value. Rows with a missing value stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))
