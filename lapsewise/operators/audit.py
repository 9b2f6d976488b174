"""Profiles of the raw tables, before anything is repaired.

Input is the dated raw table (dates typed, sentinel still in place). Nothing here
orders a user's raw rows: "latest row" and "previous expiry" are answered from
combined counts, so a user with very many rows costs no single long task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import (
    cohort_month,
    days_between,
    pack_day_pair,
    ratio,
    unpack_flag,
    unpack_second_day,
)
from lapsewise.operators.ingest import merge_counts


def observation_window(tx: DataFrame, members: DataFrame) -> DataFrame:
    """One row: ranges and counts of both tables, from one aggregate over both."""
    both = tx.select(
        "msno", "transaction_date", "membership_expire_date",
        F.lit(None).cast("date").alias("registered"),
    ).unionByName(
        members.select(
            F.lit(None).alias("msno"),
            F.lit(None).cast("date").alias("transaction_date"),
            F.lit(None).cast("date").alias("membership_expire_date"),
            F.col("registration_init_time").alias("registered"),
        )
    )
    return both.agg(
        F.min("transaction_date").alias("min_tx"),
        F.max("transaction_date").alias("max_tx"),
        F.min("membership_expire_date").alias("min_expiry"),
        F.max("membership_expire_date").alias("max_expiry"),
        F.count("transaction_date").alias("n_rows"),
        F.count_distinct("msno").alias("n_users"),
        F.min("registered").alias("min_registration"),
        F.max("registered").alias("max_registration"),
        F.count("registered").alias("n_members"),
    ).withColumn("span_days", days_between("min_tx", "max_tx"))


def first_transactions(tx: DataFrame) -> DataFrame:
    return tx.groupBy("msno").agg(F.min("transaction_date").alias("first_transaction_date"))


def signup_cohorts(tx: DataFrame) -> DataFrame:
    """Users by month of first transaction, share, and the smallest and largest month
    (the earliest of equals)."""
    cohorts = (
        first_transactions(tx)
        .groupBy(cohort_month("first_transaction_date").alias("cohort_month"))
        .agg(F.count("*").alias("n_users"))
    )
    # One row per calendar month from here on.
    whole = Window.partitionBy(F.lit(0))
    smallest = F.min(F.struct("n_users", "cohort_month")).over(whole)["cohort_month"]
    largest = F.min(F.struct((-F.col("n_users")).alias("k"), "cohort_month")).over(whole)
    return cohorts.select(
        "cohort_month",
        "n_users",
        ratio(F.col("n_users"), F.sum("n_users").over(whole)).alias("share"),
        (F.col("cohort_month") == smallest).alias("is_smallest"),
        (F.col("cohort_month") == largest["cohort_month"]).alias("is_largest"),
    )


def registration_check(tx: DataFrame, members: DataFrame) -> DataFrame:
    """First transaction against registration, matched and unmatched users."""
    registered = F.col("registration_init_time")
    first = F.col("first_transaction_date")
    joined = first_transactions(tx).join(
        members.select("msno", "registration_init_time"), "msno", "left"
    )
    earlier = F.count_if(registered < first)
    return joined.agg(
        F.count(registered).alias("n_matched"),
        F.count_if(registered.isNull()).alias("n_unmatched"),
        earlier.alias("n_registered_earlier"),
        ratio(earlier, F.count(registered)).alias("share_registered_earlier"),
        F.median(days_between(registered, first)).alias("median_gap_days"),
    )


# Stands for an unknown expiry: earlier than any date the strict parser accepts.
UNKNOWN_DAY = date(1000, 1, 1)


def latest_transactions(tx: DataFrame) -> DataFrame:
    """Per user the expiry and cancel flag of the last row by (date, expiry, cancel).

    A row without an expiry counts only where the last day has no other row.
    """
    day, expiry = F.col("transaction_date"), F.col("membership_expire_date")
    cancelled = F.col("is_cancel").cast("boolean")
    known = pack_day_pair(day, F.coalesce(expiry, F.lit(UNKNOWN_DAY)), cancelled)
    latest = tx.groupBy("msno").agg(F.max(known).alias("last"), F.max(day).alias("last_day"))
    end = unpack_second_day(F.col("last"))
    return latest.select(
        "msno",
        "last_day",
        F.when(end > F.lit(UNKNOWN_DAY), end).alias("membership_expire_date"),
        unpack_flag(F.col("last")).alias("is_cancel"),
    )


def censoring_state(
    tx: DataFrame, params: Params = DEFAULT, as_of: date | None = None
) -> DataFrame:
    """Users active, undetermined (expired within the grace period) and churned at
    the last transaction date, or at as_of."""
    expiry = F.col("membership_expire_date")
    limit = F.date_sub(F.col("max_date"), params.grace_days)
    # Users counted by expiry: a row per day of the calendar, so that the last date of
    # all rows comes from the same scan.
    by_expiry = latest_transactions(tx).groupBy("membership_expire_date").agg(
        F.count("*").alias("users"),
        F.count_if(F.col("is_cancel")).alias("cancelled"),
        F.max("last_day").alias("last_day"),
    )
    last_day = (
        F.lit(as_of) if as_of else F.max("last_day").over(Window.partitionBy(F.lit(0)))
    )
    users = F.col("users")

    def those(inside: Column) -> Column:
        return F.coalesce(F.sum(F.when(inside, users)), F.lit(0))

    counts = by_expiry.withColumn("max_date", last_day).groupBy("max_date").agg(
        F.sum(users).alias("n_users"),
        those(expiry > F.col("max_date")).alias("n_active"),
        those((expiry <= F.col("max_date")) & (expiry > limit)).alias("n_undetermined"),
        those(expiry <= limit).alias("n_churned"),
        F.sum("cancelled").alias("n_last_is_cancel"),
    )
    return counts.withColumn(
        "censoring_rate", ratio(F.col("n_active") + F.col("n_undetermined"), F.col("n_users"))
    )


def price_audit(tx: DataFrame) -> DataFrame:
    paid, listed = F.col("actual_amount_paid"), F.col("plan_list_price")
    counts = tx.agg(
        F.count("*").alias("n_rows"),
        F.count_if(paid == listed).alias("n_match"),
        F.count_if(paid < listed).alias("n_under"),
        F.count_if(paid > listed).alias("n_over"),
        F.count_if((listed == 0) & (paid == 0)).alias("n_free"),
        F.count_if((listed < 0) | (paid < 0)).alias("n_negative"),
        F.count_if(F.col("payment_plan_days") <= 0).alias("n_nonpositive_days"),
    )
    return counts.withColumn(
        "mismatch_rate", ratio(F.col("n_under") + F.col("n_over"), F.col("n_rows"))
    )


def plan_grid(tx: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent (plan length, list price) pairs with price per day."""
    per_day = ratio(F.col("plan_list_price"), F.col("payment_plan_days"))
    return (
        tx.groupBy("payment_plan_days", "plan_list_price")
        .agg(F.count("*").alias("n"))
        .withColumn("price_per_day", F.round(per_day, 3))
        .orderBy(F.desc("n"), "payment_plan_days", "plan_list_price")
        .limit(k)
    )


def price_mismatch_sample(tx: DataFrame, k: int = 15) -> DataFrame:
    """k mismatching rows, the first in a total order of the shown columns."""
    shown = [
        "transaction_date", "payment_method_id", "payment_plan_days",
        "plan_list_price", "actual_amount_paid", "is_cancel",
    ]
    return (
        tx.filter(F.col("actual_amount_paid") != F.col("plan_list_price"))
        .select(*shown)
        .orderBy(*shown)
        .limit(k)
    )


def date_pairs(tx: DataFrame) -> DataFrame:
    """Rows counted by user and both dates."""
    return tx.groupBy("msno", "transaction_date", "membership_expire_date").agg(
        F.count("*").alias("rows")
    )


def return_gaps(tx: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(msno, gap_days, returns): rows landing more than the grace period after the
    expiry of the user's previous row, by (date, expiry).

    Rows equal in both dates are counted first. The first of them follows the
    previous pair of dates, the others follow an equal row. The window then runs
    over distinct pairs, whose number per user the calendar bounds.
    """
    pairs = date_pairs(tx)
    order = Window.partitionBy("msno").orderBy(
        "transaction_date", F.col("membership_expire_date").asc_nulls_last()
    )
    previous = F.lag("membership_expire_date").over(order)
    linked = pairs.withColumn("previous_expiry", previous)
    followers = F.array(
        F.struct(F.col("previous_expiry").alias("expiry"), F.lit(1).cast("long").alias("returns")),
        F.struct(
            F.col("membership_expire_date").alias("expiry"), (F.col("rows") - 1).alias("returns")
        ),
    )
    return (
        linked.select("msno", "transaction_date", F.explode(followers).alias("f"))
        .select(
            "msno",
            days_between(F.col("f.expiry"), "transaction_date").alias("gap_days"),
            F.col("f.returns").alias("returns"),
        )
        .filter((F.col("gap_days") > params.grace_days) & (F.col("returns") > 0))
    )


def resubscribers(tx: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row: users who lapsed past the grace period and came back."""
    gaps = return_gaps(tx, params)
    per_user = gaps.groupBy("msno").agg(
        F.sum("returns").alias("returns"), F.max("gap_days").alias("max_gap")
    )
    returned = per_user.agg(
        F.count("*").alias("n_resubscribers"),
        F.sum("returns").alias("n_return_events"),
        F.max("max_gap").alias("max_gap_days"),
    )
    # Weighted by the number of returns: the exact median over return events.
    middle = gaps.agg(F.percentile("gap_days", 0.5, F.col("returns")).alias("median_gap_days"))
    # From the pairs the gaps are taken of, so that Spark reuses their exchange.
    days = date_pairs(tx).groupBy("msno", "transaction_date").agg(F.sum("rows").alias("rows"))
    users = days.groupBy("msno").agg(
        F.sum("rows").alias("rows"), F.count_if(F.col("rows") > 1).alias("shared_days")
    ).agg(
        F.count("*").alias("total_users"),
        F.count_if(F.col("rows") > 1).alias("multi_users"),
        F.sum("shared_days").alias("same_day_user_days"),
    )
    return merge_counts(users, returned, middle).withColumns(
        {
            "share_of_all": ratio(F.col("n_resubscribers"), F.col("total_users")),
            "share_of_multi": ratio(F.col("n_resubscribers"), F.col("multi_users")),
        }
    )


def gap_histogram(tx: DataFrame, params: Params = DEFAULT) -> DataFrame:
    gap = F.col("gap_days")
    bucket = (
        F.when(gap <= 60, f"{params.grace_days}-60d")
        .when(gap <= 90, "61-90d")
        .when(gap <= 180, "91-180d")
        .when(gap <= 365, "181-365d")
        .otherwise("365d+")
    )
    return (
        return_gaps(tx, params)
        .groupBy(bucket.alias("bucket"))
        .agg(F.sum("returns").alias("n"), F.min(gap).alias("min_gap"))
        .orderBy("min_gap")
    )


def rows_by_month(tx: DataFrame) -> DataFrame:
    """Rows per month, share of all rows, and months counted from the last."""
    months = tx.groupBy(cohort_month("transaction_date").alias("month")).agg(
        F.count("*").alias("n")
    )
    whole = Window.partitionBy(F.lit(0))
    return months.select(
        "month",
        "n",
        ratio(F.col("n"), F.sum("n").over(whole)).alias("share"),
        F.row_number().over(whole.orderBy(F.desc("month"))).alias("months_from_end"),
    )


def final_month_shares(tx: DataFrame) -> DataFrame:
    months = rows_by_month(tx)
    last = F.col("months_from_end")
    return months.agg(
        F.max("month").alias("last_month"),
        F.sum("n").alias("total_rows"),
        F.sum(F.when(last == 1, F.col("share"))).alias("share_last_month"),
        F.sum(F.when(last <= 2, F.col("share"))).alias("share_final_two"),
    )


def _transactions_bucket(c: Column) -> Column:
    return (
        F.when(c == 1, "1").when(c == 2, "2").when(c <= 5, "3-5").when(c <= 10, "6-10")
        .otherwise("11+")
    )


def transactions_per_user(tx: DataFrame) -> DataFrame:
    per_user = tx.groupBy("msno").agg(F.count("*").alias("c"))
    histogram = per_user.groupBy(_transactions_bucket(F.col("c")).alias("bucket")).agg(
        F.count("*").alias("n_users"), F.min("c").alias("least")
    )
    total = F.sum("n_users").over(Window.partitionBy(F.lit(0)))
    return histogram.withColumn("share", ratio(F.col("n_users"), total)).orderBy("least")


def observed_span(tx: DataFrame) -> DataFrame:
    spans = tx.groupBy("msno").agg(
        days_between(F.min("transaction_date"), F.max("transaction_date")).alias("span")
    )
    return spans.agg(
        F.median("span").alias("median_span"),
        F.avg("span").alias("mean_span"),
        F.max("span").alias("max_span"),
    )


def date_anomalies(tx: DataFrame, far_future: date) -> DataFrame:
    day, expiry = F.col("transaction_date"), F.col("membership_expire_date")
    return tx.agg(
        F.count_if(expiry < day).alias("n_expiry_before_tx"),
        F.count_if(expiry == day).alias("n_expiry_eq_tx"),
        F.count_if(expiry > F.lit(far_future)).alias("n_expiry_far_future"),
    )
