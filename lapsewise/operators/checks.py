"""Expectations on tables. A check observes; it never repairs.

Each check is a one-row frame of observed figures plus `passed`, from one
aggregate. run_checks evaluates all of them, logs all of them, then raises if a
FAIL check did not pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapsewise.config import DEFAULT, Params
from lapsewise.operators.ingest import merge_counts
from lapsewise.sources.tables import append_check_log

WARN, FAIL = "warn", "fail"


class ValidationError(RuntimeError):
    """A FAIL check did not pass."""


@dataclass(frozen=True)
class Check:
    name: str
    frame: DataFrame
    severity: str = FAIL


def _require(df: DataFrame, check: str, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{check} requires columns, missing: {missing}")


def as_result(check: Check, stage: str) -> DataFrame:
    """The common log shape: observed figures as a map of doubles."""
    observed = []
    for c in check.frame.columns:
        if c != "passed":
            observed += [F.lit(c), F.col(c).cast("double")]
    return check.frame.select(
        F.lit(check.name).alias("name"),
        F.lit(stage).alias("stage"),
        "passed",
        F.lit(check.severity).alias("severity"),
        F.create_map(*observed).alias("observed"),
        F.current_timestamp().alias("checked_at"),
    )


def run_checks(
    stage: str,
    checks: list[Check | Callable[[], Check]],
    log_path: str | None = None,
    entry: str | None = None,
) -> list[Row]:
    """All checks in one job, then the log, then the verdict. One row per check.

    entry names these results in the log: when they are logged again under one name, by
    a batch or run that is retried, they replace the former ones."""
    built = [c() if callable(c) else c for c in checks]
    results = None
    for check in built:
        row = as_result(check, stage)
        results = row if results is None else results.unionByName(row)
    rows = results.collect()
    if log_path:
        logged = results.sparkSession.createDataFrame(rows, results.schema)
        append_check_log(logged.coalesce(1), log_path, entry)
    failed = [r["name"] for r in rows if not r["passed"] and r["severity"] == FAIL]
    if failed:
        raise ValidationError(f"stage {stage!r} failed: {', '.join(failed)}")
    return rows


def row_count_reconciliation(
    counts: DataFrame, raw: str, staged: str, drops: list[str]
) -> DataFrame:
    """raw = staged + the sum of the logged drops, exactly. counts is one row; a
    negative count is an error in the caller, not a failed check."""
    _require(counts, "row_count_reconciliation", raw, staged, *drops)
    difference = F.col(raw) - F.col(staged)
    total = F.lit(0).cast("long")
    for d in drops:
        total = total + F.col(d)
    negative = F.lit(False)
    for c in (raw, staged, *drops):
        negative = negative | (F.col(c) < 0)
    return counts.select(
        F.when(negative, F.raise_error(F.lit("row counts cannot be negative")).cast("long"))
        .otherwise(F.col(raw))
        .alias("raw_rows"),
        F.col(staged).alias("staged_rows"),
        difference.alias("difference"),
        total.alias("logged_drops_total"),
        (difference - total).alias("unexplained"),
        (difference == total).alias("passed"),
    )


def date_figures(params: Params = DEFAULT, where: Column | None = None) -> list[Column]:
    """The aggregates of date_sanity, over the rows satisfying where."""
    inside = F.lit(True) if where is None else where
    day, expiry = F.col("transaction_date"), F.col("membership_expire_date")
    sentinel = F.coalesce(expiry == F.lit(params.epoch_sentinel), F.lit(False))
    backwards = F.coalesce(~sentinel & (expiry < day), F.lit(False))
    cancelled = F.col("is_cancel").cast("int") == 1
    outside = (day < F.lit(params.window_open)) | (day > F.lit(params.observation_cutoff))
    figures = {
        "rows_checked": F.lit(True),
        "null_expiry": expiry.isNull(),
        "epoch_sentinel_expiry": sentinel,
        "expiry_before_transaction_cancelled": backwards & cancelled,
        "expiry_before_transaction_not_cancelled": backwards & ~cancelled,
        "transaction_date_out_of_window": outside,
    }
    return [F.count_if(inside & c).alias(name) for name, c in figures.items()]


def date_verdict(figures: DataFrame) -> DataFrame:
    """Sentinels, backwards expiries without a cancellation and dates outside the
    window fail. NULL expiries and backdated cancellations are counted only."""
    return figures.withColumn(
        "passed",
        (F.col("epoch_sentinel_expiry") == 0)
        & (F.col("expiry_before_transaction_not_cancelled") == 0)
        & (F.col("transaction_date_out_of_window") == 0),
    )


def date_sanity(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    _require(df, "date_sanity", "transaction_date", "membership_expire_date", "is_cancel")
    return date_verdict(df.agg(*date_figures(params)))


def censoring_rate(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Either extreme means the labelling did not run. An empty table is an error."""
    _require(df, "censoring_rate", "event")
    counts = df.agg(
        F.count("*").alias("rows"), F.sum(F.col("event").cast("int")).alias("events")
    )
    n = F.when(F.col("rows") > 0, F.col("rows")).otherwise(
        F.raise_error(F.lit("censoring_rate cannot run on an empty table")).cast("long")
    )
    rate = (F.col("n_subjects") - F.col("n_events")) / F.col("n_subjects")
    return (
        counts.select(n.alias("n_subjects"), F.coalesce("events", F.lit(0)).alias("n_events"))
        .withColumn("n_censored", F.col("n_subjects") - F.col("n_events"))
        .withColumn("censoring_rate", rate)
        .withColumn(
            "passed", F.col("censoring_rate").between(params.min_censoring, params.max_censoring)
        )
    )


def duplicate_rows(
    df: DataFrame, key: tuple[str, ...] = ("msno", "transaction_date")
) -> DataFrame:
    """Surplus exact copies fail; rows sharing only the key are counted."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    keyed = set(key) <= set(df.columns)
    # Rows per key are summed from the copies: one scan for both questions.
    found = copies.groupBy(*(key if keyed else df.columns)).agg(
        F.sum("copies").alias("rows"), F.sum(F.col("copies") - 1).alias("surplus")
    )
    shared = F.when(F.lit(keyed) & (F.col("rows") > 1), F.col("rows"))
    return found.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_checked"),
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(shared), F.lit(0)).alias("same_day_user_rows"),
    ).withColumn("passed", F.col("exact_duplicates") == 0)


def price_reconciliation(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Amount paid against list price on the staged table. Negative amounts, or a
    mismatch rate above the bound, do not pass; meant as a WARN check."""
    paid, listed = F.col("actual_amount_paid"), F.col("list_price")
    observed = df.agg(
        F.count("*").alias("rows_checked"),
        F.count_if(paid == listed).alias("n_match"),
        F.count_if(paid < listed).alias("n_under"),
        F.count_if(paid > listed).alias("n_over"),
        F.count_if((paid < 0) | (listed < 0)).alias("n_negative"),
    )
    off = F.try_divide(F.col("n_under") + F.col("n_over"), F.col("rows_checked"))
    return observed.withColumn("mismatch_rate", F.coalesce(off, F.lit(0.0))).withColumn(
        "passed",
        (F.col("n_negative") == 0) & (F.col("mismatch_rate") <= params.max_price_mismatch),
    )


def schema_columns(df: DataFrame, expected: StructType) -> DataFrame:
    """One row per column of either side: both types, NULLs found, and whether the
    column has the expected type and no NULL it must not have."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f for f in expected}
    names = list(wanted) + [n for n in actual if n not in wanted]
    nulls = df.agg(
        *[
            (F.count_if(F.col(n).isNull()) if n in actual else F.lit(None).cast("long")).alias(n)
            for n in names
        ]
    )
    rows = []
    for n in names:
        kind = wanted[n].dataType.simpleString() if n in wanted else None
        typed = n in wanted and actual.get(n) == kind
        must_fill = n in wanted and not wanted[n].nullable
        rows.append(
            F.struct(
                F.lit(n).alias("column"),
                F.lit(kind).cast("string").alias("expected_type"),
                F.lit(actual.get(n)).cast("string").alias("actual_type"),
                F.col(n).alias("nulls"),
                (F.lit(typed) & (F.lit(not must_fill) | F.coalesce(F.col(n) == 0, F.lit(False)))).alias(
                    "passed"
                ),
            )
        )
    return nulls.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def schema_conformance(df: DataFrame, expected: StructType) -> DataFrame:
    return schema_columns(df, expected).agg(
        F.count("*").alias("columns_checked"),
        F.count_if(~F.col("passed")).alias("columns_failed"),
    ).withColumn("passed", F.col("columns_failed") == 0)


def unique_key(df: DataFrame, key: list[str]) -> DataFrame:
    """A join key that must not repeat, or the join would invent rows."""
    counts = df.groupBy(*key).agg(F.count("*").alias("rows"))
    return counts.agg(
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("rows") > 1).alias("repeated_keys"),
    ).withColumn("passed", F.col("repeated_keys") == 0)


def mart_counts(users: DataFrame, members: DataFrame, counts: DataFrame) -> DataFrame:
    """Staged users (one row each) against the outcomes of spell_counts, with those
    lacking a member row counted from the tables, not as a remainder."""
    staged_users = users.agg(F.count("*").alias("staged_users"))
    unmatched = users.join(members.select("msno"), "msno", "left_anti").agg(
        F.count("*").alias("without_member_row")
    )
    return merge_counts(
        staged_users,
        unmatched,
        counts.select(
            "subjects", "null_spell_end", "starts_after_label_cutoff",
            "negative_tenure", "entry_after_exit",
        ),
    )


MART_DROPS = [
    "without_member_row", "null_spell_end", "starts_after_label_cutoff",
    "negative_tenure", "entry_after_exit",
]


def reconcile_marts(users: DataFrame, members: DataFrame, counts: DataFrame) -> DataFrame:
    return row_count_reconciliation(
        mart_counts(users, members, counts), "staged_users", "subjects", MART_DROPS
    )


def headline_figures(
    spells: DataFrame, pooled_median: DataFrame, overall: DataFrame, horizon: int
) -> DataFrame:
    """(metric, observed) for subjects, pooled median days and backtest MAE."""
    return (
        spells.agg(F.lit("subjects").alias("metric"), F.count("*").cast("double").alias("observed"))
        .unionByName(
            pooled_median.select(
                F.lit("pooled_median_days").alias("metric"),
                F.col("median_days").cast("double").alias("observed"),
            )
        )
        .unionByName(
            overall.filter(F.col("horizon") == horizon).select(
                F.lit("backtest_mae").alias("metric"), F.col("mae").alias("observed")
            )
        )
    )
