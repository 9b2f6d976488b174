"""First-spell revenue and what churned users did afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import days_between, ratio
from lapsewise.functions.columns import PLAN_TYPES


def _main_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.filter(
        (F.col("population") == "main") & (F.col("status") == "subject")
    )


REVENUE = [
    "msno", "plan_type", "first_spell_rev", "observed_days", "imputed_rev", "event",
]


def revenue_with_entry(subjects: DataFrame) -> DataFrame:
    """Revenue of paid rows of the first spell, with entry_days: both are columns of the
    subject table. Cancel rows are left out, not netted."""
    observed = days_between("spell_start_date", "end_date")
    return _main_subjects(subjects).withColumn("observed_days", observed).select(
        *REVENUE, "entry_days"
    )


def spell_revenue(subjects: DataFrame) -> DataFrame:
    return revenue_with_entry(subjects).select(*REVENUE)


def reactivation(subjects: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Users whose first spell ended in an observed churn. Later revenue is of all
    later spells, however late."""
    churned = F.col("event") & (F.col("end_date") <= F.lit(params.label_cutoff))
    return _main_subjects(subjects).filter(churned).select(
        "msno",
        "plan_type",
        F.col("end_date").alias("first_end_date"),
        F.col("first_return_date").isNotNull().alias("reactivated"),
        days_between("end_date", "first_return_date").alias("days_to_return"),
        "later_spell_rev",
        (F.col("n_spells") - 1).alias("n_later_spells"),
    )


def revenue_report(revenue: DataFrame) -> DataFrame:
    total, days = F.sum("first_spell_rev"), F.sum("observed_days")
    return (
        revenue.groupBy("plan_type")
        .agg(
            F.count("*").alias("subjects"),
            total.alias("revenue"),
            F.sum("imputed_rev").alias("imputed_revenue"),
            days.alias("observed_days"),
            ratio(total, days).alias("revenue_per_day"),
            ratio(F.sum("imputed_rev"), total).alias("imputed_share"),
        )
        .orderBy("plan_type")
    )


def _per_window(react: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Each row once per window, in a narrow step, so that all windows are one job."""
    return react.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))


def _returned() -> Column:
    return F.col("reactivated") & (F.col("days_to_return") <= F.col("window_days"))


def _full_followup(params: Params) -> Column:
    last_end = F.date_sub(F.lit(params.observation_cutoff), F.col("window_days"))
    return F.col("first_end_date") <= last_end


def reactivation_rates(react: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Over all churned users, including those not yet observable for the window."""
    return (
        _per_window(react, params.reactivation_windows)
        .groupBy("window_days")
        .agg(
            F.count("*").alias("churned_subjects"),
            F.avg(_returned().cast("int")).alias("reactivation_rate"),
            F.avg(F.when(_returned(), F.col("later_spell_rev"))).alias("mean_later_revenue"),
        )
        .orderBy("window_days")
    )


def reactivation_term(
    react: DataFrame,
    windows: tuple[int, ...],
    params: Params = DEFAULT,
    full_followup: bool = True,
) -> DataFrame:
    """Per stratum and window: P(return within window) times mean later revenue.

    With full_followup only users observable for the whole window count; the rest
    would bias the rate down.
    """
    exploded = _per_window(react, windows)
    if full_followup:
        exploded = exploded.filter(_full_followup(params))
    terms = exploded.groupBy("plan_type", "window_days").agg(
        F.count("*").alias("churned_subjects"),
        F.avg(_returned().cast("int")).alias("reactivation_rate"),
        F.coalesce(
            F.avg(F.when(_returned(), F.col("later_spell_rev"))), F.lit(0.0)
        ).alias("mean_revenue_per_reactivation"),
    )
    return terms.withColumn(
        "value", F.col("reactivation_rate") * F.col("mean_revenue_per_reactivation")
    )


def reactivation_detail(
    react: DataFrame, window: int = 365, params: Params = DEFAULT
) -> DataFrame:
    """Corrected and uncorrected rate by stratum."""
    full = _full_followup(params)
    detail = (
        _per_window(react.filter(F.col("plan_type").isin(PLAN_TYPES)), (window,))
        .groupBy("plan_type")
        .agg(
            F.count_if(full).alias("churned_subjects"),
            F.coalesce(
                F.avg(F.when(full, _returned().cast("int"))), F.lit(0.0)
            ).alias("reactivation_rate"),
            F.coalesce(
                F.avg(F.when(full & _returned(), F.col("later_spell_rev"))), F.lit(0.0)
            ).alias("mean_revenue_per_reactivation"),
            F.avg(_returned().cast("int")).alias("uncorrected_rate"),
        )
    )
    return detail.withColumn(
        "value", F.col("reactivation_rate") * F.col("mean_revenue_per_reactivation")
    ).orderBy("plan_type")


def reactivation_windows(react: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All strata, full follow-up: rate, mean revenue and median days to return."""
    return (
        _per_window(react, params.reactivation_windows)
        .filter(_full_followup(params))
        .groupBy("window_days")
        .agg(
            F.count("*").alias("churned_subjects"),
            F.avg(_returned().cast("int")).alias("reactivation_rate"),
            F.avg(F.when(_returned(), F.col("later_spell_rev"))).alias("mean_later_revenue"),
            F.median(F.when(_returned(), F.col("days_to_return"))).alias("median_days_to_return"),
        )
        .orderBy("window_days")
    )
