"""Lifetime value = revenue per observed day x RMST + reactivation, as a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import days_between, ratio
from lapsewise.functions.columns import PLAN_UNKNOWN
from lapsewise.operators.revenue import reactivation_term
from lapsewise.operators.survival import fit_curves, rmst

VIEWS = ("full", "incident")


def _views(views: tuple[str, ...]) -> Column:
    """The views a subject belongs to: full always, incident when entry is zero."""
    picked = [
        F.when(F.lit(v == "full") | (F.col("entry_days") == 0), F.lit(v)) for v in views
    ]
    return F.array_compact(F.array(*picked))


def revenue_per_day(
    revenue: DataFrame, views: tuple[str, ...] = ("full",)
) -> DataFrame:
    """Ratio of sums per stratum and view, with and without imputed rows. revenue
    carries entry_days; a stratum without observed days earns zero."""
    total, days = F.sum("first_spell_rev"), F.sum("observed_days")
    per_day = ratio(total, days)
    clean = ratio(total - F.sum("imputed_rev"), days)
    return (
        revenue.withColumn("view", F.explode(_views(views)))
        .groupBy("view", "plan_type")
        .agg(
            F.count("*").alias("subjects"),
            F.coalesce(per_day, F.lit(0.0)).alias("rev_per_day"),
            F.coalesce(clean, F.lit(0.0)).alias("rev_per_day_ex_imputed"),
        )
    )


def rmst_range(
    subjects: DataFrame,
    horizons: tuple[int, ...],
    params: Params = DEFAULT,
    views: tuple[str, ...] = ("full",),
) -> DataFrame:
    """Lowest and highest RMST over three scenarios: the main population, with the
    excluded users, and without the least trusted channel. A stratum too thin for
    its main curve has no row."""
    main = F.col("population") == "main"
    trusted = main & ~F.col("registered_via").eqNullSafe(F.lit(params.sensitivity_channel))
    scenarios = F.array_compact(
        F.array(
            F.when(main, F.lit("main")),
            F.lit("with_excluded"),
            F.when(trusted, F.lit("without_channel")),
        )
    )
    keyed = (
        subjects.filter(
            (F.col("status") == "subject") & (F.col("plan_type") != PLAN_UNKNOWN)
        )
        .withColumn("view", F.explode(_views(views)))
        .withColumn("scenario", F.explode(scenarios))
    )
    keys = ["view", "scenario", "plan_type"]
    areas = rmst(fit_curves(keyed, keys, params), keys, horizons)
    return (
        areas.groupBy("view", "plan_type", "horizon")
        .agg(
            F.count_if(F.col("scenario") == "main").alias("main_fits"),
            F.min("rmst").alias("rmst_lo"),
            F.max("rmst").alias("rmst_hi"),
        )
        .filter(F.col("main_fits") > 0)
        .drop("main_fits")
    )


def ltv_table(
    subjects: DataFrame,
    react: DataFrame,
    horizons: tuple[int, ...],
    params: Params = DEFAULT,
    views: tuple[str, ...] = ("full",),
) -> DataFrame:
    """One row per view, stratum and horizon.

    The reactivation term is not restricted to the view. reliable says whether
    enough churned users could be observed for the whole horizon.
    """
    main = subjects.filter(
        (F.col("population") == "main") & (F.col("status") == "subject")
    ).withColumn("observed_days", days_between("spell_start_date", "end_date"))
    rates = revenue_per_day(main, views)
    areas = rmst_range(subjects, horizons, params, views)
    terms = reactivation_term(react, horizons, params).select(
        "plan_type",
        F.col("window_days").alias("horizon"),
        F.col("churned_subjects").alias("followed_churners"),
        F.col("value").alias("term"),
    )
    value = F.coalesce("term", F.lit(0.0))
    middle = (F.col("rmst_lo") + F.col("rmst_hi")) / 2
    rate = F.col("rev_per_day")
    followed = F.coalesce("followed_churners", F.lit(0))
    return (
        areas.join(rates, ["view", "plan_type"])
        .join(terms, ["plan_type", "horizon"], "left")
        .select(
            "view",
            "plan_type",
            "horizon",
            "subjects",
            "rev_per_day",
            "rmst_lo",
            "rmst_hi",
            (rate * F.col("rmst_lo") + value).alias("ltv_lo"),
            (rate * F.col("rmst_hi") + value).alias("ltv_hi"),
            (rate * middle).alias("spell1_mid"),
            value.alias("reactivation_value"),
            F.try_divide(value, rate * middle + value).alias("reactivation_share"),
            (rate * middle + value).alias("ltv_mid"),
            (F.col("rev_per_day_ex_imputed") * middle + value).alias("ltv_mid_ex_imputed"),
            (followed >= params.min_reliable_churners).alias("reliable"),
        )
    )


def ltv_report(subjects: DataFrame, react: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every horizon, for all subjects and for incident ones, in one job."""
    return ltv_table(subjects, react, params.ltv_horizons, params, VIEWS)


def clock_sensitivity(report: DataFrame) -> DataFrame:
    """Midpoint over all subjects against incident subjects, whose revenue and
    survival run on the same clock."""

    def mid(view: str) -> Column:
        return F.max(F.when(F.col("view") == view, F.col("ltv_mid")))

    both = report.groupBy("plan_type", "horizon").agg(
        mid("full").alias("ltv_mid_full"), mid("incident").alias("ltv_mid_incident")
    )
    shift = F.col("ltv_mid_incident") - F.col("ltv_mid_full")
    return both.filter(
        F.col("ltv_mid_full").isNotNull() & F.col("ltv_mid_incident").isNotNull()
    ).select(
        "*", shift.alias("difference"), F.try_divide(shift, F.col("ltv_mid_full")).alias("relative")
    )
