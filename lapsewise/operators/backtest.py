"""Forecast from a fit date, compare with what then happened, cell by cell."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import days_between
from lapsewise.operators.survival import event_table_of, km_confidence, km_curve, score_curves
from lapsewise.session import materialise


def censor_at(spells: DataFrame, fit_end: date) -> DataFrame:
    """The spell table as it could be known at fit_end: later starts and clocks are
    dropped, later ends become censored at fit_end."""
    fit = F.lit(fit_end)
    known = days_between("registration_date", fit)
    open_at_fit = F.col("end_date") > fit
    return (
        spells.filter((F.col("spell_start_date") <= fit) & (known > 0))
        .withColumns(
            {
                "tenure_days": F.when(open_at_fit, known).otherwise(F.col("tenure_days")),
                "event": F.col("event").cast("boolean") & ~open_at_fit,
            }
        )
        .filter(F.col("tenure_days") > F.col("entry_days"))
    )


def cohort_starts(spells: DataFrame) -> DataFrame:
    return spells.groupBy("cohort_month").agg(F.min("spell_start_date").alias("cohort_start"))


def eligible_cohorts(
    starts: DataFrame, horizons: tuple[int, ...], as_of: date
) -> DataFrame:
    """Cohorts whose whole horizon lies before as_of, one row per cohort and horizon."""
    return starts.withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))
    ).filter(_followed(as_of))


def _followed(as_of: date) -> Column:
    return days_between("cohort_start", F.lit(as_of)) >= F.col("horizon")


CELL = ["cohort_month", "plan_type"]
FULL, KNOWN = "full", "known"


def cell_events(spells: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Event days of every cell in two views, full and as known at the fit date, from one
    scan: (view, cohort_month, plan_type, t, entrance, removed, observed, first_start).

    Everything the backtest needs is a sum over these rows, which number cells x days:
    strata are sums over cohorts, and a cohort can be taken out of its stratum.
    """
    fit = F.lit(params.fit_window_end)
    known_days = days_between("registration_date", fit)
    open_at_fit = F.col("end_date") > fit
    event = F.col("event").cast("boolean")
    tenure = F.when(open_at_fit, known_days).otherwise(F.col("tenure_days"))
    is_known = (F.col("spell_start_date") <= fit) & (known_days > 0) & (tenure > F.col("entry_days"))

    def seen(view: str, tenure_days: Column, died: Column):
        return F.struct(
            F.lit(view).alias("view"), F.col("entry_days").alias("entry_days"),
            tenure_days.alias("tenure_days"), died.alias("event"),
        )

    views = F.array_compact(
        F.array(
            seen(FULL, F.col("tenure_days"), event),
            F.when(is_known, seen(KNOWN, tenure, event & ~open_at_fit)),
        )
    )
    each = spells.select(*CELL, "spell_start_date", F.explode(views).alias("v"))
    none = F.lit(0)
    sides = F.array(
        F.struct(F.col("v.entry_days").alias("t"), F.lit(1).alias("entrance"),
                 none.alias("removed"), none.alias("observed")),
        F.struct(F.col("v.tenure_days").alias("t"), none.alias("entrance"),
                 F.lit(1).alias("removed"), F.col("v.event").cast("int").alias("observed")),
    )
    return (
        each.select("v.view", *CELL, "spell_start_date", F.explode(sides).alias("x"))
        .groupBy("view", *CELL, F.col("x.t").alias("t"))
        .agg(
            F.sum("x.entrance").alias("entrance"), F.sum("x.removed").alias("removed"),
            F.sum("x.observed").alias("observed"), F.min("spell_start_date").alias("first_start"),
        )
    )


def _days(events: DataFrame, view: str, keys: list[str]) -> DataFrame:
    return events.filter(F.col("view") == view).groupBy(*keys, "t").agg(
        *[F.sum(c).alias(c) for c in ("entrance", "removed", "observed")]
    )


def _scored(
    days: DataFrame, keys: list[str], horizons: tuple[int, ...], params: Params, floor: int, name: str
) -> DataFrame:
    curves = km_confidence(km_curve(event_table_of(days, keys), keys, floor), params)
    return score_curves(curves, keys, horizons).withColumnsRenamed(
        {"survival": f"{name}_s", "rmst": f"{name}_rmst"}
    )


def _compared(
    events: DataFrame, forecast: DataFrame, keys: list[str], horizons: tuple[int, ...], params: Params
) -> DataFrame:
    """Each cell's own curve on the full data beside a forecast by keys and horizon."""
    realised = _scored(
        _days(events, FULL, CELL), CELL, horizons, params, params.min_cell_events, "realised"
    )
    truncated = F.sum(F.when(F.col("t") > 0, F.col("entrance")).otherwise(0))
    sizes = events.filter(F.col("view") == FULL).groupBy(*CELL).agg(
        F.sum("entrance").alias("n"),
        (truncated / F.sum("entrance")).alias("truncated_share"),
        F.min("first_start").alias("cell_start"),
    )
    # A cohort starts where its first cell does.
    start = F.min("cell_start").over(Window.partitionBy("cohort_month"))
    shares = sizes.withColumn("cohort_start", start).drop("cell_start")
    return (
        realised.join(shares, CELL)
        .filter(_followed(params.label_cutoff))
        .join(forecast, [*keys, "horizon"])
        .select(
            "horizon", "cohort_month", "plan_type", "n", "truncated_share",
            "forecast_s", "realised_s",
            (F.col("forecast_s") - F.col("realised_s")).alias("error_s"),
            F.abs(F.col("forecast_s") - F.col("realised_s")).alias("abs_error"),
            "forecast_rmst", "realised_rmst",
            (F.col("forecast_rmst") - F.col("realised_rmst")).alias("error_rmst"),
        )
    )


def backtest_cells(
    spells: DataFrame, horizons: tuple[int, ...], params: Params = DEFAULT
) -> DataFrame:
    """One row per horizon, cohort and stratum: the stratum's forecast fitted on the
    censored view against the cell's own curve on the full data."""
    events = materialise(cell_events(spells, params), "cell-events")
    keys = ["plan_type"]
    forecast = _scored(
        _days(events, KNOWN, keys), keys, horizons, params, params.min_events, "forecast"
    )
    return _compared(events, forecast, keys, horizons, params)


def without_own_cohort(events: DataFrame) -> DataFrame:
    """Event days, as known at the fit date, of every stratum without the subjects of one
    cohort, for each of its cohorts in turn: the stratum's counts less the cell's."""
    known = events.filter(F.col("view") == KNOWN)
    counts = ("entrance", "removed", "observed")
    own = known.select(*CELL, "t", *[F.col(c).alias(f"own_{c}") for c in counts])
    # Days of a stratum times its cohorts: bounded by the calendar, not by subjects.
    cells = events.filter(F.col("view") == FULL).select(*CELL).distinct()
    every = cells.join(_days(events, KNOWN, ["plan_type"]), "plan_type")
    rest = every.join(own, [*CELL, "t"], "left").select(
        *CELL, "t", *[(F.col(c) - F.coalesce(f"own_{c}", F.lit(0))).alias(c) for c in counts]
    )
    return rest.filter((F.col("entrance") > 0) | (F.col("removed") > 0))


def cells_out_of_sample(
    spells: DataFrame, horizons: tuple[int, ...], params: Params = DEFAULT
) -> DataFrame:
    """backtest_cells with forecasts that have not seen the cohort they are for. All come
    from one event table; no fit is repeated per cohort."""
    events = materialise(cell_events(spells, params), "cell-events")
    forecast = _scored(
        without_own_cohort(events), CELL, horizons, params, params.min_events, "forecast"
    )
    return _compared(events, forecast, CELL, horizons, params)


def _metrics(forecast: str, realised: str, prefix: str = "") -> list[Column]:
    """n, MAE and signed bias over pairs where both sides are numbers. Positive bias
    means more survival was forecast than occurred."""
    f, r = F.col(forecast).cast("double"), F.col(realised).cast("double")
    usable = f.isNotNull() & r.isNotNull() & ~F.isnan(f) & ~F.isnan(r)
    error = F.when(usable, f - r)
    return [
        F.count(error).alias(f"{prefix}n"),
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        F.avg(error).alias(f"{prefix}bias"),
    ]


def error_metrics(
    pairs: DataFrame,
    group: list[str] | None = None,
    forecast: str = "forecast_s",
    realised: str = "realised_s",
) -> DataFrame:
    return pairs.groupBy(*(group or [])).agg(*_metrics(forecast, realised))


def backtest_overall(cells: DataFrame) -> DataFrame:
    scored = error_metrics(cells, ["horizon"])
    return scored.withColumn(
        "verdict", F.when(F.col("bias") > 0, "optimistic").otherwise("pessimistic")
    )


def backtest_by_stratum(cells: DataFrame) -> DataFrame:
    return cells.groupBy("horizon", "plan_type").agg(
        *_metrics("forecast_s", "realised_s"),
        *_metrics("forecast_rmst", "realised_rmst", "rmst_"),
    ).drop("rmst_n")


def truncation_error(
    cells: DataFrame, params: Params = DEFAULT, group: list[str] | None = None
) -> DataFrame:
    """Correlation of truncation and error, NULL below two cells or without variance."""
    x, y = F.col("truncated_share"), F.col("abs_error")
    usable = cells.dropna(subset=["truncated_share", "abs_error"])
    sums = usable.groupBy(*(group or [])).agg(
        F.count("*").alias("n_cells"),
        F.min(x).alias("x_lo"), F.max(x).alias("x_hi"),
        F.min(y).alias("y_lo"), F.max(y).alias("y_hi"),
        F.covar_pop(x, y).alias("covariance"),
        F.stddev_pop(x).alias("x_sd"), F.stddev_pop(y).alias("y_sd"),
    )
    varied = (
        (F.col("n_cells") >= 2)
        & (F.col("x_lo") < F.col("x_hi"))
        & (F.col("y_lo") < F.col("y_hi"))
    )
    c = F.col("correlation")
    limit = params.correlation_threshold
    return sums.withColumn(
        "correlation",
        F.when(varied, F.try_divide("covariance", F.col("x_sd") * F.col("y_sd"))),
    ).select(
        *(group or []),
        "n_cells",
        "correlation",
        F.when(c.isNull(), "too_few_cells")
        .when(c > limit, "error_grows_with_truncation")
        .when(c < -limit, "error_falls_with_truncation")
        .otherwise("no_relationship")
        .alias("verdict"),
    )


def truncation_quartiles(cells: DataFrame) -> DataFrame:
    """Error by quartile of truncated_share: linear quantile edges, right-closed,
    the lowest value included, equal edges merged. The edges are a window over the cells,
    which are evaluated once; they number cohorts x strata."""
    x = F.col("truncated_share")
    quartiles = F.percentile(x, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    placed = cells.withColumn(
        "edges", F.array_distinct(quartiles.over(Window.partitionBy("horizon")))
    ).withColumn(
        "bucket", F.greatest(F.size(F.filter("edges", lambda e: e < x)) - 1, F.lit(0))
    )
    return (
        placed.filter(F.size("edges") > 1)
        .groupBy(
            "horizon", "bucket",
            F.get("edges", F.col("bucket")).alias("share_lo"),
            F.get("edges", F.col("bucket") + 1).alias("share_hi"),
        )
        .agg(*_metrics("forecast_s", "realised_s"))
    )


def worst_cells(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k largest absolute errors of each horizon, with a rank."""
    order = Window.partitionBy("horizon").orderBy(
        F.col("abs_error").desc(), "cohort_month", "plan_type"
    )
    return cells.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k
    ).select(
        "horizon", "rank", "cohort_month", "plan_type", "n", "truncated_share",
        "forecast_s", "realised_s", "error_s",
    )
