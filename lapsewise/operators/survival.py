"""Kaplan-Meier with delayed entry for any number of groups in one job.

Subjects are reduced at once to one row per group and day (map-side combined), so
the curves are windows over at most a few thousand rows per group, whatever the
number of subjects. Curves of several scenarios or groupings are told apart by key
columns, never by separate fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.config import DEFAULT, Params

POOLED = "pooled"


def event_days(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and day: entrance, removed and observed. Such counts of disjoint
    subjects add up, and those of a subset can be taken out again."""
    entry = F.struct(
        F.col("entry_days").alias("t"), F.lit(1).alias("entrance"),
        F.lit(0).alias("removed"), F.lit(0).alias("observed"),
    )
    leave = F.struct(
        F.col("tenure_days").alias("t"), F.lit(0).alias("entrance"),
        F.lit(1).alias("removed"), F.col("event").cast("int").alias("observed"),
    )
    return (
        subjects.select(*keys, F.explode(F.array(entry, leave)).alias("x"))
        .groupBy(*keys, F.col("x.t").alias("t"))
        .agg(
            F.sum("x.entrance").alias("entrance"),
            F.sum("x.removed").alias("removed"),
            F.sum("x.observed").alias("observed"),
        )
    )


def event_table(subjects: DataFrame, keys: list[str]) -> DataFrame:
    return event_table_of(event_days(subjects, keys), keys)


def event_table_of(days: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and day: entrance, removed, observed, censored, at_risk, population.

    population leaves out those entering on the day itself, except on the first
    day of the group: they are not at risk for the deaths of that day.
    """
    by_day = _group(keys).orderBy("t")
    entered = F.sum("entrance").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    left = F.sum("removed").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    return (
        days.withColumn("censored", F.col("removed") - F.col("observed"))
        .withColumn("at_risk", entered - F.coalesce(left, F.lit(0)))
        .withColumn(
            "population",
            F.when(F.row_number().over(by_day) == 1, F.col("at_risk")).otherwise(
                F.col("at_risk") - F.col("entrance")
            ),
        )
    )


def _group(keys: list[str]):
    # An ungrouped curve is one partition of days, already reduced.
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def km_curve(events: DataFrame, keys: list[str], min_events: int = 0) -> DataFrame:
    """S(t) and the group's n and events; groups below min_events have no curve."""
    whole = _group(keys)
    running = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("observed"), F.col("population")
    survived = F.when(d == 0, F.lit(1.0)).otherwise(1 - F.try_divide(d, n))
    hazard = F.when(d == 0, F.lit(0.0)).when(n > d, d / (n * (n - d)))
    return (
        events.withColumn("n", F.sum("entrance").over(whole))
        .withColumn("events", F.sum("observed").over(whole))
        .filter(F.col("events") >= min_events)
        .withColumn("survival", F.product(survived).over(running))
        .withColumn("hazard_var", F.sum(hazard).over(running))
        .withColumn(
            "variance", F.when(F.col("survival") > 0, F.col("hazard_var"))
        )
        .drop("hazard_var")
    )


def km_confidence(curve: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Log-log band: one at S=1, NULL at S=0."""
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    log_s = F.log(F.when(inside, s))
    width = params.confidence_z * F.sqrt("variance") / F.abs(log_s)

    def bound(sign: int) -> Column:
        return F.when(s == 1, F.lit(1.0)).when(inside, F.pow(s, F.exp(sign * width)))

    return curve.withColumns({"lower": bound(1), "upper": bound(-1)})


def fit_curves(
    subjects: DataFrame, keys: list[str], params: Params = DEFAULT,
    min_events: int | None = None,
) -> DataFrame:
    """Event table, curve and band of every group of keys."""
    floor = params.min_events if min_events is None else min_events
    return km_confidence(km_curve(event_table(subjects, keys), keys, floor), params)


def fit_by(
    subjects: DataFrame, columns: list[str], params: Params = DEFAULT
) -> DataFrame:
    """Pooled curve and one family of curves per column, in one pass.

    Keys of the result: grouping (pooled or a column name) and level.
    """
    levels = [F.struct(F.lit(POOLED).alias("grouping"), F.lit("all").alias("level"))] + [
        F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("level"))
        for c in columns
    ]
    keyed = subjects.withColumn("g", F.explode(F.array(*levels))).select(
        "g.grouping", "g.level", "entry_days", "tenure_days", "event"
    )
    return fit_curves(keyed, ["grouping", "level"], params)


# --- reading curves ---------------------------------------------------------------


def _first_below_half(c: str) -> Column:
    return F.min(F.when(F.col(c) <= 0.5, F.col("t")))


def _medians() -> list[Column]:
    return [
        F.max("n").alias("n"),
        F.max("events").alias("events"),
        _first_below_half("survival").alias("median_days"),
        _first_below_half("lower").alias("median_lower"),
        _first_below_half("upper").alias("median_upper"),
    ]


def median_survival(curve: DataFrame, keys: list[str]) -> DataFrame:
    """First day with S at or below one half, and the same on each band edge. NULL
    means never reached."""
    return curve.groupBy(*keys).agg(*_medians())


def _per_horizon(df: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    return df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))


def _last_point(horizon: Column) -> Column:
    """The curve's row at the last day at or before horizon."""
    point = F.struct("t", "survival", "lower", "upper", "at_risk")
    return F.max(F.when(F.col("t") <= horizon, point))


def _survival_of(point: str) -> Column:
    return F.coalesce(F.col(f"{point}.survival"), F.lit(1.0))


def _at_risk_of(point: str) -> Column:
    return F.coalesce(F.col(f"{point}.at_risk"), F.lit(0))


def survival_at(
    curve: DataFrame, keys: list[str], horizons: tuple[int, ...]
) -> DataFrame:
    """S, band and number at risk at the last day at or before each horizon.

    Before a group's first day S is 1 and nobody is at risk.
    """
    return (
        _per_horizon(curve, horizons)
        .groupBy(*keys, "horizon")
        .agg(_last_point(F.col("horizon")).alias("last"))
        .select(
            *keys,
            "horizon",
            _survival_of("last").alias("survival"),
            _at_risk_of("last").alias("at_risk"),
            "last.lower",
            "last.upper",
        )
    )


def describe_curves(
    curve: DataFrame, keys: list[str], params: Params = DEFAULT
) -> DataFrame:
    """One row per curve: n, events, median with interval, S and at-risk by horizon."""
    points = {h: f"last_{h}" for h in params.km_horizons}
    read = curve.groupBy(*keys).agg(
        *_medians(), *[_last_point(F.lit(h)).alias(name) for h, name in points.items()]
    )
    wide = []
    for h, name in points.items():
        wide += [_survival_of(name).alias(f"s_{h}"), _at_risk_of(name).alias(f"at_risk_{h}")]
    return read.select(
        *keys, "n", "events", "median_days", "median_lower", "median_upper", *wide
    )


def _steps(curve: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    by_day = _group(keys).orderBy("t")
    return curve.select(
        *keys, "t", "survival", *columns,
        F.lead("t").over(by_day).alias("next_t"),
        (F.row_number().over(by_day) == 1).alias("is_first"),
    )


def _area() -> Column:
    h = F.col("horizon")
    width = F.greatest(F.least(F.coalesce("next_t", h), h) - F.col("t"), F.lit(0))
    leading = F.when(F.col("is_first"), F.least("t", h)).otherwise(0)
    return F.sum(F.col("survival") * width + leading)


def rmst(curve: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Area under the step curve up to each horizon, S=1 before the first day and
    flat after the last."""
    steps = _per_horizon(_steps(curve, keys), horizons)
    return steps.groupBy(*keys, "horizon").agg(_area().alias("rmst"))


def score_curves(curve: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """S and RMST together, so that the curves are built once."""
    steps = _steps(curve, keys, "lower", "upper", "at_risk")
    return (
        _per_horizon(steps, horizons)
        .groupBy(*keys, "horizon")
        .agg(_last_point(F.col("horizon")).alias("last"), _area().alias("rmst"))
        .select(*keys, "horizon", _survival_of("last").alias("survival"), "rmst")
    )


# --- comparisons -------------------------------------------------------------------


def truncation_profile(spells: DataFrame, column: str = "plan_type") -> DataFrame:
    truncated = F.col("entry_days") > 0
    return spells.groupBy(column).agg(
        F.count("*").alias("n"),
        F.avg(truncated.cast("int")).alias("truncated_share"),
        F.median("entry_days").alias("median_entry"),
        F.median(F.when(truncated, F.col("entry_days"))).alias("median_entry_truncated"),
        F.count_if(~truncated).alias("incident"),
    )


def crossing_differences(
    at: DataFrame, level: str, scope: list[str] | None = None
) -> DataFrame:
    """S of one level minus S of every later level, per horizon. at holds one row per
    curve and horizon (survival_at), so this pairs curves, not subjects."""
    scope = scope or []
    a = at.select(*scope, "horizon", F.col(level).alias("level_a"), F.col("survival").alias("s_a"))
    b = at.select(*scope, "horizon", F.col(level).alias("level_b"), F.col("survival").alias("s_b"))
    return (
        a.join(b, [*scope, "horizon"])
        .filter(F.col("level_a") < F.col("level_b"))
        .select(
            *scope, "level_a", "level_b", "horizon",
            (F.col("s_a") - F.col("s_b")).alias("difference"),
        )
    )


def crossing_check(differences: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Two curves cross when their difference takes both signs on the horizon grid."""
    d = F.col("difference")
    return differences.groupBy(*(scope or []), "level_a", "level_b").agg(
        F.count_if(d > 1e-9).alias("horizons_above"),
        F.count_if(d < -1e-9).alias("horizons_below"),
        ((F.count_if(d > 1e-9) > 0) & (F.count_if(d < -1e-9) > 0)).alias("crossed"),
    )


def incident_only_check(
    spells: DataFrame, level_a: str, level_b: str, params: Params = DEFAULT
) -> DataFrame:
    """One row: does the crossing of two strata survive without delayed entry?"""
    pair = spells.filter(F.col("plan_type").isin(level_a, level_b))
    incident = F.col("entry_days") == 0
    subsets = F.when(incident, F.array(F.lit("full"), F.lit("incident"))).otherwise(
        F.array(F.lit("full"))
    )
    keyed = pair.withColumn("subset", F.explode(subsets))
    keys = ["subset", "plan_type"]
    at = survival_at(fit_curves(keyed, keys, params), keys, params.km_horizons)
    crossings = crossing_check(
        crossing_differences(at, "plan_type", ["subset"]), ["subset"]
    )

    def crossed(subset: str) -> Column:
        return F.max(F.when(F.col("subset") == subset, F.col("crossed")))

    sizes = keyed.groupBy("subset").agg(F.count("*").alias("n"))
    both = sizes.join(crossings, "subset", "left").agg(
        F.max(F.when(F.col("subset") == "full", F.col("n"))).alias("full_subjects"),
        F.max(F.when(F.col("subset") == "incident", F.col("n"))).alias("incident_subjects"),
        crossed("full").alias("crossed_full"),
        crossed("incident").alias("crossed_incident"),
    )
    verdict = (
        F.when(
            F.col("crossed_full").isNull() | F.col("crossed_incident").isNull(),
            "not_applicable",
        )
        .when(F.col("crossed_incident"), "product_effect")
        .when(F.col("crossed_full"), "truncation_artefact")
        .otherwise("no_crossing")
    )
    return both.withColumn("verdict", verdict)


def bracket_subjects(subjects: DataFrame) -> DataFrame:
    """Subjects once per scenario they belong to: upper (main population) and lower
    (main and excluded, the latter entering at zero)."""
    main = F.col("population") == "main"
    scenarios = F.when(main, F.array(F.lit("upper"), F.lit("lower"))).otherwise(
        F.array(F.lit("lower"))
    )
    return subjects.filter(F.col("status") == "subject").withColumn(
        "scenario", F.explode(scenarios)
    )


def exclusion_curves(subjects: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return fit_curves(bracket_subjects(subjects), ["scenario"], params)


def exclusion_bracket(curves: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per horizon: S of both ends of the bracket and its width in points."""
    at = survival_at(curves, ["scenario"], params.km_horizons)
    ends = at.groupBy("horizon").agg(
        F.max(F.when(F.col("scenario") == "upper", F.col("survival"))).alias("upper"),
        F.max(F.when(F.col("scenario") == "lower", F.col("survival"))).alias("lower"),
    )
    return ends.filter(F.col("upper").isNotNull() & F.col("lower").isNotNull()).withColumn(
        "width_pp", (F.col("upper") - F.col("lower")) * 100
    )


def value_exclusion_sensitivity(
    spells: DataFrame, column: str, value, params: Params = DEFAULT
) -> DataFrame:
    """S with and without the subjects carrying one value, against the band of the
    full fit and against a fixed materiality threshold."""
    curves = value_exclusion_curves(spells, column, value, params)
    at = survival_at(curves, ["scenario"], params.km_horizons)

    def of(scenario: str, c: str) -> Column:
        return F.max(F.when(F.col("scenario") == scenario, F.col(c)))

    pairs = (
        at.groupBy("horizon")
        .agg(
            of("all", "survival").alias("s_all"),
            of("without", "survival").alias("s_without"),
            of("all", "lower").alias("lower"),
            of("all", "upper").alias("upper"),
            of("all", "at_risk").alias("seen"),
        )
        .filter(F.col("s_without").isNotNull() & (F.col("seen") > 0))
    )
    diff = (F.col("s_without") - F.col("s_all")) * 100
    outside = (F.col("s_without") < F.col("lower")) | (F.col("s_without") > F.col("upper"))
    largest = F.max(F.abs("diff_pp")).over(Window.partitionBy(F.lit(0)))
    return (
        pairs.withColumn("diff_pp", diff)
        .withColumn("relative", F.try_divide(F.col("diff_pp"), F.col("s_all") * 100))
        .withColumn("outside_band", F.coalesce(outside, F.lit(False)))
        .withColumn("max_shift_pp", largest)
        .withColumn("material", F.col("max_shift_pp") >= params.material_pp)
        .drop("seen")
    )


def value_exclusion_curves(
    spells: DataFrame, column: str, value, params: Params = DEFAULT
) -> DataFrame:
    """Curves of all subjects, and of those that do not carry the value."""
    kept = ~F.col(column).eqNullSafe(F.lit(value))
    scenarios = F.array_compact(F.array(F.lit("all"), F.when(kept, F.lit("without"))))
    return fit_curves(spells.withColumn("scenario", F.explode(scenarios)), ["scenario"], params)


def value_exclusion_counts(spells: DataFrame, column: str, value) -> DataFrame:
    """How many subjects carry the value, and their share."""
    carries = F.col(column).eqNullSafe(F.lit(value)).cast("int")
    return spells.agg(
        F.count("*").alias("subjects"), F.coalesce(F.sum(carries), F.lit(0)).alias("excluded"),
        F.avg(carries).alias("excluded_share"),
    )


def subset_curves(spells: DataFrame, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """Curves by keys of all subjects (full) and of those followed from the start
    (incident), side by side under subset."""
    subsets = F.array_compact(
        F.array(F.lit("full"), F.when(F.col("entry_days") == 0, F.lit("incident")))
    )
    both = spells.withColumn("subset", F.explode(subsets))
    return fit_curves(both, ["subset", *keys], params)
