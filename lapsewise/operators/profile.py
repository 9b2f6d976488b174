"""Analyses behind the modelling decisions, over the staged and subject tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapsewise.config import DEFAULT, Params
from lapsewise.functions import cohort_month, days_between, ratio
from lapsewise.operators.audit import censoring_state
from lapsewise.operators.backtest import cohort_starts, eligible_cohorts
from lapsewise.operators.ingest import merge_counts
from lapsewise.operators.quantiles import exact_percentiles
from lapsewise.operators.spells import churn_observed
from lapsewise.operators.survival import fit_curves, survival_at


def _is_subject() -> Column:
    return (F.col("population") == "main") & (F.col("status") == "subject")


def censoring_walk(
    staged: DataFrame, subjects: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """From "is the user subscribed now" to "did the first spell end", step by step:
    A last transaction at the observation cutoff, B first spell, C label cutoff,
    D retained subjects only."""
    last = censoring_state(staged, params, params.observation_cutoff).select(
        F.lit("A").alias("step"),
        F.col("n_users").alias("n"),
        (F.col("n_active") + F.col("n_undetermined")).alias("censored"),
    )

    def step(name: str, inside: Column, event: Column) -> Column:
        return F.struct(
            F.lit(name).alias("step"),
            F.count_if(inside).alias("n"),
            F.count_if(inside & ~event).alias("censored"),
        )

    ended = F.col("raw_end_date").isNotNull()
    rest = subjects.agg(
        F.array(
            step("B", ended, churn_observed(params.observation_cutoff, params)),
            step("C", ended, churn_observed(params.label_cutoff, params)),
            step("D", _is_subject(), F.col("event")),
        ).alias("steps")
    ).select(F.explode("steps").alias("s")).select("s.*")
    rate = ratio(F.col("censored"), F.col("n"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("step")
    return (
        last.unionByName(rest)
        .withColumn("censoring_rate", rate)
        .withColumn("delta", F.col("censoring_rate") - F.lag("censoring_rate").over(in_order))
    )


def exclusion_reasons(subjects: DataFrame) -> DataFrame:
    """Users that are not subjects, each under one reason."""
    open_end = F.col("status") == "null_spell_end"
    reason = (
        F.when(F.col("population") == "excluded", "no_member_row")
        .when(open_end & (F.col("n_paid_rows") == 0), "every_transaction_is_cancellation")
        .when(open_end & F.col("last_noncancel_date").isNull(), "first_spell_only_cancellations")
        .when(open_end, "first_spell_without_known_expiry")
        .otherwise(F.col("status"))
    )
    return (
        subjects.filter(~_is_subject())
        .groupBy(reason.alias("reason"))
        .agg(F.count("*").alias("users"))
        .orderBy("reason")
    )


def _group() -> Column:
    return F.when(F.col("population") == "excluded", "no_member_row").when(
        _is_subject(), "retained"
    )


def excluded_profile(subjects: DataFrame, method: int, params: Params = DEFAULT) -> DataFrame:
    """Users without a member row beside retained subjects, on observables and on
    first-spell outcomes clocked from the first transaction."""
    is_outcome = F.col("status") == "subject"
    tenure = days_between("spell_start_date", "end_date")
    grouped = subjects.withColumn("group", _group()).filter(F.col("group").isNotNull())
    seen = grouped.groupBy("group").agg(
        F.count("*").alias("users"),
        F.avg(F.col("first_auto_renew").cast("int")).alias("auto_renew_share"),
        F.avg((F.col("first_method") == method).cast("int")).alias("method_share"),
        F.avg(F.when(is_outcome, F.col("event").cast("int"))).alias("event_rate"),
    )
    middles = exact_percentiles(
        grouped, ["group"],
        {
            "amount": F.col("first_amount"), "rows": F.col("n_rows"),
            "tenure": F.when(is_outcome, tenure),
        },
        {
            "median_first_amount": ("amount", 0.5), "median_transactions": ("rows", 0.5),
            "median_tenure": ("tenure", 0.5),
        },
    )
    outcomes = grouped.filter(is_outcome).select(
        "group", F.lit(0).alias("entry_days"), tenure.alias("tenure_days"), "event"
    )
    at = survival_at(fit_curves(outcomes, ["group"], params), ["group"], (90, 365))
    running = at.groupBy("group").agg(
        *[
            F.max(F.when(F.col("horizon") == h, F.col("survival"))).alias(f"s_{h}")
            for h in (90, 365)
        ]
    )
    return seen.join(middles, "group", "left").join(running, "group", "left")


def excluded_cohorts(subjects: DataFrame) -> DataFrame:
    """Each cohort's share among users without a member row beside its share among
    retained subjects, and the group it is over-represented in (NULL if in neither).
    ratio is NULL where a cohort has no retained subject."""
    grouped = subjects.withColumn("group", _group()).filter(F.col("group").isNotNull())
    counts = grouped.groupBy("cohort_month").agg(
        F.count_if(F.col("group") == "no_member_row").alias("excluded"),
        F.count_if(F.col("group") == "retained").alias("retained"),
    )
    # One row per cohort from here on.
    whole = Window.partitionBy(F.lit(0))
    shares = counts.withColumns(
        {
            f"{g}_share": ratio(F.col(g), F.sum(g).over(whole)) for g in ("excluded", "retained")
        }
    )
    # Compared as whole numbers: shares that differ only by rounding are equal.
    more = F.col("excluded") * F.sum("retained").over(whole)
    fewer = F.col("retained") * F.sum("excluded").over(whole)
    return shares.withColumn(
        "over_represented_in",
        F.when(more > fewer, "no_member_row").when(more < fewer, "retained"),
    ).withColumn("ratio", ratio(F.col("excluded_share"), F.col("retained_share")))


def lag_by_channel(subjects: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Days from registration to first transaction, by channel, among users registered
    inside the window; with the channel's weight among truncated subjects."""
    inside = F.col("registration_date") >= F.lit(params.window_open)
    lag = F.when(inside, days_between("registration_date", "spell_start_date"))
    truncated = _is_subject() & (F.col("entry_days") > 0)
    main = subjects.filter(F.col("population") == "main")
    by_channel = main.groupBy("registered_via").agg(
        F.count(lag).alias("n"),
        F.avg((lag == 0).cast("int")).alias("same_day_share"),
        F.count_if(truncated).alias("n_truncated"),
    )
    edges = exact_percentiles(
        main, ["registered_via"], {"lag": lag},
        {n: ("lag", p) for n, p in (("p10", 0.1), ("median_lag", 0.5), ("p75", 0.75), ("p90", 0.9))},
    ).withColumnRenamed("registered_via", "channel")
    # One row per channel from here on.
    total = F.sum("n_truncated").over(Window.partitionBy(F.lit(0)))
    return by_channel.join(
        edges, F.col("registered_via").eqNullSafe(F.col("channel")), "left"
    ).select(
        "registered_via", "n", "p10", "median_lag", "p75", "p90",
        "same_day_share", "n_truncated",
        ratio(F.col("n_truncated"), total).alias("truncated_weight"),
    )


def lag_reweighted(subjects: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Mean of the channel medians under the truncated subjects' channel mix, against
    their median accrued tenure."""
    weight = F.when(F.col("median_lag").isNotNull(), F.col("truncated_weight"))
    lag = lag_by_channel(subjects, params).agg(
        ratio(F.sum(weight * F.col("median_lag")), F.sum(weight)).alias("weighted_median_lag")
    )
    entry = subjects.filter(_is_subject() & (F.col("entry_days") > 0)).agg(
        F.count("*").alias("truncated_subjects"), F.median("entry_days").alias("median_entry")
    )
    return merge_counts(lag, entry).withColumn(
        "overstatement", ratio(F.col("weighted_median_lag"), F.col("median_entry"))
    )


def zero_day_profile(staged: DataFrame) -> DataFrame:
    """Imputed rows and all rows by month, payment method, duration and amount."""
    dimensions = {
        "month": cohort_month("transaction_date"),
        "payment_method": F.col("payment_method_id").cast("string"),
        "plan_days": F.col("plan_days").cast("string"),
        "amount": F.col("actual_amount_paid").cast("string"),
    }
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), value.alias("value"))
            for name, value in dimensions.items()
        ]
    )
    zero = F.count_if(F.col("plan_days_imputed"))
    return (
        staged.select("plan_days_imputed", F.explode(pairs).alias("d"))
        .groupBy("d.dimension", "d.value")
        .agg(
            zero.alias("zero_day_rows"),
            F.count("*").alias("all_rows"),
            ratio(zero, F.count("*")).alias("zero_day_share"),
        )
        .filter(F.col("zero_day_rows") > 0)
    )


def truncation_by_cohort(spells: DataFrame) -> DataFrame:
    truncated = F.col("entry_days") > 0
    shares = spells.groupBy("cohort_month").agg(
        F.count("*").alias("n"), F.avg(truncated.cast("int")).alias("truncated_share")
    )
    edges = exact_percentiles(
        spells, ["cohort_month"], {"entry": F.when(truncated, F.col("entry_days"))},
        {n: ("entry", p) for n, p in (("p25", 0.25), ("median_entry", 0.5), ("p75", 0.75), ("p90", 0.9))},
    )
    return shares.join(edges, "cohort_month", "left").select(
        "cohort_month", "n", "truncated_share", "p25", "median_entry", "p75", "p90"
    )


def eligible_by_horizon(
    spells: DataFrame, horizons: tuple[int, ...] = (180, 365, 730), params: Params = DEFAULT
) -> DataFrame:
    """Cohorts and users each horizon can be backtested on."""
    eligible = eligible_cohorts(cohort_starts(spells), horizons, params.label_cutoff)
    sizes = spells.groupBy("cohort_month").agg(F.count("*").alias("users"))
    total = spells.agg(F.count("*").alias("n")).scalar()
    return (
        eligible.join(sizes, "cohort_month")
        .groupBy("horizon")
        .agg(
            F.count("*").alias("n_cohorts"),
            F.min("cohort_month").alias("first_cohort"),
            F.max("cohort_month").alias("last_cohort"),
            F.sum("users").alias("users"),
        )
        .withColumn("share", ratio(F.col("users"), total))
    )


def spells_per_user(subjects: DataFrame) -> DataFrame:
    """Users by number of spells, and the mean number overall and among returners."""
    counts = subjects.groupBy("n_spells").agg(F.count("*").alias("users"))
    # One row per number of spells from here on.
    whole = Window.partitionBy(F.lit(0))
    users, total = F.col("users"), F.col("users") * F.col("n_spells")
    back = F.col("n_spells") > 1
    return counts.select(
        "n_spells", "users",
        ratio(users, F.sum("users").over(whole)).alias("share"),
        ratio(F.sum(total).over(whole), F.sum(users).over(whole)).alias("mean_spells"),
        ratio(
            F.sum(F.when(back, total)).over(whole), F.sum(F.when(back, users)).over(whole)
        ).alias("mean_spells_returners"),
    )
