"""Every registered query, by name. Each runs over the whole tables of a folder.

Ingestion and audit queries start at the raw tables. The others start at the staged or
the subject table, which the first of them to read it writes (plans/marts.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import WAREHOUSE as P
from lapsewise.operators import (
    audit,
    backtest,
    checks,
    ingest,
    ltv,
    profile,
    revenue,
    spells,
    survival,
)
from lapsewise.plans.marts import Marts, warehouse_marts, warehouse_state
from lapsewise.schema import STAGED_TRANSACTIONS, TRANSACTION_COLUMNS
from lapsewise.session import materialise, scratch_path
from lapsewise.sources import (
    pick_source,
    read_raw_members,
    read_raw_transactions,
    stream_raw_transactions,
    warehouse,
    with_source,
)
from lapsewise.sources.export import (
    write_deliveries,
    write_raw_members,
    write_raw_transactions,
)
from lapsewise.sources.figures import record_figures
from lapsewise.streaming import ingest_stream, staged_from_stream

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}

PROFILE_METHOD = 1
FAR_FUTURE = P.observation_cutoff.replace(year=2002, month=6, day=30)


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: integers as BIGINT, doubles rounded, no negative zero."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            r = F.round(c.cast("double"), 6)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _on_raw(name: str):
    """Register a query over the raw transactions (and members) of a folder."""

    def register(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(
                build(
                    warehouse.raw_transactions(spark, sf_dir, P),
                    warehouse.raw_members(spark, sf_dir, P),
                )
            )

        REGISTRY[name] = query
        return build

    return register


def _on_marts(name: str):
    """Register a query over the staged and subject tables of a folder."""

    def register(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(warehouse_marts(spark, sf_dir, P)))

        REGISTRY[name] = query
        return build

    return register


# --- ingestion and checks -------------------------------------------------------

_on_raw("staged_transactions")(lambda tx, mem: ingest.stage_transactions(tx, P)[0])
_on_raw("quarantined_transactions")(lambda tx, mem: ingest.stage_transactions(tx, P)[1])
_on_raw("staged_members")(lambda tx, mem: ingest.stage_members(mem))
_on_raw("ingest_counts")(lambda tx, mem: ingest.ingest_counts(tx, P))
_on_raw("reconciliation_raw_staged")(
    lambda tx, mem: checks.row_count_reconciliation(
        ingest.ingest_counts(tx, P), "raw_rows", "staged_rows", ["quarantined", "duplicates"]
    )
)
_on_raw("check_date_sanity_raw")(
    lambda tx, mem: checks.date_sanity(ingest.date_transactions(tx), P)
)
_on_raw("check_duplicates_raw")(
    lambda tx, mem: checks.duplicate_rows(ingest.date_transactions(tx))
)
_on_raw("check_unique_members")(
    lambda tx, mem: checks.unique_key(ingest.stage_members(mem), ["msno"])
)
_on_marts("check_date_sanity")(lambda m: checks.date_sanity(m.staged, P))
_on_marts("check_duplicates")(lambda m: checks.duplicate_rows(m.staged))
_on_marts("check_censoring")(lambda m: checks.censoring_rate(m.spells, P))
_on_marts("check_price")(lambda m: checks.price_reconciliation(m.staged, P))


@_on_marts("check_schema")
def _check_schema(m: Marts) -> DataFrame:
    # The warehouse keys users by BIGINT and widens the payment method.
    wider = {"msno": T.LongType(), "payment_method_id": T.IntegerType()}
    expected = T.StructType(
        [
            T.StructField(f.name, wider.get(f.name, f.dataType), f.nullable)
            for f in STAGED_TRANSACTIONS
        ]
    )
    return checks.schema_columns(m.staged, expected)


# --- spells ------------------------------------------------------------------------

_on_marts("numbered_transactions")(lambda m: m.numbered)


# Kept under both names: there is one route for all users.
_on_marts("numbered_transactions_split")(lambda m: m.numbered)
FIRST_ROW = ("first_amount", "first_auto_renew", "first_method")
_on_marts("user_summary")(lambda m: spells.user_summary(m.by_user, P).drop(*FIRST_ROW))
_on_marts("user_first_rows")(
    lambda m: spells.user_summary(m.by_user, P).select("msno", *FIRST_ROW)
)


_on_marts("user_summary_split")(lambda m: spells.user_summary(m.by_user, P).drop(*FIRST_ROW))
_on_marts("spells")(lambda m: m.spells)
_on_marts("spells_quarantine")(lambda m: m.quarantine)
_on_marts("spells_excluded")(lambda m: m.excluded)
_on_marts("spell_counts")(lambda m: spells.spell_counts(m.subjects))
_on_marts("reconciliation_marts")(
    lambda m: checks.reconcile_marts(m.users, m.members, spells.spell_counts(m.subjects))
)
_on_marts("spell_report")(lambda m: spells.spell_report(m.spells))
_on_marts("spells_by_plan")(lambda m: spells.spell_report_by(m.spells, "plan_type"))
_on_marts("spells_by_cohort")(lambda m: spells.spell_report_by(m.spells, "cohort_month"))
_on_marts("excluded_by_plan")(lambda m: spells.excluded_report(m.excluded))

# --- revenue and reactivation --------------------------------------------------------

_on_marts("spell_revenue")(lambda m: m.revenue)
_on_marts("spell_revenue_entry")(lambda m: revenue.revenue_with_entry(m.subjects))
_on_marts("revenue_by_plan")(lambda m: revenue.revenue_report(m.revenue))
_on_marts("reactivation")(lambda m: m.reactivation)
_on_marts("reactivation_rates")(lambda m: revenue.reactivation_rates(m.reactivation, P))
_on_marts("reactivation_term")(
    lambda m: revenue.reactivation_term(m.reactivation, P.reactivation_windows, P)
)
_on_marts("reactivation_term_uncorrected")(
    lambda m: revenue.reactivation_term(
        m.reactivation, P.reactivation_windows, P, full_followup=False
    )
)
_on_marts("reactivation_detail")(lambda m: revenue.reactivation_detail(m.reactivation, 365, P))
_on_marts("reactivation_windows")(lambda m: revenue.reactivation_windows(m.reactivation, P))

# --- survival ---------------------------------------------------------------------------

PLAN = ["plan_type"]


def _plan_curves(m: Marts) -> DataFrame:
    return survival.fit_curves(m.spells, PLAN, P)


def _summary(m: Marts, columns: list[str], grouping: str) -> DataFrame:
    curves = survival.fit_by(m.spells, columns, P).filter(F.col("grouping") == grouping)
    return survival.describe_curves(curves, ["grouping", "level"], P)


_on_marts("km_event_table")(lambda m: survival.event_table(m.spells, PLAN))
_on_marts("km_curve_by_plan")(
    lambda m: survival.km_curve(survival.event_table(m.spells, PLAN), PLAN, P.min_events)
)
_on_marts("km_curve_pooled")(
    lambda m: survival.km_curve(survival.event_table(m.spells, []), [], P.min_events)
)
_on_marts("km_confidence")(
    lambda m: _plan_curves(m).select("plan_type", "t", "survival", "variance", "lower", "upper")
)
_on_marts("km_summary_pooled")(lambda m: _summary(m, [], survival.POOLED))
_on_marts("km_summary_by_plan")(lambda m: _summary(m, PLAN, "plan_type"))
_on_marts("km_summary_by_cohort")(lambda m: _summary(m, ["cohort_month"], "cohort_month"))
_on_marts("survival_at_horizons")(
    lambda m: survival.survival_at(_plan_curves(m), PLAN, P.km_horizons)
)
_on_marts("rmst_by_plan")(lambda m: survival.rmst(_plan_curves(m), PLAN, P.ltv_horizons))
_on_marts("truncation_profile")(lambda m: survival.truncation_profile(m.spells))


def _plan_differences(m: Marts) -> DataFrame:
    return survival.crossing_differences(
        survival.survival_at(_plan_curves(m), PLAN, P.km_horizons), "plan_type"
    )


_on_marts("crossing_differences")(_plan_differences)
_on_marts("crossing_check")(lambda m: survival.crossing_check(_plan_differences(m)))
_on_marts("incident_crossing")(
    lambda m: survival.incident_only_check(m.spells, "01_<=7d", "02_8-31d", P)
)
_on_marts("exclusion_bracket")(
    lambda m: survival.exclusion_bracket(survival.exclusion_curves(m.subjects, P), P)
)
_on_marts("exclusion_summary")(
    lambda m: survival.describe_curves(
        survival.exclusion_curves(m.subjects, P), ["scenario"], P
    )
)
_on_marts("channel_sensitivity")(
    lambda m: survival.value_exclusion_sensitivity(
        m.spells, "registered_via", P.sensitivity_channel, P
    )
)

_on_marts("channel_summary")(
    lambda m: survival.describe_curves(
        survival.value_exclusion_curves(
            m.spells, "registered_via", P.sensitivity_channel, P
        ), ["scenario"], P,
    )
)
_on_marts("channel_counts")(
    lambda m: survival.value_exclusion_counts(m.spells, "registered_via", P.sensitivity_channel)
)
_on_marts("incident_summary")(
    lambda m: survival.describe_curves(
        survival.subset_curves(m.spells, PLAN, P), ["subset", *PLAN], P
    )
)


@_on_marts("incident_differences")
def _incident_differences(m: Marts) -> DataFrame:
    """Differences of every two strata at each horizon, in both subsets."""
    at = survival.survival_at(
        survival.subset_curves(m.spells, PLAN, P), ["subset", *PLAN], P.km_horizons
    )
    one = at.select("subset", "horizon", F.col("plan_type").alias("level_a"),
                    F.col("survival").alias("s_a"))
    two = at.select("subset", "horizon", F.col("plan_type").alias("level_b"),
                    F.col("survival").alias("s_b"))
    # Strata x horizons rows on either side.
    return one.join(two, ["subset", "horizon"]).filter("level_a < level_b").select(
        "subset", "level_a", "level_b", "horizon", (F.col("s_a") - F.col("s_b")).alias("difference")
    )


# --- lifetime value ------------------------------------------------------------------------


def _ltv(m: Marts, horizon: int, view: str) -> DataFrame:
    return ltv.ltv_table(m.subjects, m.reactivation, (horizon,), P, (view,))


_on_marts("revenue_per_day")(
    lambda m: ltv.revenue_per_day(revenue.revenue_with_entry(m.subjects), ltv.VIEWS)
)
_on_marts("rmst_range")(lambda m: ltv.rmst_range(m.subjects, P.ltv_horizons, P, ltv.VIEWS))
_on_marts("ltv_365_incident")(lambda m: _ltv(m, 365, "incident"))
_on_marts("ltv_365_full")(lambda m: _ltv(m, 365, "full"))
_on_marts("ltv_730_incident")(lambda m: _ltv(m, 730, "incident"))
_on_marts("ltv_730_full")(lambda m: _ltv(m, 730, "full"))
_on_marts("ltv_report")(lambda m: ltv.ltv_report(m.subjects, m.reactivation, P))
_on_marts("clock_sensitivity")(
    lambda m: ltv.clock_sensitivity(ltv.ltv_report(m.subjects, m.reactivation, P))
)

# --- backtest -----------------------------------------------------------------------------


def _cells(m: Marts, *horizons: int) -> DataFrame:
    return backtest.backtest_cells(m.spells, horizons or P.backtest_horizons, P)


_on_marts("censored_fit_view")(lambda m: backtest.censor_at(m.spells, P.fit_window_end))
_on_marts("cohort_starts")(lambda m: backtest.cohort_starts(m.spells))
_on_marts("eligible_cohorts")(
    lambda m: backtest.eligible_cohorts(
        backtest.cohort_starts(m.spells), P.backtest_horizons, P.label_cutoff
    )
)
_on_marts("backtest_cells_365")(lambda m: _cells(m, 365))
_on_marts("backtest_cells_180")(lambda m: _cells(m, 180))
_on_marts("backtest_cells_out_of_sample")(
    lambda m: backtest.cells_out_of_sample(m.spells, P.backtest_horizons, P)
)
_on_marts("backtest_metrics")(lambda m: backtest.backtest_overall(_cells(m)))
_on_marts("backtest_by_stratum")(lambda m: backtest.backtest_by_stratum(_cells(m)))
_on_marts("truncation_error")(lambda m: backtest.truncation_error(_cells(m), P, ["horizon"]))
_on_marts("truncation_quartiles")(lambda m: backtest.truncation_quartiles(_cells(m)))
_on_marts("worst_cells")(lambda m: backtest.worst_cells(_cells(m)))

# --- audits of the raw tables ------------------------------------------------------------------


def _audit(name: str):
    def register(build):
        _on_raw(name)(
            lambda tx, mem: build(ingest.date_transactions(tx), ingest.stage_members(mem))
        )
        return build

    return register


_audit("audit_window")(lambda tx, mem: audit.observation_window(tx, mem))
_audit("audit_cohorts")(lambda tx, mem: audit.signup_cohorts(tx))
_audit("audit_registration")(lambda tx, mem: audit.registration_check(tx, mem))
_audit("audit_censoring")(lambda tx, mem: audit.censoring_state(tx, P))
_audit("audit_price")(lambda tx, mem: audit.price_audit(tx))
_audit("audit_plan_grid")(lambda tx, mem: audit.plan_grid(tx))
_audit("audit_price_sample")(lambda tx, mem: audit.price_mismatch_sample(tx))
_audit("audit_resubscribers")(lambda tx, mem: audit.resubscribers(tx, P))
_audit("audit_gap_histogram")(lambda tx, mem: audit.gap_histogram(tx, P))
_audit("audit_months")(lambda tx, mem: audit.rows_by_month(tx))
_audit("audit_final_months")(lambda tx, mem: audit.final_month_shares(tx))
_audit("audit_tx_per_user")(lambda tx, mem: audit.transactions_per_user(tx))
_audit("audit_span")(lambda tx, mem: audit.observed_span(tx))
_audit("audit_date_anomalies")(lambda tx, mem: audit.date_anomalies(tx, FAR_FUTURE))

# --- analyses behind the decisions -----------------------------------------------------------------

_on_marts("censoring_walk")(lambda m: profile.censoring_walk(m.staged, m.subjects, P))
_on_marts("exclusion_reasons")(lambda m: profile.exclusion_reasons(m.subjects))
_on_marts("excluded_profile")(
    lambda m: profile.excluded_profile(m.subjects, PROFILE_METHOD, P)
)
_on_marts("excluded_cohorts")(lambda m: profile.excluded_cohorts(m.subjects))
_on_marts("lag_by_channel")(lambda m: profile.lag_by_channel(m.subjects, P))
_on_marts("lag_reweighted")(lambda m: profile.lag_reweighted(m.subjects, P))
_on_marts("zero_day_profile")(lambda m: profile.zero_day_profile(m.staged))
_on_marts("truncation_by_cohort")(lambda m: profile.truncation_by_cohort(m.spells))
_on_marts("eligible_by_horizon")(lambda m: profile.eligible_by_horizon(m.spells, params=P))
_on_marts("spells_per_user")(lambda m: profile.spells_per_user(m.subjects))


def headline_figures(m: Marts) -> DataFrame:
    pooled = survival.fit_by(m.spells, [], P)
    return checks.headline_figures(
        m.spells,
        survival.median_survival(pooled, ["grouping", "level"]),
        backtest.backtest_overall(_cells(m)),
        P.min_followup_days,
    )


def headline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of two runs, each computed from the tables and compared with the run
    recorded before it: the first finds none, the second must find its own again."""
    folder = scratch_path(spark, "headline")
    runs = None
    for run in (1, 2):
        state = warehouse_state(spark, sf_dir)
        found = record_figures(headline_figures(warehouse_marts(spark, sf_dir, P)), folder, state)
        found = found.withColumn("run", F.lit(run))
        runs = found if runs is None else runs.unionByName(found)
    return tidy(runs)


REGISTRY["headline_check"] = headline_check


# --- raw files ----------------------------------------------------------------------------

RAW_FILES = 12
TRANSACTIONS, MEMBERS, DELIVERED = "transactions", "members", "deliveries"
_raw_folders: dict[tuple[str, str, str, str], str] = {}


def _raw_folder(spark: SparkSession, sf_dir: str, part: str) -> str:
    """A folder with the derived raw rows as strict CSV: the transactions, the members or
    the deliveries of transactions. Each is written once in a session, when a query first
    needs it, unless a file of the tables changes."""
    key = (spark.sparkContext.applicationId, sf_dir, warehouse_state(spark, sf_dir), part)
    if key not in _raw_folders:
        folder = scratch_path(spark, "raw")
        if part == TRANSACTIONS:
            write_raw_transactions(spark, sf_dir, f"{folder}/{part}", RAW_FILES)
        elif part == MEMBERS:
            write_raw_members(spark, sf_dir, f"{folder}/{part}", RAW_FILES)
        else:
            write_deliveries(spark, sf_dir, folder, DELIVERIES, RAW_FILES)
        _raw_folders[key] = folder
    return _raw_folders[key]


def _raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _raw_folder(spark, sf_dir, TRANSACTIONS)
    return read_raw_transactions(spark, f"{folder}/{TRANSACTIONS}")


def _raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw_members(spark, f"{_raw_folder(spark, sf_dir, MEMBERS)}/{MEMBERS}")


def _on_files(name: str, *sources: Query):
    """Register a query over the raw CSV files it names."""

    def register(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = build(*[read(spark, sf_dir) for read in sources])
            if "msno" in found.columns:  # text in raw files
                found = found.withColumn("msno", F.col("msno").cast("long"))
            return tidy(found)

        REGISTRY[name] = query
        return build

    return register


_on_files("staged_from_csv", _raw_transactions)(lambda tx: ingest.stage_transactions(tx, P)[0])
_on_files("quarantined_from_csv", _raw_transactions)(lambda tx: ingest.stage_transactions(tx, P)[1])
_on_files("members_from_csv", _raw_members)(lambda mem: ingest.stage_members(mem))


@_on_files("check_log", _raw_transactions, _raw_members)
def _check_log(tx: DataFrame, mem: DataFrame) -> DataFrame:
    """The log that the checks of staging leave behind."""
    log = scratch_path(tx.sparkSession, "check-log")
    staged = materialise(ingest.stage_transactions(tx, P)[0], "staged")
    counts = ingest.ingest_counts(tx, P)
    checks.run_checks(
        "raw->staged",
        [
            checks.Check("date_sanity", checks.date_sanity(staged, P)),
            checks.Check(
                "row_count_reconciliation",
                checks.row_count_reconciliation(
                    counts, "raw_rows", "staged_rows", ["quarantined", "duplicates"]
                ),
            ),
            checks.Check("unique_members", checks.unique_key(ingest.stage_members(mem), ["msno"])),
            checks.Check(
                "price_reconciliation", checks.price_reconciliation(staged, P), checks.WARN
            ),
        ],
        log,
    )
    return tx.sparkSession.read.json(log).select("name", "stage", "severity", "passed")


# Two deliveries of the transactions that overlap in time: name, first and last day.
DELIVERIES = {
    "delivery_1": (P.window_open, P.window_open.replace(year=1998, month=6)),
    "delivery_2": (P.window_open.replace(year=1998, month=3), P.observation_cutoff),
}


def _delivery() -> Column:
    return F.element_at(F.split("source_file", "/"), -2).alias("source_file")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read, refused, staged and dropped as a copy of each delivery."""
    folder = _raw_folder(spark, sf_dir, DELIVERED)
    raw = with_source(read_raw_transactions(spark, [f"{folder}/{name}" for name in DELIVERIES]))
    tagged = ingest.tag_quarantine(ingest.transform_transactions(raw, P))
    named = tagged.select(*TRANSACTION_COLUMNS, "quarantine_reason", _delivery())
    return tidy(ingest.source_counts(named))


def source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first source that is there, by the delivery they name as theirs."""
    folder = _raw_folder(spark, sf_dir, DELIVERED)
    picked = pick_source(spark, [f"{folder}/{name}" for name in ("full", *DELIVERIES)])
    return tidy(picked.select(_delivery()).groupBy("source_file").agg(F.count("*").alias("raw_rows")))


REGISTRY["source_counts"] = source_counts
REGISTRY["source_preference"] = source_preference

# --- incremental ingestion ------------------------------------------------------------------------------


FILES_PER_BATCH = 4  # of RAW_FILES


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The raw files as a stream under the header contract, drained in several batches,
    whose number does not grow with that of the files."""
    path = f"{_raw_folder(spark, sf_dir, TRANSACTIONS)}/{TRANSACTIONS}"
    files = len(read_raw_transactions(spark, path).inputFiles())
    batch = max(FILES_PER_BATCH, -(-files * FILES_PER_BATCH // RAW_FILES))
    folder = scratch_path(spark, "stream")
    ingest_stream(stream_raw_transactions(spark, path, batch), folder, P)
    return staged_from_stream(spark, folder)


def _on_stream(name: str, part: int) -> None:
    REGISTRY[name] = lambda spark, sf_dir: tidy(
        _streamed(spark, sf_dir)[part].withColumn("msno", F.col("msno").cast("long"))
    )


_on_stream("ingest_stream", 0)
_on_stream("ingest_stream_quarantine", 1)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables to spells by plan type, without the marts shared by the queries."""
    staged, _ = ingest.stage_transactions(warehouse.raw_transactions(spark, sf_dir, P), P)
    members = ingest.stage_members(warehouse.raw_members(spark, sf_dir, P))
    subjects = spells.build_subjects(staged, members, P)
    return tidy(spells.spell_report_by(spells.spells(subjects), "plan_type"))
