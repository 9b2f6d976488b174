"""Raw files to backtested lifetime value: every stage reads the last one's tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.config import DEFAULT, Params
from lapsewise.operators import backtest, checks, ingest, ltv, spells, survival
from lapsewise.operators.checks import Check, run_checks
from lapsewise.plans.marts import Marts, build_marts
from lapsewise.schema import STAGED_MEMBERS, STAGED_TRANSACTIONS, TRANSACTION_COLUMNS
from lapsewise.session import Scratch
from lapsewise.sources import Published
from lapsewise.sources.figures import record_figures, table_state
from lapsewise.sources.published import Draft
from lapsewise.sources.raw import SOURCE

STAGED, MARTS = "raw->staged", "staged->marts"


@dataclass
class Run:
    """Folder of one pipeline's published tables, and seconds per stage of this run.

    Every stage publishes its tables together, after its checks. log entries carry
    run_id: a run repeated under its id replaces its entries.
    """

    spark: SparkSession
    folder: str
    params: Params = DEFAULT
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    seconds: dict[str, float] = field(default_factory=dict)

    @cached_property
    def published(self) -> Published:
        return Published(self.spark, self.folder)

    def draft(self) -> Draft:
        return self.published.draft()

    def table(self, name: str) -> DataFrame:
        return self.published.table(name)

    @property
    def log_path(self) -> str:
        return f"{self.folder}/validation_log"

    def check(self, step: str, checks: list[Check]) -> None:
        stage = MARTS if step == "marts" else STAGED
        run_checks(stage, checks, self.log_path, f"{self.run_id}-{step}")

    def timed(self, stage: str, work):
        began = time.perf_counter()
        result = work()
        self.seconds[stage] = round(time.perf_counter() - began, 3)
        return result


def _one_row(spark: SparkSession, figures: dict[str, int]) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in figures.items()])


def stage(run: Run, raw_transactions: DataFrame, raw_members: DataFrame) -> None:
    """Land the typed rows once, check them, then publish staged and quarantine.

    The raw files are parsed a single time, and nothing is published unless the landed
    table and the tables made from it pass. Counts are read back from the written
    tables: counting in the writing job would take its rows out of generated code.
    """
    spark, params = run.spark, run.params
    reason = F.col("quarantine_reason")
    scratch = Scratch(spark)
    landed = scratch.write(
        ingest.tag_quarantine(ingest.transform_transactions(raw_transactions, params)), "landed"
    )
    figures = landed.agg(
        F.count("*").alias("raw_rows"),
        *checks.date_figures(params, reason.isNull()),
    ).first().asDict()
    raw_rows = figures.pop("raw_rows")
    dates = checks.date_verdict(_one_row(spark, figures))
    run.check("landing", [Check("date_sanity", dates)])

    clean = landed.filter(reason.isNull()).select(*TRANSACTION_COLUMNS)
    tables = {
        "transactions": lambda: ingest.deduplicate(clean),
        "transactions_quarantine": lambda: landed.filter(reason.isNotNull()),
        "members": lambda: ingest.stage_members(raw_members),
    }
    if SOURCE in landed.columns:
        tables["source_counts"] = lambda: ingest.source_counts(landed)
    draft = run.draft()
    draft.write_together(tables)
    scratch.drop(landed)

    staged, members = draft.table("transactions"), draft.table("members")
    staged_rows = staged.count()
    counts = _one_row(
        spark,
        {
            "raw_rows": raw_rows,
            "staged_rows": staged_rows,
            "quarantined": draft.table("transactions_quarantine").count(),
            "duplicates": figures["rows_checked"] - staged_rows,
        },
    )
    member_counts = _one_row(
        spark, {"raw_rows": raw_members.count(), "staged_rows": members.count()}
    )
    drops = ["quarantined", "duplicates"]
    found = [
        Check(
            "row_count_reconciliation",
            checks.row_count_reconciliation(counts, "raw_rows", "staged_rows", drops),
        ),
        Check(
            "row_count_reconciliation_members",
            checks.row_count_reconciliation(member_counts, "raw_rows", "staged_rows", []),
        ),
        Check("unique_members", checks.unique_key(members, ["msno"])),
        Check("schema_transactions", checks.schema_conformance(staged, STAGED_TRANSACTIONS)),
        Check("schema_members", checks.schema_conformance(members, STAGED_MEMBERS)),
        Check("price_reconciliation", checks.price_reconciliation(staged, params), checks.WARN),
    ]
    if SOURCE in landed.columns:
        sources = draft.table("source_counts").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_rows", "staged_rows", *drops)]
        )
        found.append(
            Check(
                "row_count_reconciliation_sources",
                checks.row_count_reconciliation(sources, "raw_rows", "staged_rows", drops),
            )
        )
    run.check("staging", found)
    draft.commit()


def marts(run: Run) -> Marts:
    """Segment, label, check and publish the marts."""
    staged, members = run.table("transactions"), run.table("members")
    draft = run.draft()
    built = build_marts(staged, members, run.params, draft.write)
    counts = spells.spell_counts(built.subjects)
    run.check(
        "marts",
        [
            Check("censoring_rate", checks.censoring_rate(built.spells, run.params)),
            Check("unique_subjects", checks.unique_key(built.subjects, ["msno"])),
            Check(
                "row_count_reconciliation_marts",
                checks.reconcile_marts(built.users, members, counts),
            ),
        ],
    )
    draft.write_together({name: lambda n=name: getattr(built, n) for name in Marts.TABLES})
    draft.commit()
    return built


def fit_survival(run: Run, built: Marts) -> None:
    """Pooled, stratum and cohort curves in one job; then everything read from them,
    beside the comparisons that need fits of their own."""
    params, keys = run.params, ["grouping", "level"]
    draft = run.draft()
    draft.write_together(
        {
            "curves": lambda: survival.fit_by(built.spells, ["plan_type", "cohort_month"], params),
            "truncation_profile": lambda: survival.truncation_profile(built.spells),
            "incident_check": lambda: survival.incident_only_check(
                built.spells, "01_<=7d", "02_8-31d", params
            ),
            "exclusion_bracket": lambda: survival.exclusion_bracket(
                survival.exclusion_curves(built.subjects, params), params
            ),
            "channel_sensitivity": lambda: survival.value_exclusion_sensitivity(
                built.spells, "registered_via", params.sensitivity_channel, params
            ),
        }
    )
    curves = draft.table("curves")

    def crossings() -> DataFrame:
        by_plan = curves.filter(F.col("grouping") == "plan_type")
        at = survival.survival_at(by_plan, ["level"], params.km_horizons)
        return survival.crossing_check(survival.crossing_differences(at, "level"))

    draft.write_together(
        {
            "curve_summary": lambda: survival.describe_curves(curves, keys, params),
            "crossings": crossings,
        }
    )
    draft.commit()


def lifetime_value(run: Run, built: Marts) -> None:
    draft = run.draft()
    report = draft.write("ltv", ltv.ltv_report(built.subjects, built.reactivation, run.params))
    draft.write("clock_sensitivity", ltv.clock_sensitivity(report))
    draft.commit()


def run_backtest(run: Run, built: Marts) -> None:
    params = run.params
    draft = run.draft()
    cells = draft.write(
        "backtest_cells", backtest.backtest_cells(built.spells, params.backtest_horizons, params)
    )
    draft.write_together(
        {
            "backtest_overall": lambda: backtest.backtest_overall(cells),
            "backtest_by_stratum": lambda: backtest.backtest_by_stratum(cells),
            "truncation_error": lambda: backtest.truncation_error(cells, params, ["horizon"]),
            "truncation_quartiles": lambda: backtest.truncation_quartiles(cells),
            "worst_cells": lambda: backtest.worst_cells(cells),
            "backtest_out_of_sample": lambda: backtest.backtest_overall(
                backtest.cells_out_of_sample(built.spells, params.backtest_horizons, params)
            ),
        }
    )
    draft.commit()


def headline(run: Run, built: Marts, state: str) -> None:
    """This run's headline figures beside those of the run before it."""
    curves = run.table("curves").filter(F.col("grouping") == survival.POOLED)
    observed = checks.headline_figures(
        built.spells,
        survival.median_survival(curves, ["grouping", "level"]),
        run.table("backtest_overall"),
        run.params.min_followup_days,
    )
    draft = run.draft()
    draft.write("headline", record_figures(observed, f"{run.folder}/headline_figures", state))
    draft.commit()


def run_pipeline(
    spark: SparkSession,
    raw_transactions: DataFrame,
    raw_members: DataFrame,
    folder: str,
    params: Params = DEFAULT,
    run_id: str | None = None,
) -> Run:
    """All stages in order. A failing stage raises, and no later one runs."""
    run = Run(spark, folder.rstrip("/"), params, run_id or uuid.uuid4().hex)
    run.timed("ingest", lambda: stage(run, raw_transactions, raw_members))
    built = run.timed("marts", lambda: marts(run))
    run.timed("survival", lambda: fit_survival(run, built))
    run.timed("ltv", lambda: lifetime_value(run, built))
    run.timed("backtest", lambda: run_backtest(run, built))
    read = sorted({*raw_transactions.inputFiles(), *raw_members.inputFiles()})
    run.timed("headline", lambda: headline(run, built, table_state(spark, *read)))
    return run
