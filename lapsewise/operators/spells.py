"""Transactions to subscription spells, and one labelled row per user.

Each user's rows are put in a total order and cut wherever a row lands more than
the grace period after the coverage paid for so far. Everything downstream (the
subject table, the excluded population, revenue, reactivation) is a projection of
one aggregate over that numbering.

Rows are combined into parts before the shuffle by user: a part holds the rows of a
user that share the leading sort columns, with their number and sums. Rows of a part
follow each other in the order, and only the first of them can see less coverage than
the rest, so two flags and a count say where each of its rows opens a spell. The windows
run over parts, whose number per user follows the calendar and the price list and not
the data: no task sorts all rows of a user, however many one has. Rows get their number
back from their part. Input that lies by user already is combined where it lies, without
any further shuffle.
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
    plan_type,
    unpack_second_day,
)
from lapsewise.schema import EXCLUDED_COLUMNS, SPELL_COLUMNS, SPELL_QUARANTINE_COLUMNS

# A total order up to exact copies, which ingestion removes.
SPELL_ORDER = [
    "transaction_date", "membership_expire_date", "is_cancel", "payment_method_id",
    "plan_days", "list_price", "actual_amount_paid", "is_auto_renew", "plan_days_imputed",
]
NUMBERING = ["coverage_so_far", "opens_spell", "spell_no"]
FAR_FUTURE = date(9999, 12, 31)


def _opens(coverage: Column, grace: int) -> Column:
    late = days_between(coverage, "transaction_date") > grace
    return F.when(coverage.isNull() | late, 1).otherwise(0)


# --- numbering ---------------------------------------------------------------


PART = ["msno", "transaction_date", "no_expiry", "expiry_key", "is_cancel",
        "payment_method_id", "no_plan", "plan_key", "list_price"]


def user_rows(staged: DataFrame) -> DataFrame:
    """Rows per user. Only the user column is read, and counts are combined before
    the shuffle."""
    return staged.groupBy("msno").agg(F.count("*").alias("rows"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the columns of PART, in which no key is NULL."""
    return rows.withColumns(
        {
            "no_expiry": F.col("membership_expire_date").isNull(),
            "expiry_key": F.coalesce("membership_expire_date", F.lit(FAR_FUTURE)),
            "no_plan": F.col("plan_days").isNull(),
            "plan_key": F.coalesce("plan_days", F.lit(0)),
        }
    )


def _first_row() -> Column:
    """Amount, auto-renewal and imputation in one number that sorts like the three."""
    return (
        F.col("actual_amount_paid").cast("long") * 4
        + F.col("is_auto_renew").cast("int") * 2
        + F.col("plan_days_imputed").cast("int")
    )


def parts_of(staged: DataFrame) -> DataFrame:
    """Rows combined by the leading sort columns: a hash aggregate that combines before
    the shuffle."""
    amount = F.col("actual_amount_paid")
    return _keyed(staged).groupBy(*PART).agg(
        F.count("*").alias("rows"),
        F.sum(amount).alias("amount"),
        F.coalesce(F.sum(F.when(F.col("plan_days_imputed"), amount)), F.lit(0)).alias("imputed"),
        F.min(_first_row()).alias("first_row"),
    )


def number_parts(parts: DataFrame, grace: int) -> DataFrame:
    """coverage_first and coverage_rest before the first and the other rows of a part,
    whether these open spells, and the number of spells opened before it."""
    order = Window.partitionBy("msno").orderBy(*PART[1:])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    paid_until = F.when(~F.col("is_cancel") & ~F.col("no_expiry"), F.col("expiry_key"))
    covered = parts.withColumn("coverage_first", F.max(paid_until).over(before)).withColumn(
        "coverage_rest", F.greatest("coverage_first", paid_until)
    )
    flagged = covered.withColumns(
        {
            "first_opens": _opens(F.col("coverage_first"), grace),
            "rest_opens": _opens(F.col("coverage_rest"), grace),
        }
    ).withColumn("opened", F.col("first_opens") + F.col("rest_opens") * (F.col("rows") - 1))
    return flagged.withColumn(
        "spells_before", F.coalesce(F.sum("opened").over(before), F.lit(0))
    )


def number_spells(staged: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every row with the coverage before it, whether it opens a spell, and its number."""
    parts = number_parts(parts_of(staged), params.grace_days).select(
        *PART, "coverage_first", "coverage_rest", "first_opens", "rest_opens", "spells_before"
    )
    within = Window.partitionBy(*PART).orderBy(_first_row())
    first = F.col("position") == 1
    return (
        _keyed(staged).join(parts, PART)
        .withColumn("position", F.row_number().over(within))
        .select(
            *staged.columns,
            F.when(first, F.col("coverage_first")).otherwise(F.col("coverage_rest"))
            .alias("coverage_so_far"),
            F.when(first, F.col("first_opens")).otherwise(F.col("rest_opens")).alias("opens_spell"),
            (
                F.col("spells_before") + F.col("first_opens")
                + F.col("rest_opens") * (F.col("position") - 1)
            ).alias("spell_no"),
        )
    )


# --- one row per user ---------------------------------------------------------


def user_summary(staged: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """First-spell facts, revenue and later spells of every user in one aggregate over
    numbered parts, which keeps their window's partitioning."""
    numbered = number_parts(parts_of(staged), params.grace_days)
    # The first known plan length so far, from the window already sorted.
    through = Window.partitionBy("msno").orderBy(*PART[1:]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    known_plan = F.when(~F.col("no_plan"), F.col("plan_key"))
    numbered = numbered.withColumn("plan_so_far", F.first(known_plan, ignorenulls=True).over(through))

    # A part lies in one spell, or each of its rows begins one.
    first = F.col("spells_before") + F.col("first_opens") == 1
    whole = F.col("rest_opens") == 0
    beyond = ~first | (~whole & (F.col("rows") > 1))
    paid = ~F.col("is_cancel")
    day = F.col("transaction_date")
    expiry = F.when(~F.col("no_expiry"), F.col("expiry_key"))
    opening = F.shiftright("first_row", 2)  # amount of the part's first row
    amount = F.when(first, F.when(whole, F.col("amount")).otherwise(opening)).otherwise(0)
    opening_imputed = F.col("first_row").bitwiseAND(F.lit(1)) == 1
    imputed = F.when(
        first,
        F.when(whole, F.col("imputed")).when(opening_imputed, opening).otherwise(0),
    ).otherwise(0)
    # Every part after the earliest follows a row that opened a spell.
    earliest = F.col("spells_before") == 0
    renews = F.col("first_row").bitwiseAND(F.lit(2)) == 2

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(paid, value)), F.lit(0)).cast("long")

    return numbered.groupBy("msno").agg(
        F.min(F.when(first, day)).alias("spell_start_date"),
        F.sum(F.when(first, F.when(whole, F.col("rows")).otherwise(1)).otherwise(0))
        .cast("int").alias("n_transactions"),
        unpack_second_day(
            F.max(F.when(first & paid & expiry.isNotNull(), pack_day_pair(day, expiry)))
        ).alias("last_noncancel_expiry"),
        F.max(F.when(first & paid, day)).alias("last_noncancel_date"),
        F.max(F.when(first & ~paid, day)).alias("last_cancel_date"),
        F.max(F.when(first, F.col("plan_so_far"))).alias("first_plan_days"),
        total(amount).alias("first_spell_rev"),
        total(imputed).alias("imputed_rev"),
        F.min(F.when(beyond, day)).alias("first_return_date"),
        total(F.col("amount") - amount).alias("later_spell_rev"),
        # Spell numbers are consecutive, so their maximum is their count.
        F.max(F.col("spells_before") + F.col("opened")).alias("n_spells"),
        F.sum("rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(paid, F.col("rows"))), F.lit(0)).alias("n_paid_rows"),
        F.max(F.when(earliest, opening)).alias("first_amount"),
        F.max(F.when(earliest, renews)).alias("first_auto_renew"),
        F.max(F.when(earliest, F.col("payment_method_id"))).alias("first_method"),
    )


def resolve_end(summary: DataFrame) -> DataFrame:
    """A spell ends by cancellation only if the cancel day is after every paid row;
    otherwise at the last paid expiry. A cancel row's own expiry is never read."""
    cancelled = F.coalesce(F.col("last_cancel_date") > F.col("last_noncancel_date"), F.lit(False))
    return summary.withColumns(
        {
            "ended_by_cancel": cancelled,
            "raw_end_date": F.when(cancelled, F.col("last_cancel_date")).otherwise(
                F.col("last_noncancel_expiry")
            ),
        }
    )


def churn_observed(cutoff: date, params: Params) -> Column:
    """A cancellation is its own evidence; an expiry needs the whole grace period."""
    return F.when(
        F.col("ended_by_cancel"), F.col("raw_end_date") <= F.lit(cutoff)
    ).otherwise(F.date_add("raw_end_date", params.grace_days) <= F.lit(cutoff))


def label_churn(resolved: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """event, and end_date cut at the label cutoff for the censored."""
    cutoff = F.lit(params.label_cutoff)
    labelled = resolved.withColumn("event", churn_observed(params.label_cutoff, params))
    end = F.when(F.col("event"), F.col("raw_end_date")).when(
        F.col("raw_end_date").isNotNull(), F.least("raw_end_date", cutoff)
    )
    return labelled.withColumn("end_date", end)


def subject_table(
    summary: DataFrame, members: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """Every user once, with population, clock, label and status.

    population  main (has a member row, clock starts at registration, enters the
                risk set when the window opened) or excluded (no member row, clock
                starts at the first transaction).
    status      subject, null_spell_end, or the first guard the row trips.
    """
    attributes = members.select(
        "msno",
        F.col("registration_init_time").alias("registration_date"),
        "registered_via", "city", "bd", "gender",
        F.lit(True).alias("has_member"),
    )
    joined = label_churn(resolve_end(summary), params).join(attributes, "msno", "left")
    main = F.coalesce("has_member", F.lit(False))
    timed = joined.withColumns(
        {
            "population": F.when(main, "main").otherwise("excluded"),
            "cohort_month": cohort_month("spell_start_date"),
            "plan_type": plan_type("first_plan_days"),
            "entry_days": F.when(
                main,
                F.greatest(
                    days_between("registration_date", F.lit(params.window_open)), F.lit(0)
                ),
            ).otherwise(0),
            "tenure_days": days_between(
                F.when(main, F.col("registration_date")).otherwise(F.col("spell_start_date")),
                "end_date",
            ),
        }
    )
    status = (
        F.when(F.col("raw_end_date").isNull(), "null_spell_end")
        .when(F.col("spell_start_date") > F.lit(params.label_cutoff), "starts_after_label_cutoff")
        .when(main & (F.col("tenure_days") < 0), "negative_tenure")
        .when(main & (F.col("entry_days") >= F.col("tenure_days")), "entry_after_exit")
        .otherwise("subject")
    )
    return timed.withColumn("status", status).drop("has_member")


def build_subjects(
    staged: DataFrame, members: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    return subject_table(user_summary(staged, params), members, params)


# --- marts: projections of the subject table -----------------------------------


def _population(subjects: DataFrame, name: str) -> DataFrame:
    return subjects.filter(F.col("population") == name)


def spells(subjects: DataFrame) -> DataFrame:
    return _population(subjects, "main").filter(F.col("status") == "subject").select(
        *SPELL_COLUMNS
    )


def spells_quarantine(subjects: DataFrame) -> DataFrame:
    caught = ~F.col("status").isin("subject", "null_spell_end")
    return (
        _population(subjects, "main")
        .filter(caught)
        .withColumnRenamed("status", "quarantine_reason")
        .select(*SPELL_QUARANTINE_COLUMNS)
    )


def spells_excluded(subjects: DataFrame) -> DataFrame:
    """Users without a member row, kept to bound the survival curve from below."""
    return _population(subjects, "excluded").filter(F.col("status") == "subject").select(
        *EXCLUDED_COLUMNS
    )


def spell_counts(subjects: DataFrame) -> DataFrame:
    """One row: every user falls into exactly one of the counted outcomes."""
    main = F.col("population") == "main"

    def outcome(status: str) -> Column:
        return F.count_if(main & (F.col("status") == status)).alias(status)

    return subjects.agg(
        F.count("*").alias("users"),
        F.count_if(~main).alias("no_member_row"),
        F.count_if(main & (F.col("status") != "null_spell_end")).alias("candidates"),
        F.count_if(main & (F.col("status") == "subject")).alias("subjects"),
        outcome("null_spell_end"),
        outcome("starts_after_label_cutoff"),
        outcome("negative_tenure"),
        outcome("entry_after_exit"),
    )


# --- reports ---------------------------------------------------------------------


def _censoring() -> list[Column]:
    event = F.col("event").cast("int")
    return [
        F.count("*").alias("subjects"),
        F.sum(event).alias("events"),
        (1 - F.avg(event)).alias("censoring_rate"),
    ]


def spell_report(spells: DataFrame) -> DataFrame:
    truncated = F.col("entry_days") > 0
    return spells.agg(
        *_censoring(),
        F.count_if(~F.col("event")).alias("censored"),
        F.count_if(F.col("ended_by_cancel")).alias("ended_by_cancel"),
        F.count_if(truncated).alias("left_truncated"),
        F.avg(truncated.cast("int")).alias("left_truncated_share"),
        F.median("tenure_days").alias("median_tenure_days"),
        F.median("entry_days").alias("median_entry_days"),
    )


def spell_report_by(spells: DataFrame, column: str) -> DataFrame:
    return spells.groupBy(column).agg(*_censoring()).orderBy(column)


def excluded_report(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("plan_type").agg(
        *_censoring(), F.count_if(F.col("tenure_days") < 0).alias("negative_tenure")
    ).orderBy("plan_type")
