import random
from datetime import date, timedelta

import pytest

from lapsewise.config import DEFAULT
from lapsewise.operators import checks, revenue, spells as sp
from tests.helpers import members, one, rows_of, staged

D = date


def tx(user, day, expiry, cancel=False, plan=30, **more):
    return {
        "msno": user, "transaction_date": day, "membership_expire_date": expiry,
        "is_cancel": cancel, "plan_days": plan, **more,
    }


GOLDEN = [
    tx("u01", D(2015, 6, 1), D(2015, 7, 1)), tx("u01", D(2015, 7, 1), D(2015, 7, 31)),
    tx("u02", D(2015, 6, 1), D(2015, 7, 1)), tx("u02", D(2015, 7, 31), D(2015, 8, 30)),
    tx("u02", D(2015, 9, 30), D(2015, 10, 30)),
    tx("u03", D(2015, 6, 1), D(2015, 7, 1)), tx("u03", D(2015, 6, 15), D(2015, 5, 1), True),
    tx("u04", D(2015, 6, 1), D(2015, 7, 1)), tx("u04", D(2015, 6, 1), D(2015, 6, 1), True),
    tx("u05", D(2015, 6, 1), D(2015, 6, 1), True), tx("u05", D(2015, 6, 10), D(2015, 7, 10)),
    tx("u06", D(2017, 2, 5), D(2017, 3, 7)),
    tx("u07", D(2017, 1, 10), D(2017, 2, 9)),
    tx("u08", D(2016, 11, 30), D(2016, 12, 30)),
    tx("u09", D(2015, 6, 1), D(2015, 7, 1), plan=7),
    tx("u10", D(2015, 6, 1), D(2015, 6, 1), plan=None), tx("u10", D(2015, 6, 5), D(2015, 7, 5)),
    tx("u11", D(2015, 6, 1), None), tx("u11", D(2015, 6, 20), D(2015, 7, 20)),
    tx("u12", D(2015, 6, 1), D(2015, 7, 1)),
    tx("u13", D(2015, 1, 1), D(2015, 1, 1)),
]
REGISTERED = {
    "u01": D(2015, 6, 1), "u02": D(2014, 6, 1), "u03": D(2015, 6, 1), "u04": D(2015, 6, 1),
    "u05": D(2015, 6, 1), "u06": D(2017, 2, 1), "u07": D(2017, 1, 10), "u08": D(2016, 11, 30),
    "u10": D(2015, 6, 1), "u11": D(2015, 6, 1), "u12": D(2016, 1, 1), "u13": D(2014, 1, 1),
}


@pytest.fixture(scope="module")
def golden(spark):
    table = staged(spark, GOLDEN)
    subjects = sp.build_subjects(table, members(spark, REGISTERED), DEFAULT).persist()
    yield table, subjects
    subjects.unpersist()


def test_spell_numbers(golden):
    table, _ = golden
    numbers = {}
    for r in sp.number_spells(table, DEFAULT).orderBy("spell_no", "transaction_date").collect():
        numbers.setdefault(r.msno, []).append(r.spell_no)
    assert numbers == {
        "u01": [1, 1], "u02": [1, 1, 2], "u03": [1, 1], "u04": [1, 2], "u05": [1, 2],
        "u06": [1], "u07": [1], "u08": [1], "u09": [1], "u10": [1, 1], "u11": [1, 2],
        "u12": [1], "u13": [1],
    }


def test_subjects(golden):
    got = rows_of(
        sp.spells(golden[1]), "msno", "end_date", "event", "entry_days", "tenure_days",
        "n_transactions", "ended_by_cancel", "plan_type",
    )
    assert got == [
        ("u01", D(2015, 7, 31), True, 0, 60, 2, False, "02_8-31d"),
        ("u02", D(2015, 8, 30), True, 214, 455, 2, False, "02_8-31d"),
        ("u03", D(2015, 6, 15), True, 0, 14, 2, True, "02_8-31d"),
        ("u07", D(2017, 1, 29), False, 0, 19, 1, False, "02_8-31d"),
        ("u08", D(2016, 12, 30), True, 0, 30, 1, False, "02_8-31d"),
        ("u10", D(2015, 7, 5), True, 0, 34, 2, False, "02_8-31d"),
    ]


def test_guards_and_exclusions(golden):
    _, subjects = golden
    assert rows_of(sp.spells_quarantine(subjects), "msno", "quarantine_reason", "tenure_days") == [
        ("u06", "starts_after_label_cutoff", -3),
        ("u12", "negative_tenure", -184),
        ("u13", "entry_after_exit", 365),
    ]
    assert rows_of(
        sp.spells_excluded(subjects), "msno", "entry_days", "tenure_days", "event", "plan_type"
    ) == [("u09", 0, 30, True, "01_<=7d")]
    assert rows_of(subjects.filter("status = 'null_spell_end'"), "msno") == [
        ("u04",), ("u05",), ("u11",)
    ]


def test_every_user_is_accounted_for(spark, golden):
    table, subjects = golden
    counts = sp.spell_counts(subjects)
    assert one(counts) == {
        "users": 13, "no_member_row": 1, "candidates": 9, "subjects": 6, "null_spell_end": 3,
        "starts_after_label_cutoff": 1, "negative_tenure": 1, "entry_after_exit": 1,
    }
    assert one(checks.reconcile_marts(sp.user_rows(table), members(spark, REGISTERED), counts))["passed"]


def test_reactivation_and_revenue(golden):
    _, subjects = golden
    back = rows_of(
        revenue.reactivation(subjects).filter("reactivated"),
        "msno", "days_to_return", "later_spell_rev", "n_later_spells",
    )
    assert back == [("u02", 31, 77, 1)]
    # The cancel row of u03 is left out of its revenue.
    assert rows_of(
        revenue.spell_revenue(subjects).filter("msno in ('u02', 'u03')"),
        "msno", "first_spell_rev", "observed_days",
    ) == [("u02", 154, 90), ("u03", 77, 14)]


def random_history(seed, users=25):
    """Histories with many same-day rows, unknown expiries and backdated cancels."""
    rng = random.Random(seed)
    rows = set()
    for u in range(users):
        day = D(2015, 1, 1) + timedelta(days=rng.randint(0, 40))
        for _ in range(rng.randint(1, 30)):
            day += timedelta(days=rng.choice([0, 0, 0, 1, 5, 29, 31, 45]))
            cancel = rng.random() < 0.3
            gap = rng.choice([-60, -31, -30, 0, 1, 7, 30]) if cancel else rng.choice([0, 1, 7, 30])
            expiry = None if rng.random() < 0.15 else day + timedelta(days=gap)
            rows.add(
                (
                    f"u{u}", rng.randint(1, 2), rng.choice([None, 7, 30]), rng.choice([0, 149]),
                    rng.choice([0, 99, 149]), rng.random() < 0.5, day, expiry, cancel,
                    rng.random() < 0.2,
                )
            )
    return sorted(rows, key=repr)


def reference_numbering(rows):
    """Row by row in the total order, as defined."""
    last = lambda v: (v is None, v or 0)
    far = D.max
    order = lambda r: (
        r[0], r[6], (r[7] is None, r[7] or far), r[8], r[1], last(r[2]), r[3], r[4], r[5], r[9]
    )
    out, user, coverage, number = [], None, None, 0
    for r in sorted(rows, key=order):
        if r[0] != user:
            user, coverage, number = r[0], None, 0
        opens = coverage is None or (r[6] - coverage).days > 30
        number += opens
        out.append((*r, coverage, int(opens), number))
        if not r[8] and r[7] is not None:
            coverage = r[7] if coverage is None else max(coverage, r[7])
    return sorted(out, key=repr)


def summaries(numbered):
    """What user_summary must say, from rows numbered one by one."""
    out = {}
    for user in {r[0] for r in numbered}:
        mine = [r for r in numbered if r[0] == user]
        first = [r for r in mine if r[12] == 1]
        later = [r for r in mine if r[12] > 1]
        paid = lambda rows: [r for r in rows if not r[8]]
        out[user] = (
            min(r[6] for r in first), len(first), sum(r[4] for r in paid(first)),
            sum(r[4] for r in paid(first) if r[9]), min((r[6] for r in later), default=None),
            sum(r[4] for r in paid(later)), max(r[12] for r in mine), len(mine), len(paid(mine)),
        )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numbers_and_summaries_match_a_row_by_row_scan(spark, seed):
    from lapsewise.schema import STAGED_TRANSACTIONS

    rows = random_history(seed)
    table = spark.createDataFrame(rows, STAGED_TRANSACTIONS)
    expected = reference_numbering(rows)
    assert rows_of(sp.number_spells(table)) == expected
    got = {r[0]: tuple(r[1:]) for r in sp.user_summary(table).select(
        "msno", "spell_start_date", "n_transactions", "first_spell_rev", "imputed_rev",
        "first_return_date", "later_spell_rev", "n_spells", "n_rows", "n_paid_rows").collect()}
    assert got == summaries(expected)


def test_no_task_sorts_the_rows_of_a_user(spark):
    """Rows are combined by part before they are dealt out by user, so the window over a
    user with very many rows sees as many parts as there are days and prices."""
    days = 20
    table = staged(spark, [{"msno": "hot"}]).drop("transaction_date", "actual_amount_paid").crossJoin(
        spark.range(20_000).selectExpr(
            f"date_add(DATE'2016-01-01', CAST(id % {days} AS INT)) AS transaction_date",
            "CAST(id AS INT) AS actual_amount_paid",
        )
    )
    parts = sp.parts_of(table)
    assert parts.count() == days
    assert one(sp.user_summary(table))["n_rows"] == 20_000
    assert sp.number_spells(table).select("spell_no").distinct().count() == 1
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "SortAggregate" not in plan


def test_the_first_plan_follows_the_order_of_rows(spark):
    """A missing expiry sorts after the farthest date, whatever the payment method."""
    far = D(9999, 12, 31)
    table = staged(spark, [
        tx("a", D(2015, 6, 1), far, plan=30, payment_method_id=41),
        tx("a", D(2015, 6, 1), None, plan=7, payment_method_id=41),
        tx("a", D(2015, 6, 1), None, plan=7, payment_method_id=40),
    ])
    got = one(sp.user_summary(table))
    assert (got["first_plan_days"], got["first_method"]) == (30, 41)


def test_the_result_does_not_depend_on_the_partitioning(spark):
    table = staged(spark, GOLDEN)
    known = members(spark, REGISTERED)
    first = sp.build_subjects(table.repartition(1), known)
    second = sp.build_subjects(table.repartition(7, "transaction_date"), known.repartition(3))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def test_reports(golden):
    _, subjects = golden
    report = one(sp.spell_report(sp.spells(subjects)))
    assert (report["subjects"], report["events"], report["censored"]) == (6, 5, 1)
    assert (report["ended_by_cancel"], report["left_truncated"]) == (1, 1)
    assert report["median_tenure_days"] == 32.0
    by_plan = rows_of(sp.spell_report_by(sp.spells(subjects), "plan_type"), "plan_type", "subjects")
    assert by_plan == [("02_8-31d", 6)]
    assert one(sp.excluded_report(sp.spells_excluded(subjects)))["negative_tenure"] == 0
