import random
from datetime import date, timedelta

import pytest

from lapsewise.operators import audit
from tests.helpers import one, rows_of

RAW = (
    "msno string, payment_method_id int, payment_plan_days int, plan_list_price int, "
    "actual_amount_paid int, is_auto_renew int, transaction_date date, "
    "membership_expire_date date, is_cancel int"
)


def random_raw(seed, users=30):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        day = date(2015, 1, 1) + timedelta(days=rng.randint(0, 60))
        for _ in range(rng.randint(1, 12)):
            day += timedelta(days=rng.choice([0, 0, 10, 40, 90]))
            expiry = day + timedelta(days=rng.choice([-50, -10, 0, 7, 30]))
            row = (f"u{u}", 1, 30, 149, 149, 1, day, expiry, int(rng.random() < 0.3))
            rows += [row] * rng.choice([1, 1, 3])
    return rows


@pytest.fixture(scope="module")
def raw(spark):
    rows = random_raw(5)
    return rows, spark.createDataFrame(rows, RAW).persist()


def test_return_gaps_match_a_row_by_row_lag(raw):
    rows, df = raw
    expected = {}
    by_user = {}
    for r in sorted(rows, key=lambda r: (r[0], r[6], r[7])):
        previous = by_user.get(r[0])
        if previous is not None and (r[6] - previous).days > 30:
            key = (r[0], (r[6] - previous).days)
            expected[key] = expected.get(key, 0) + 1
        by_user[r[0]] = r[7]
    got = {}
    for r in audit.return_gaps(df).collect():
        got[r.msno, r.gap_days] = got.get((r.msno, r.gap_days), 0) + r.returns
    assert got == expected
    summary = one(audit.resubscribers(df))
    assert summary["n_return_events"] == sum(expected.values())
    events = sorted(g for (_, g), n in expected.items() for _ in range(n))
    half = len(events) // 2
    median = events[half] if len(events) % 2 else (events[half - 1] + events[half]) / 2
    assert summary["median_gap_days"] == median
    assert sum(r.n for r in audit.gap_histogram(df).collect()) == len(events)


def test_latest_row_per_user(raw):
    rows, df = raw
    expected = {}
    for r in sorted(rows, key=lambda r: (r[0], r[6], r[7], r[8])):
        expected[r[0]] = (r[7], bool(r[8]))
    got = {r.msno: (r.membership_expire_date, r.is_cancel) for r in audit.latest_transactions(df).collect()}
    assert got == expected


def test_censoring_states_at_the_last_day(spark):
    last = date(2015, 12, 31)
    ends = {"active": 1, "waiting": -29, "gone": -30}
    rows = [
        (name, 1, 30, 1, 1, 1, last if name == "active" else date(2015, 6, 1),
         last + timedelta(days=offset), 0)
        for name, offset in ends.items()
    ]
    got = one(audit.censoring_state(spark.createDataFrame(rows, RAW)))
    assert (got["n_active"], got["n_undetermined"], got["n_churned"]) == (1, 1, 1)
    assert got["max_date"] == last


def test_small_reports(raw):
    rows, df = raw
    assert one(audit.price_audit(df))["n_match"] == len(rows)
    assert sum(r.n_users for r in audit.transactions_per_user(df).collect()) == 30
    assert sum(r.n_users for r in audit.signup_cohorts(df).collect()) == 30
    months = audit.rows_by_month(df).collect()
    assert sum(r.n for r in months) == len(rows)
    assert one(audit.final_month_shares(df))["last_month"] == max(r.month for r in months)
    assert rows_of(audit.plan_grid(df), "n") == [(len(rows),)]
    assert audit.price_mismatch_sample(df).count() == 0
