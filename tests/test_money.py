"""Revenue, reactivation and lifetime value against direct arithmetic."""

from datetime import date

import pytest

from lapsewise.config import DEFAULT
from lapsewise.operators import ltv, revenue as rev
from tests.helpers import one, rows_of

REACT = (
    "plan_type string, first_end_date date, reactivated boolean, days_to_return int, "
    "later_spell_rev bigint"
)
EARLY, LATE = date(2015, 6, 1), date(2017, 1, 1)


@pytest.fixture(scope="module")
def react(spark):
    rows = [
        ("p", EARLY, True, 40, 100), ("p", EARLY, True, 200, 300), ("p", EARLY, False, None, 0),
        ("p", EARLY, False, None, 0), ("p", LATE, False, None, 0), ("q", LATE, False, None, 0),
    ]
    return spark.createDataFrame(rows, REACT)


def test_uncorrected_rates(react):
    got = {r.window_days: r for r in rev.reactivation_rates(react).collect()}
    assert got[90].reactivation_rate == pytest.approx(1 / 6)
    assert got[365].reactivation_rate == pytest.approx(2 / 6)
    assert got[365].mean_later_revenue == 200


def test_the_term_counts_only_users_followed_for_the_whole_window(react):
    got = {(r.plan_type, r.window_days): r for r in rev.reactivation_term(react, (90, 365)).collect()}
    assert set(got) == {("p", 90), ("p", 365)}
    assert got["p", 365].churned_subjects == 4
    assert got["p", 365].value == pytest.approx(0.5 * 200)
    assert got["p", 90].value == pytest.approx(0.25 * 100)
    full = rev.reactivation_term(react, (365,), full_followup=False)
    assert rows_of(full, "plan_type", "churned_subjects", "value") == [("p", 5, 0.4 * 200), ("q", 1, 0.0)]


def test_detail_and_windows(spark, react):
    named = react.replace({"p": "02_8-31d", "q": "01_<=7d"}, subset="plan_type")
    got = {r.plan_type: r for r in rev.reactivation_detail(named).collect()}
    assert (got["02_8-31d"].reactivation_rate, got["02_8-31d"].uncorrected_rate) == pytest.approx((0.5, 0.4))
    assert (got["01_<=7d"].churned_subjects, got["01_<=7d"].value) == (0, 0.0)
    medians = {r.window_days: r.median_days_to_return for r in rev.reactivation_windows(react).collect()}
    assert medians == {90: 40.0, 180: 40.0, 365: 120.0}


def test_revenue_report_has_no_rate_without_days(spark):
    df = spark.createDataFrame(
        [("a", "p", 100, 10, 20, True), ("b", "p", 50, 20, 0, True), ("c", "q", 5, 0, 0, True)],
        "msno string, plan_type string, first_spell_rev bigint, observed_days int, "
        "imputed_rev bigint, event boolean",
    )
    got = rows_of(rev.revenue_report(df), "plan_type", "revenue_per_day", "imputed_share")
    assert got == [("p", 5.0, pytest.approx(20 / 150)), ("q", None, 0.0)]


SUBJECTS = (
    "msno string, population string, status string, plan_type string, registered_via int, "
    "entry_days int, tenure_days int, event boolean, spell_start_date date, end_date date, "
    "first_spell_rev bigint, imputed_rev bigint"
)


def subject(i, population="main", via=7, entry=0, tenure=100, plan="02_8-31d"):
    return (
        f"{population}{via}{entry}{tenure}{i}", population, "subject", plan, via, entry, tenure,
        True, date(2015, 1, 1), date(2015, 1, 11), 50, 10,
    )


def test_lifetime_value_range(spark, react):
    rows = (
        [subject(i) for i in range(150)]
        + [subject(i, via=3, tenure=300) for i in range(150)]
        + [subject(i, "excluded", via=None, tenure=20) for i in range(150)]
        + [subject(i, plan="unknown") for i in range(150)]
        + [subject(i, plan="04_121d+") for i in range(20)]
    )
    named = react.replace({"p": "02_8-31d"}, subset="plan_type")
    got = one(ltv.ltv_table(spark.createDataFrame(rows, SUBJECTS), named, (365,)))
    main, with_excluded, without = 200.0, (100 + 300 + 20) / 3, 100.0
    assert (got["plan_type"], got["subjects"]) == ("02_8-31d", 300)
    assert (got["rmst_lo"], got["rmst_hi"]) == pytest.approx((min(with_excluded, without), main))
    assert got["rev_per_day"] == pytest.approx(5.0)
    assert got["ltv_hi"] == pytest.approx(5 * 200 + 100)
    assert got["ltv_mid"] == pytest.approx(5 * 150 + 100)
    assert got["ltv_mid_ex_imputed"] == pytest.approx(4 * 150 + 100)
    assert got["reactivation_share"] == pytest.approx(100 / 850)
    assert got["reliable"] is False


def test_views_and_clock_sensitivity(spark, react):
    rows = [subject(i) for i in range(150)] + [subject(i, entry=50, tenure=300) for i in range(150)]
    report = ltv.ltv_table(
        spark.createDataFrame(rows, SUBJECTS), react, (365,), DEFAULT, ltv.VIEWS
    ).persist()
    sizes = rows_of(report, "view", "subjects", "reactivation_value")
    assert sizes == [("full", 300, 0.0), ("incident", 150, 0.0)]
    got = one(ltv.clock_sensitivity(report))
    assert got["ltv_mid_incident"] == pytest.approx(500.0)
    assert got["relative"] == pytest.approx(500 / got["ltv_mid_full"] - 1)
