from datetime import date, timedelta

import pytest

from lapsewise.config import DEFAULT
from lapsewise.operators import backtest as bt, survival
from tests.helpers import one, rows_of, spells

FIT = date(2016, 9, 30)


def test_spells_that_ended_before_the_fit_date_are_unchanged(spark):
    source = spells(spark, [{"msno": "ann"}, {"msno": "bo", "event": False}])
    assert rows_of(bt.censor_at(source, FIT), "msno", "event", "tenure_days") == [
        ("ann", True, 300), ("bo", False, 300)
    ]


def test_later_ends_become_censored_at_the_fit_date(spark):
    source = spells(spark, [{"end_date": date(2016, 10, 1), "tenure_days": 542}])
    got = one(bt.censor_at(source, FIT))
    assert (got["event"], got["tenure_days"]) == (False, 541)  # 8 April 2015 to the fit date
    assert one(source)["tenure_days"] == 542
    on_the_day = spells(spark, [{"end_date": FIT, "tenure_days": 541}])
    assert one(bt.censor_at(on_the_day, FIT))["event"]


def test_later_starts_and_clocks_are_dropped(spark):
    df = spells(
        spark,
        [
            {"msno": "kept", "spell_start_date": FIT},
            {"msno": "begun after", "spell_start_date": date(2016, 10, 1)},
            {"msno": "registered on the day", "registration_date": FIT},
            {"msno": "entered as it ended", "entry_days": 300},
        ],
    )
    assert rows_of(bt.censor_at(df, FIT), "msno") == [("kept",)]


PAIRS = "forecast_s double, realised_s double"


@pytest.mark.parametrize(
    "pairs, n, mae, bias",
    [
        ([(0.25, 0.25)], 1, 0.0, 0.0),
        ([(0.9, 0.65), (0.5, 0.35), (0.3, 0.1)], 3, 0.2, 0.2),
        ([(0.12, 0.42)], 1, 0.3, -0.3),
        ([(0.8, 0.4), (0.1, 0.5)], 2, 0.4, 0.0),
        ([(float("nan"), 0.2), (0.35, 0.2), (0.9, None), (None, 0.3)], 1, 0.15, 0.15),
        ([(None, 0.1), (0.1, float("nan"))], 0, None, None),
    ],
)
def test_error_metrics(spark, pairs, n, mae, bias):
    got = one(bt.error_metrics(spark.createDataFrame(pairs, PAIRS)))
    assert got["n"] == n
    assert got["mae"] == (mae if mae is None else pytest.approx(mae))
    assert got["bias"] == (bias if bias is None else pytest.approx(bias, abs=1e-12))


def starts(spark, **cohorts):
    return spark.createDataFrame(list(cohorts.items()), "cohort_month string, cohort_start date")


def test_eligibility_needs_the_whole_horizon_boundary_included(spark):
    df = starts(spark, whole=date(2016, 5, 4), lacking=date(2016, 5, 5), ancient=date(2012, 2, 29))
    got = bt.eligible_cohorts(df, (200, 90), date(2016, 11, 20))
    assert rows_of(got.filter("horizon = 200"), "cohort_month") == [("ancient",), ("whole",)]
    assert got.filter("horizon = 90").count() == 3


CELLS = "horizon int, truncated_share double, abs_error double"


@pytest.mark.parametrize(
    "cells, n, correlation, verdict",
    [
        ([(0.2, 0.11), (0.4, 0.12), (0.8, 0.14)], 3, 1.0, "error_grows_with_truncation"),
        ([(0.0, 0.4), (0.7, 0.05), (0.35, 0.225)], 3, -1.0, "error_falls_with_truncation"),
        ([(0.2, 0.1), (0.6, 0.1), (0.2, 0.3), (0.6, 0.3)], 4, 0.0, "no_relationship"),
        ([(0.15, 0.4)], 1, None, "too_few_cells"),
        ([(0.3, 0.2), (0.8, 0.2)], 2, None, "too_few_cells"),
        ([(0.7, None), (None, 0.1), (0.4, 0.3)], 1, None, "too_few_cells"),
    ],
)
def test_truncation_error(spark, cells, n, correlation, verdict):
    df = spark.createDataFrame([(365, *c) for c in cells], CELLS)
    got = one(bt.truncation_error(df))
    assert (got["n_cells"], got["verdict"]) == (n, verdict)
    assert got["correlation"] == (correlation if correlation is None else pytest.approx(correlation, abs=1e-12))


def cells(spark, shares, horizon=365):
    rows = [(horizon, f"c{i:02d}", "p", 1, s, 0.5, 0.4, 0.1, 0.1) for i, s in enumerate(shares)]
    return spark.createDataFrame(
        rows,
        "horizon int, cohort_month string, plan_type string, n int, truncated_share double, "
        "forecast_s double, realised_s double, error_s double, abs_error double",
    )


def test_quartiles_hold_every_cell_once(spark):
    got = bt.truncation_quartiles(cells(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]))
    rows = got.orderBy("bucket").collect()
    assert [r.n for r in rows] == [2, 2, 2, 2]
    assert rows[0].share_lo == 0.1 and rows[-1].share_hi == 0.8


def test_equal_quartile_edges_are_merged(spark):
    got = bt.truncation_quartiles(cells(spark, [0.0, 0.0, 0.0, 0.0, 1.0])).orderBy("bucket").collect()
    assert [(r.share_lo, r.share_hi, r.n) for r in got] == [(0.0, 1.0, 5)]
    assert bt.truncation_quartiles(cells(spark, [0.5, 0.5])).count() == 0
    assert bt.truncation_quartiles(cells(spark, [])).count() == 0


def test_worst_cells_break_ties_by_cohort(spark):
    got = bt.worst_cells(cells(spark, [0.1] * 7), 5)
    assert [r.cohort_month for r in got.orderBy("rank").collect()] == ["c00", "c01", "c02", "c03", "c04"]


def cohort(name, start, size, deaths, plan="03_32-120d"):
    """size subjects begun on one day, of which `deaths` end after 1 to 40 days."""
    rows = []
    for i in range(size):
        dies = i < deaths
        tenure = i % 40 + 1 if dies else (date(2017, 1, 20) - start).days
        rows.append({
            "msno": f"{name}-{i}", "cohort_month": f"{start:%Y-%m}", "plan_type": plan,
            "registration_date": start, "spell_start_date": start,
            "end_date": start + timedelta(days=tenure), "tenure_days": tenure, "event": dies,
        })
    return rows


EARLY = cohort("spring", date(2015, 3, 2), 400, 300)
LATER = cohort("summer", date(2015, 7, 6), 250, 125)
YOUNG = cohort("young", date(2016, 12, 5), 30, 20)


def test_cells_compare_the_stratum_forecast_with_the_cell(spark):
    got = {r.cohort_month: r for r in bt.backtest_cells(
        spells(spark, EARLY + LATER + YOUNG), (365,), DEFAULT).collect()}
    assert sorted(got) == ["2015-03", "2015-07"]  # the young cohort has not been followed
    assert got["2015-03"].n == 400 and got["2015-03"].truncated_share == 0.0
    assert got["2015-03"].realised_s == pytest.approx(0.25)
    assert got["2015-07"].realised_s == pytest.approx(0.5)
    # One forecast for the stratum: 425 deaths of 650, and those the young one adds.
    assert got["2015-03"].forecast_s == got["2015-07"].forecast_s
    assert 0.3 < got["2015-03"].forecast_s < 0.37
    overall = one(bt.backtest_overall(bt.backtest_cells(spells(spark, EARLY + LATER), (365,), DEFAULT)))
    assert (overall["n"], overall["verdict"]) == (2, "pessimistic")


def test_a_forecast_out_of_sample_is_the_fit_without_the_cohort(spark):
    """Taken out of the event table or out of the subjects: the same curve."""
    everyone = EARLY + LATER + YOUNG
    got = {r.cohort_month: r for r in bt.cells_out_of_sample(
        spells(spark, everyone), (365, 180), DEFAULT).filter("horizon = 365").collect()}
    for month, others in (("2015-03", LATER + YOUNG), ("2015-07", EARLY + YOUNG)):
        known = bt.censor_at(spells(spark, others), DEFAULT.fit_window_end)
        curves = survival.fit_curves(known, ["plan_type"], DEFAULT)
        refit = one(survival.score_curves(curves, ["plan_type"], (365,)))
        assert got[month].forecast_s == pytest.approx(refit["survival"], abs=1e-12)
        assert got[month].forecast_rmst == pytest.approx(refit["rmst"], abs=1e-9)
    # A stratum of one cohort has nobody left to learn from.
    alone = bt.cells_out_of_sample(spells(spark, EARLY), (365,), DEFAULT)
    assert alone.count() == 0


def test_cell_events_are_one_scan_and_equal_both_views(spark):
    table = spells(spark, EARLY + YOUNG + [{"msno": "x", "entry_days": 30}])
    events = bt.cell_events(table)
    for view, rows in ((bt.FULL, table), (bt.KNOWN, bt.censor_at(table, DEFAULT.fit_window_end))):
        want = survival.event_days(rows, bt.CELL)
        mine = events.filter(events["view"] == view).select(*want.columns)
        assert rows_of(mine) == rows_of(want)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
