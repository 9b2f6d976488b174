import random

import pytest

from lapsewise.config import DEFAULT
from lapsewise.operators import survival as km
from tests.helpers import one, rows_of

SUBJECT = "g string, entry_days int, tenure_days int, event boolean"
GOLDEN = [("a", 0, 5, True), ("a", 0, 10, False), ("a", 3, 8, True), ("a", 5, 12, True)]


@pytest.fixture(scope="module")
def curve(spark):
    return km.fit_curves(spark.createDataFrame(GOLDEN, SUBJECT), ["g"], min_events=1).persist()


def test_event_table_and_curve(curve):
    rows = curve.orderBy("t").collect()
    seen = [(r.t, r.entrance, r.removed, r.observed, r.at_risk, r.population) for r in rows]
    assert seen == [
        (0, 2, 0, 0, 2, 2), (3, 1, 0, 0, 3, 2), (5, 1, 1, 1, 4, 3),
        (8, 0, 1, 1, 3, 3), (10, 0, 1, 0, 2, 2), (12, 0, 1, 1, 1, 1),
    ]
    assert [r.survival for r in rows] == pytest.approx([1, 1, 2 / 3, 4 / 9, 4 / 9, 0])
    assert [r.variance for r in rows[:5]] == pytest.approx([0, 0, 1 / 6, 1 / 3, 1 / 3])
    assert rows[5].variance is None


def test_band(curve):
    rows = {r.t: r for r in curve.collect()}
    assert (rows[0].lower, rows[0].upper) == (1.0, 1.0)
    assert (rows[5].lower, rows[5].upper) == pytest.approx((0.054073, 0.945206), abs=1e-6)
    assert (rows[8].lower, rows[8].upper) == pytest.approx((0.037876, 0.818001), abs=1e-6)
    assert (rows[12].lower, rows[12].upper) == (None, None)


def test_reading_the_curve(curve):
    at = {r.horizon: r for r in km.survival_at(curve, ["g"], (4, 6, 7, 9, 100)).collect()}
    assert at[4].survival == 1.0
    assert at[7].survival == pytest.approx(2 / 3)
    assert at[9].survival == pytest.approx(4 / 9)
    assert at[100].survival == 0.0
    assert (at[6].at_risk, at[9].at_risk) == (4, 3)
    median = one(km.median_survival(curve, ["g"]))
    assert (median["median_days"], median["median_lower"], median["median_upper"]) == (8, 5, None)
    areas = {r.horizon: r.rmst for r in km.rmst(curve, ["g"], (10, 12, 20)).collect()}
    assert areas == pytest.approx({10: 7.888889, 12: 8.777778, 20: 8.777778}, abs=1e-6)


def test_a_curve_starting_late_is_one_before_its_first_day(spark):
    late = km.fit_curves(
        spark.createDataFrame([("a", 50, 60, True), ("a", 50, 70, True)], SUBJECT), ["g"], min_events=1
    )
    before = one(km.survival_at(late, ["g"], (30,)))
    assert (before["survival"], before["at_risk"]) == (1.0, 0)
    areas = {r.horizon: r.rmst for r in km.rmst(late, ["g"], (30, 65)).collect()}
    assert areas == pytest.approx({30: 30.0, 65: 60 + 0.5 * 5})


def test_thin_groups_have_no_curve_and_nothing_raises(spark):
    df = spark.createDataFrame(GOLDEN, SUBJECT)
    thin = km.fit_curves(df, ["g"])
    assert thin.count() == 0
    assert km.describe_curves(thin, ["g"]).count() == 0
    assert km.rmst(thin, ["g"], (365,)).count() == 0


def textbook(subjects):
    """Product-limit estimate by direct count of those at risk at each death."""
    first = min(e for e, _, _ in subjects)
    s, out = 1.0, {}
    for t in sorted({x for e, u, _ in subjects for x in (e, u)}):
        at_risk = sum((e < t or t == first) and u >= t for e, u, _ in subjects)
        deaths = sum(u == t and d for _, u, d in subjects)
        if deaths:
            s *= 1 - deaths / at_risk
        out[t] = s
    return out


def random_subjects(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        entry = rng.choice([0, 0, rng.randint(1, 60)])
        rows.append((entry, entry + rng.randint(1, 90), rng.random() < 0.6))
    return rows


def test_many_groups_in_one_pass_match_separate_textbook_fits(spark):
    groups = {f"g{i}": random_subjects(i) for i in range(3)}
    rows = [(g, *s) for g, subjects in groups.items() for s in subjects]
    fitted = km.fit_by(spark.createDataFrame(rows, SUBJECT), ["g"]).collect()
    got = {}
    for r in fitted:
        got.setdefault((r.grouping, r.level), {})[r.t] = r.survival
        assert 0 <= r.survival <= 1
        if r.lower is not None:
            assert r.lower <= r.survival + 1e-12 and r.survival <= r.upper + 1e-12
    assert set(got) == {("pooled", "all")} | {("g", g) for g in groups}
    for g, subjects in groups.items():
        assert got["g", g] == pytest.approx(textbook(subjects))
        s = [got["g", g][t] for t in sorted(got["g", g])]
        assert s == sorted(s, reverse=True)
    assert got["pooled", "all"] == pytest.approx(textbook([s for g in groups.values() for s in g]))


def test_crossings(spark):
    at = spark.createDataFrame(
        [("a", 30, 0.9), ("a", 60, 0.2), ("b", 30, 0.8), ("b", 60, 0.3), ("c", 30, 0.5), ("c", 60, 0.1)],
        "level string, horizon int, survival double",
    )
    crossed = km.crossing_check(km.crossing_differences(at, "level"))
    assert rows_of(crossed, "level_a", "level_b", "crossed") == [
        ("a", "b", True), ("a", "c", False), ("b", "c", False)
    ]


def _pair(spark, a, b):
    rows = [("01_<=7d", *s) for s in a] + [("02_8-31d", *s) for s in b]
    return spark.createDataFrame(rows, SUBJECT.replace("g ", "plan_type "))


@pytest.mark.parametrize(
    "a, b, verdict",
    [
        ([(0, 70, True)] * 150, [(0, 40, True)] * 75 + [(0, 400, True)] * 75, "product_effect"),
        ([(0, 50, True)] * 150, [(0, 400, True)] * 150, "no_crossing"),
        ([(0, 50, True)] * 150, [(0, 400, True)] * 20, "not_applicable"),
    ],
)
def test_incident_only_check(spark, a, b, verdict):
    got = one(km.incident_only_check(_pair(spark, a, b), "01_<=7d", "02_8-31d"))
    assert got["verdict"] == verdict
    assert got["full_subjects"] == len(a) + len(b)


def test_exclusion_bracket_needs_both_ends(spark):
    rows = [("main", "subject", 0, 400, True)] * 150 + [("excluded", "subject", 0, 40, True)] * 150
    schema = "population string, status string, entry_days int, tenure_days int, event boolean"
    df = spark.createDataFrame(rows, schema)
    bracket = {r.horizon: r for r in km.exclusion_bracket(km.exclusion_curves(df)).collect()}
    assert (bracket[90].upper, bracket[90].lower, bracket[90].width_pp) == pytest.approx((1, 0.5, 50))
    thin = km.exclusion_bracket(km.exclusion_curves(df.limit(20)))
    assert thin.count() == 0


def test_value_exclusion_keeps_subjects_without_a_value(spark):
    rows = [(7, 0, 400, True)] * 150 + [(3, 0, 40, True)] * 50 + [(None, 0, 400, True)] * 50
    df = spark.createDataFrame(rows, "registered_via int, entry_days int, tenure_days int, event boolean")
    got = {r.horizon: r for r in km.value_exclusion_sensitivity(df, "registered_via", 3).collect()}
    assert (got[90].s_all, got[90].s_without) == pytest.approx((0.8, 1.0))
    assert got[90].material and got[90].outside_band
    assert got[90].max_shift_pp == pytest.approx(20)


def test_truncation_profile(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 30), ("b", 0)], "plan_type string, entry_days int")
    assert rows_of(km.truncation_profile(df)) == [
        ("a", 3, 2 / 3, 10.0, 20.0, 1), ("b", 1, 0.0, 0.0, None, 1)
    ]


def test_defaults():
    assert DEFAULT.label_cutoff.isoformat() == "2017-01-29"
