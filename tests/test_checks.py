from datetime import date

import pytest
from pyspark.sql import functions as F

from lapsewise.config import DEFAULT
from lapsewise.operators import checks
from lapsewise.operators.checks import FAIL, WARN, Check, ValidationError, run_checks
from lapsewise.schema import STAGED_TRANSACTIONS
from tests.helpers import frame, one, rows_of, staged


def reconcile(spark, raw, stage, *drops):
    names = [f"d{i}" for i in range(len(drops))]
    counts = spark.range(1).select(
        F.lit(raw).alias("raw"), F.lit(stage).alias("stage"),
        *[F.lit(d).alias(n) for n, d in zip(names, drops)],
    )
    return one(checks.row_count_reconciliation(counts, "raw", "stage", names))


@pytest.mark.parametrize(
    "raw, stage, drops, passed, unexplained",
    [
        (37, 37, (), True, 0),
        (64, 41, (11, 9, 3), True, 0),
        (64, 41, (11, 9), False, 3),
        (8, 13, (), False, -5),
        (52, 50, (6,), False, -4),
    ],
)
def test_reconciliation(spark, raw, stage, drops, passed, unexplained):
    got = reconcile(spark, raw, stage, *drops)
    assert (got["passed"], got["unexplained"]) == (passed, unexplained)
    assert got["logged_drops_total"] == sum(drops)


def test_reconciliation_rejects_negative_counts(spark):
    with pytest.raises(Exception, match="negative"):
        reconcile(spark, -1, 0)


DATES = "msno string, transaction_date date, membership_expire_date date, is_cancel int"


def dated(spark, *rows):
    default = {
        "msno": "kim", "transaction_date": date(2016, 3, 9),
        "membership_expire_date": date(2016, 4, 6), "is_cancel": 0,
    }
    return frame(spark, DATES, default, list(rows))


BEFORE = {"membership_expire_date": date(2016, 3, 8)}


def sanity(spark, *rows):
    return one(checks.date_sanity(dated(spark, *rows)))


def test_clean_dates_pass(spark):
    assert sanity(spark, {})["passed"]


def test_a_cancellation_may_backdate_and_is_counted(spark):
    got = sanity(spark, {**BEFORE, "is_cancel": 1})
    assert got["passed"] and got["expiry_before_transaction_cancelled"] == 1


def test_an_uncancelled_backwards_row_fails(spark):
    got = sanity(spark, BEFORE)
    assert not got["passed"] and got["expiry_before_transaction_not_cancelled"] == 1


def test_a_boolean_flag_works_too(spark):
    df = dated(spark, {**BEFORE, "is_cancel": 1}).withColumn("is_cancel", F.col("is_cancel") == 1)
    assert one(checks.date_sanity(df))["passed"]


def test_a_surviving_sentinel_fails_once(spark):
    got = sanity(spark, {"membership_expire_date": date(1970, 1, 1)})
    assert not got["passed"]
    assert got["epoch_sentinel_expiry"] == 1
    assert got["expiry_before_transaction_not_cancelled"] == 0


@pytest.mark.parametrize("day", [date(2014, 12, 31), date(2017, 3, 1)])
def test_dates_outside_the_window_fail(spark, day):
    got = sanity(spark, {"transaction_date": day, "membership_expire_date": date(2019, 8, 8)})
    assert not got["passed"] and got["transaction_date_out_of_window"] == 1


def test_a_null_expiry_is_counted_not_failed(spark):
    got = sanity(spark, {"membership_expire_date": None}, {})
    assert got["passed"] and got["null_expiry"] == 1


def test_every_violation_is_counted(spark):
    sentinel = {"membership_expire_date": date(1970, 1, 1)}
    got = sanity(spark, BEFORE, {}, sentinel, BEFORE, sentinel, BEFORE, {"membership_expire_date": None})
    assert got["rows_checked"] == 7
    assert got["expiry_before_transaction_not_cancelled"] == 3
    assert (got["epoch_sentinel_expiry"], got["null_expiry"]) == (2, 1)


def test_a_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="is_cancel"):
        checks.date_sanity(dated(spark, {}).drop("is_cancel"))


def verdict(spark, passed, severity=FAIL, name="x"):
    return Check(name, spark.range(1).select(F.lit(passed).alias("passed"), F.lit(3).alias("n")), severity)


def test_the_runner_logs_everything_before_it_raises(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(ValidationError, match="first"):
        run_checks(
            "s", [verdict(spark, False, name="first"), lambda: verdict(spark, True, name="second")], log
        )
    logged = spark.read.json(log)
    assert rows_of(logged, "name", "passed") == [("first", False), ("second", True)]
    assert set(logged.columns) == {
        "name", "stage", "passed", "severity", "observed", "checked_at", "entry"
    }


def test_results_logged_again_under_one_name_replace_the_former(spark, tmp_path):
    log = str(tmp_path / "log")
    for passed in (False, True):
        run_checks("s", [verdict(spark, passed, WARN), verdict(spark, True, name="y")], log, "run 1/a")
    run_checks("s", [verdict(spark, True)], log)  # without a name every call is an entry
    run_checks("s", [verdict(spark, True)], log)
    logged = spark.read.json(log)
    assert rows_of(logged.filter("entry = 'run-1-a'"), "name", "passed") == [("x", True), ("y", True)]
    assert logged.count() == 4


def test_a_warning_does_not_raise_and_results_come_back(spark):
    rows = run_checks("s", [verdict(spark, False, WARN), verdict(spark, True)])
    assert [r.passed for r in rows] == [False, True]
    assert rows[0].observed == {"n": 3.0}


def events(spark, churned, n, kind="int"):
    return spark.range(n).select((F.col("id") < churned).cast(kind).alias("event"))


@pytest.mark.parametrize(
    "churned, n, passed", [(3, 8, True), (7, 7, False), (2, 600, False), (0, 25, False)]
)
def test_censoring_rate_bounds(spark, churned, n, passed):
    got = one(checks.censoring_rate(events(spark, churned, n)))
    assert got["passed"] is passed
    assert got["censoring_rate"] == pytest.approx(1 - churned / n)


def test_censoring_accepts_booleans_and_other_bounds(spark):
    from dataclasses import replace

    df = events(spark, 2, 700, "boolean")
    assert one(checks.censoring_rate(df, replace(DEFAULT, max_censoring=0.9999)))["passed"]


def test_censoring_errors(spark):
    with pytest.raises(Exception, match="empty"):
        checks.censoring_rate(events(spark, 0, 0)).collect()
    with pytest.raises(ValueError):
        checks.censoring_rate(spark.range(1))


@pytest.mark.parametrize(
    "rows, surplus, same_day",
    [
        ([{"msno": "lee"}, {"msno": "mo"}, {"msno": "nia"}], 0, 0),
        ([{"msno": "lee"}, {"msno": "lee"}, {}], 1, 2),
        ([{}, {"membership_expire_date": None}, {"msno": "mo"}], 0, 2),
        ([{}, {}, {}, {}, {"is_cancel": 1}], 3, 5),
    ],
)
def test_duplicates(spark, rows, surplus, same_day):
    got = one(checks.duplicate_rows(dated(spark, *rows)))
    assert (got["exact_duplicates"], got["same_day_user_rows"]) == (surplus, same_day)
    assert got["passed"] is (surplus == 0)


def test_duplicates_without_the_key_columns(spark):
    got = one(checks.duplicate_rows(spark.range(3).select(F.lit(1).alias("x"))))
    assert (got["exact_duplicates"], got["same_day_user_rows"]) == (2, 0)


def test_schema_conformance(spark):
    df = staged(spark, [{}])
    assert one(checks.schema_conformance(df, STAGED_TRANSACTIONS))["passed"]
    wrong = df.withColumn("list_price", F.col("list_price").cast("long")).drop("is_cancel").withColumn(
        "msno", F.lit(None).cast("string")
    )
    columns = checks.schema_columns(wrong.withColumn("extra", F.lit(1)), STAGED_TRANSACTIONS)
    failed = {r["column"] for r in columns.collect() if not r["passed"]}
    assert failed == {"list_price", "is_cancel", "msno", "extra"}


def test_unique_key(spark):
    assert one(checks.unique_key(dated(spark, {}, {"msno": "b"}), ["msno"]))["passed"]
    assert one(checks.unique_key(dated(spark, {}, {}), ["msno"]))["repeated_keys"] == 1


def test_price_reconciliation(spark):
    got = one(checks.price_reconciliation(staged(spark, [{}, {"actual_amount_paid": 61}])))
    assert (got["n_match"], got["n_under"], got["passed"]) == (1, 1, False)
    assert not one(checks.price_reconciliation(staged(spark, [{"actual_amount_paid": -1}])))["passed"]


def test_negative_drops_are_an_error(spark):
    counts = spark.createDataFrame([(10, 12, -2)], "raw long, staged long, dropped long")
    with pytest.raises(Exception, match="negative"):
        checks.row_count_reconciliation(counts, "raw", "staged", ["dropped"]).collect()
