from datetime import date

from lapsewise.operators import ingest
from lapsewise.schema import RAW_TRANSACTIONS
from tests.helpers import frame, one, rows_of

DEFAULT = {
    "msno": "a", "payment_method_id": 41, "payment_plan_days": 30, "plan_list_price": 149,
    "actual_amount_paid": 149, "is_auto_renew": 1, "transaction_date": 20150601,
    "membership_expire_date": 20150701, "is_cancel": 0,
}


def raw(spark, rows):
    return frame(spark, RAW_TRANSACTIONS, DEFAULT, rows)


def typed(spark, **row):
    return one(ingest.transform_transactions(raw(spark, [row])))


def test_an_ordinary_row_is_only_typed(spark):
    assert typed(spark) == {
        "msno": "a", "payment_method_id": 41, "plan_days": 30, "list_price": 149,
        "actual_amount_paid": 149, "is_auto_renew": True, "transaction_date": date(2015, 6, 1),
        "membership_expire_date": date(2015, 7, 1), "is_cancel": False,
        "plan_days_imputed": False,
    }


def test_a_zero_day_row_recovers_length_and_price(spark):
    got = typed(spark, payment_plan_days=0, plan_list_price=0)
    assert (got["plan_days"], got["list_price"], got["plan_days_imputed"]) == (30, 149, True)


def test_length_stays_unknown_when_the_row_does_not_extend_membership(spark):
    for expiry in (20150601, 20150501, 19700101):
        got = typed(spark, payment_plan_days=0, membership_expire_date=expiry)
        assert got["plan_days"] is None and got["plan_days_imputed"]


def test_the_sentinel_becomes_null(spark):
    assert typed(spark, membership_expire_date=19700101)["membership_expire_date"] is None


def test_only_uncancelled_backwards_rows_are_quarantined(spark):
    rows = [
        {"msno": "bad", "membership_expire_date": 20150501},
        {"msno": "cancel", "membership_expire_date": 20150501, "is_cancel": 1},
        {"msno": "null", "membership_expire_date": 19700101},
        {"msno": "same", "membership_expire_date": 20150601},
    ]
    clean, bad = ingest.split_quarantine(ingest.transform_transactions(raw(spark, rows)))
    assert rows_of(clean, "msno") == [("cancel",), ("null",), ("same",)]
    assert rows_of(bad, "msno", "quarantine_reason") == [("bad", ingest.QUARANTINE_REASON)]


def test_copies_are_removed_from_staged_but_kept_in_quarantine(spark):
    rows = [{}] * 3 + [{"membership_expire_date": 20150501}] * 2 + [{"msno": "b"}]
    staged, bad = ingest.stage_transactions(raw(spark, rows))
    assert (staged.count(), bad.count()) == (2, 2)
    assert one(ingest.ingest_counts(raw(spark, rows))) == {
        "raw_rows": 6, "sentinels_nulled": 0, "staged_rows": 2, "quarantined": 2, "duplicates": 2,
    }
