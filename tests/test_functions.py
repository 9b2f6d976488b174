from datetime import date

import pytest
from pyspark.sql import functions as F

from lapsewise.functions import (
    exclude_value,
    null_sentinel,
    pack_day_pair,
    plan_type,
    ratio,
    unpack_flag,
    unpack_second_day,
    yyyymmdd_to_date,
)
from tests.helpers import rows_of


def ints(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def test_dates_parse_and_null_stays_null(spark):
    got = ints(spark, 20150601, 20160229, None).select(yyyymmdd_to_date("x").alias("d")).collect()
    assert [r.d for r in got] == [date(2015, 6, 1), date(2016, 2, 29), None]


@pytest.mark.parametrize("value", [20150230, 20151301, 20150100, 123, 0, -20150101])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_bad_date_raises_whatever_the_session_mode(spark, value, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception):
            ints(spark, 20150601, value).select(yyyymmdd_to_date("x")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_sentinel_is_nulled(spark):
    df = spark.createDataFrame([(date(1970, 1, 1),), (date(2015, 1, 1),)], "d date")
    got = df.select(null_sentinel("d", date(1970, 1, 1)).alias("d")).collect()
    assert [r.d for r in got] == [None, date(2015, 1, 1)]


def test_plan_type_boundaries(spark):
    df = ints(spark, None, -1, 0, 7, 8, 31, 32, 120, 121, 410)
    assert [r[0] for r in df.select(plan_type("x")).collect()] == [
        "unknown", "01_<=7d", "01_<=7d", "01_<=7d", "02_8-31d", "02_8-31d",
        "03_32-120d", "03_32-120d", "04_121d+", "04_121d+",
    ]


def test_excluding_a_value_keeps_missing_ones(spark):
    assert rows_of(exclude_value(ints(spark, 3, 4, None), "x", 3)) == [(4,), (None,)]


def test_ratio_is_null_on_zero(spark):
    df = ints(spark, 0, 4).select(ratio(F.lit(2), F.col("x")))
    assert [r[0] for r in df.collect()] == [None, 0.5]


def test_packed_days_sort_like_the_triple_and_unpack(spark):
    days = [date(1000, 1, 1), date(1969, 12, 31), date(1970, 1, 1), date(2017, 3, 1), date(9999, 12, 31)]
    triples = [(a, b, f) for a in days for b in days for f in (False, True)]
    df = spark.createDataFrame(triples, "a date, b date, f boolean")
    packed = df.withColumn("k", pack_day_pair(F.col("a"), F.col("b"), F.col("f")))
    assert [tuple(r) for r in packed.orderBy("k").select("a", "b", "f").collect()] == sorted(triples)
    back = packed.select("b", "f", unpack_second_day(F.col("k")).alias("b2"), unpack_flag(F.col("k")).alias("f2"))
    assert back.filter("b <> b2 or f <> f2").count() == 0
