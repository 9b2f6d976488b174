"""Every registered query against its SQL oracle, over whole tables.

ORACLE_SF picks the folder (sf0.01 by default).
"""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from lapsewise.plans.catalogue import REGISTRY
from oracles.sql import ORACLES

FOLDER = f"/root/testdata/{os.environ.get('ORACLE_SF', 'sf0.01')}"
QUERIES = REGISTRY

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no warehouse tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())


def test_the_flagship_runs(spark):
    assert driver.flagship(spark, FOLDER).count() == 5  # all strata, unknown included


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    expected = comparable(columns, cursor.fetchall())
    assert comparable(got.columns, [tuple(r) for r in got.collect()]) == expected


def test_every_guard_and_stratum_has_rows(spark):
    reasons = {r[0] for r in QUERIES["spells_quarantine"](spark, FOLDER).select(
        "quarantine_reason").distinct().collect()}
    assert reasons == {"starts_after_label_cutoff", "negative_tenure", "entry_after_exit"}
    assert QUERIES["staged_members"](spark, FOLDER).filter("registered_via IS NULL").count() > 0


def test_no_line_or_customer_is_left_out(spark, duck):
    lines, customers = duck.execute(
        "SELECT (SELECT count(*) FROM lineitem), (SELECT count(*) FROM customer)"
    ).fetchone()
    assert QUERIES["staged_members"](spark, FOLDER).count() == customers
    assert QUERIES["ingest_counts"](spark, FOLDER).first()["raw_rows"] >= lines
