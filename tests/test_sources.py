from datetime import date

import pytest
from pyspark.sql import functions as F

from lapsewise.config import WAREHOUSE
from lapsewise.operators import ingest, spells
from lapsewise.plans import catalogue, marts
from lapsewise.plans.catalogue import REGISTRY
from lapsewise.schema import RAW_TRANSACTIONS
from lapsewise.sources import export, warehouse
from lapsewise.sources import (
    append_check_log,
    pick_source,
    read_raw_members,
    read_raw_transactions,
    with_source,
)

TX = (
    "msno,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,"
    "is_auto_renew,transaction_date,membership_expire_date,is_cancel"
)
MEM = "msno,city,bd,gender,registered_via,registration_init_time"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_good_files_read_typed(spark, tmp_path):
    tx = read_raw_transactions(
        spark, write(tmp_path / "t.csv", TX, "a,41,30,149,149,1,20150601,20150701,0")
    )
    assert tuple(tx.collect()[0]) == ("a", 41, 30, 149, 149, 1, 20150601, 20150701, 0)
    mem = read_raw_members(spark, write(tmp_path / "m.csv", MEM, "a,1,25,,7,20150601"))
    assert tuple(mem.collect()[0]) == ("a", 1, 25, None, 7, 20150601)


def test_a_bad_value_raises(spark, tmp_path):
    path = write(tmp_path / "t.csv", TX, "a,41,thirty,149,149,1,20150601,20150701,0")
    with pytest.raises(Exception):
        read_raw_transactions(spark, path).collect()


def test_a_reordered_or_renamed_header_raises(spark, tmp_path):
    swapped = TX.replace("payment_plan_days,plan_list_price", "plan_list_price,payment_plan_days")
    for header in (swapped, TX.replace("is_cancel", "cancelled")):
        path = write(tmp_path / f"{abs(hash(header))}.csv", header, "a,41,30,149,149,1,20150601,20150701,0")
        with pytest.raises(Exception):
            read_raw_transactions(spark, path).collect()


def test_an_out_of_range_value_raises(spark, tmp_path):
    path = write(tmp_path / "t.csv", TX, "a,99999,30,149,149,1,20150601,20150701,0")
    with pytest.raises(Exception):
        read_raw_transactions(spark, path).collect()


ROW = "41,30,149,149,1,20150601,20150701,0"


def delivery(tmp_path, name, *users):
    (tmp_path / name).mkdir()
    return str(write(tmp_path / name / "part.csv", TX, *[f"{u},{ROW}" for u in users]).rsplit("/", 1)[0])


def test_the_preferred_source_is_used_and_named(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("full", "refresh")]
    with pytest.raises(FileNotFoundError):
        pick_source(spark, folders)

    def picked():
        return [(r.msno, r.source_file.split("/")[-2]) for r in pick_source(spark, folders).collect()]

    delivery(tmp_path, "refresh", "b")
    assert picked() == [("b", "refresh")]
    delivery(tmp_path, "full", "a")
    assert picked() == [("a", "full")]


def test_counts_per_source_follow_rows_through_staging(spark, tmp_path):
    one, two = delivery(tmp_path, "1", "a", "a", "b"), delivery(tmp_path, "2", "b", "c")
    write(tmp_path / "2" / "bad.csv", TX, "d,41,30,149,149,1,20150601,20150501,0")
    raw = with_source(read_raw_transactions(spark, [one, two]))
    tagged = ingest.tag_quarantine(ingest.transform_transactions(raw))
    got = ingest.source_counts(tagged).collect()
    named = {tuple(r.source_file.split("/")[-2:]): tuple(r)[1:] for r in got}
    assert named == {
        ("1", "part.csv"): (3, 0, 2, 1), ("2", "part.csv"): (2, 0, 1, 1), ("2", "bad.csv"): (1, 1, 0, 0),
    }
    staged, quarantined = ingest.stage_transactions(raw)
    assert staged.count() == 3 and "source_file" not in staged.columns
    assert [r.source_file.split("/")[-1] for r in quarantined.collect()] == ["bad.csv"]


def test_the_check_log_accumulates(spark, tmp_path):
    one = spark.range(1).select(F.lit("x").alias("name"), F.lit(True).alias("passed"))
    append_check_log(one, str(tmp_path / "log"))
    append_check_log(one, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def _tables(spark, folder):
    """Ten orders of four lines each, by five customers."""
    lines = [(o, n, 7 * o, 3.0, 900.0 + o, "N", date(1998, 1 + o % 6, 1 + n)) for o in range(10) for n in range(4)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_shipdate date"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o, o % 5) for o in range(10)], "o_orderkey long, o_custkey long").write.parquet(
        f"{folder}/orders.parquet"
    )
    spark.createDataFrame([(c, c) for c in range(5)], "c_custkey long, c_nationkey int").write.parquet(
        f"{folder}/customer.parquet"
    )


def test_raw_files_are_written_without_another_shuffle_and_only_when_needed(spark, tmp_path, monkeypatch):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "out")
    _tables(spark, tables)
    frames = []
    monkeypatch.setattr(
        export, "_write_csv", lambda df, *rest, write=export._write_csv: (frames.append(df), write(df, *rest))
    )
    export.write_raw(spark, tables, out, 3)
    spans = {"one": (date(1998, 1, 1), date(1998, 4, 30)), "two": (date(1998, 4, 1), date(2001, 12, 31))}
    export.write_deliveries(spark, tables, out, spans, 3)
    for df in frames:
        assert "RoundRobin" not in df._jdf.queryExecution().toString()
    read = {n: read_raw_transactions(spark, f"{out}/{n}") for n in ("transactions", *spans)}
    assert len(read["transactions"].inputFiles()) >= 3
    expected = sorted(map(tuple, export.as_raw(
        warehouse.raw_transactions(spark, tables), RAW_TRANSACTIONS, export.TRANSACTION_DATES
    ).collect()))
    assert sorted(map(tuple, read["transactions"].collect())) == expected
    for name, span in spans.items():
        first, last = (int(f"{d:%Y%m%d}") for d in span)
        assert sorted(map(tuple, read[name].collect())) == [r for r in expected if first <= r[6] <= last]

    def refused(*_):
        raise AssertionError("not needed for members")

    monkeypatch.setattr(catalogue, "write_raw_transactions", refused)
    monkeypatch.setattr(catalogue, "write_deliveries", refused)
    assert REGISTRY["members_from_csv"](spark, tables).count() == 5


def test_queries_of_staged_rows_do_not_build_the_subject_table(spark, tmp_path, monkeypatch):
    tables = str(tmp_path / "tables")
    _tables(spark, tables)

    def refused(*_):
        raise AssertionError("not needed for staged rows")

    monkeypatch.setattr(spells, "build_subjects", refused)
    monkeypatch.setattr(spells, "user_rows", refused)
    assert REGISTRY["numbered_transactions"](spark, tables).count() == 34  # six copies
    assert REGISTRY["zero_day_profile"](spark, tables).filter("all_rows > 34").isEmpty()
    monkeypatch.undo()
    assert REGISTRY["reconciliation_marts"](spark, tables).count() == 1


def _built_from_staged(spark, tables):
    staged = ingest.stage_transactions(warehouse.raw_transactions(spark, tables), WAREHOUSE)[0]
    members = ingest.stage_members(warehouse.raw_members(spark, tables))
    return spells.build_subjects(staged, members, WAREHOUSE)


def test_subjects_are_built_by_one_shuffle_of_the_rows_and_without_staged(spark, tmp_path, monkeypatch):
    tables = str(tmp_path / "tables")
    _tables(spark, tables)
    written = {}
    monkeypatch.setattr(
        marts, "materialise", lambda df, name, write=marts.materialise: (written.update({name: df}), write(df, name))[1]
    )
    found = REGISTRY["revenue_per_day"](spark, tables)
    assert list(written) == ["marts-subjects"]
    plan = written["marts-subjects"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert found.count() >= 0
    expected = sorted(map(str, _built_from_staged(spark, tables).collect()))
    assert len(expected) == 5
    assert sorted(map(str, written["marts-subjects"].collect())) == expected

    # Rows that are staged already are not read from the raw tables again.
    built = marts.warehouse_marts(spark, tables, WAREHOUSE)
    assert built.staged.count() == 34
    assert list(written) == ["marts-subjects", "marts-staged"]
    assert all("marts-staged" in file for file in built.by_user.inputFiles())
    again = spells.build_subjects(built.by_user, built.members, WAREHOUSE)
    assert sorted(map(str, again.collect())) == expected


def test_tasks_grow_with_the_line_items(spark, tmp_path, monkeypatch):
    tables = str(tmp_path / "tables")
    _tables(spark, tables)
    expected = sorted(map(str, _built_from_staged(spark, tables).collect()))
    few = sorted(map(str, warehouse.raw_transactions(spark, tables).collect()))
    monkeypatch.setattr(warehouse, "ROWS_PER_TASK", 3)
    raw = warehouse.raw_transactions(spark, tables)
    assert "REPARTITION_BY_NUM, [plan_id" in raw._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, raw.collect())) == few
    dealt = warehouse.by_user(spark, tables, raw)
    assert dealt.rdd.getNumPartitions() == 14
    rows = ingest.stage_transactions(dealt, WAREHOUSE)[0]
    members = ingest.stage_members(warehouse.raw_members(spark, tables))
    assert sorted(map(str, spells.build_subjects(rows, members, WAREHOUSE).collect())) == expected
