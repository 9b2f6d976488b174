"""Versions, manifests and recorded figures."""

import pytest

from lapsewise.sources import Published, PublishConflict
from lapsewise.sources.figures import record_figures, table_state
from tests.helpers import rows_of


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_tables_of_a_draft_appear_together(spark, tmp_path):
    out = Published(spark, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        out.table("a")
    draft = out.draft()
    draft.write("a", numbers(spark, 1))
    assert rows_of(draft.table("a")) == [(1,)] and out.manifest() == {}
    draft.write_together({"b": lambda: numbers(spark, 2), "c": lambda: numbers(spark, 3)})
    assert draft.commit() == 1
    assert [rows_of(out.table(n)) for n in "abc"] == [[(1,)], [(2,)], [(3,)]]
    # A later draft carries over what it does not write; the former version stays readable.
    draft = out.draft()
    draft.write("b", numbers(spark, 20))
    draft.commit()
    assert [rows_of(out.table(n)) for n in "abc"] == [[(1,)], [(20,)], [(3,)]]
    assert rows_of(out.table("b", version=1)) == [(2,)]


def test_the_later_of_two_commits_from_one_version_fails(spark, tmp_path):
    out = Published(spark, str(tmp_path))
    one, two = out.draft(), out.draft()
    one.write("a", numbers(spark, 1))
    two.write("a", numbers(spark, 2))
    one.commit()
    with pytest.raises(PublishConflict):
        two.commit()
    two.discard()
    assert rows_of(out.table("a")) == [(1,)]


def test_expired_versions_go_and_carried_tables_stay(spark, tmp_path):
    out = Published(spark, str(tmp_path))
    for v in range(4):
        draft = out.draft()
        draft.write("moving", numbers(spark, v))
        if v == 0:
            draft.write("fixed", numbers(spark, 99))
        draft.commit()
    out.expire(keep=2)
    assert out.versions() == [3, 4]
    assert rows_of(out.table("fixed")) == [(99,)] and rows_of(out.table("moving", 3)) == [(2,)]
    assert len(list(tmp_path.glob("v*/moving"))) == 2


def figures(spark, **values):
    return spark.createDataFrame(list(values.items()), "metric string, observed double")


def test_figures_are_new_then_match_then_drift(spark, tmp_path):
    table, kept = str(tmp_path / "t"), str(tmp_path / "figures")

    def run():
        total = float(spark.read.parquet(table).agg({"v": "sum"}).first()[0])
        return rows_of(
            record_figures(figures(spark, total=total, none=None), kept, table_state(spark, table)),
            "metric", "status",
        )

    numbers(spark, 1, 2).write.parquet(table)
    assert run() == [("none", "NEW"), ("total", "NEW")]
    assert run() == [("none", "MATCH"), ("total", "MATCH")]
    numbers(spark, 3).write.mode("append").parquet(table)
    assert run() == [("none", "MATCH"), ("total", "DRIFT")]
    states = spark.read.json(kept).select("version", "state").distinct().orderBy("version").collect()
    assert [r.version for r in states] == [1, 2, 3]
    assert states[0].state == states[1].state != states[2].state


def test_a_value_that_appears_or_goes_drifts(spark, tmp_path):
    kept = str(tmp_path / "figures")
    record_figures(figures(spark, a=None, b=1.0), kept, "s")
    got = record_figures(figures(spark, a=1.0, b=None, c=2.0), kept, "s")
    assert rows_of(got, "metric", "status") == [("a", "DRIFT"), ("b", "DRIFT"), ("c", "NEW")]
