"""The pipeline against its stages' brute-force meanings."""

import __spark_entry__ as driver
import corpus_pipeline
from lapsewise.llm import quality
from lapsewise.llm.queries import QUERIES
from lapsewise.session import RELEASE_EVERY, Scratch
from tests.llm.odd import odd_documents
from tests.llm.test_near_duplicates import expected_groups
from tests.llm.test_packing_and_shards import check_sequences

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = driver.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)


def test_every_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = corpus_pipeline.language_id(spark, one, SF).cache()
    assert two.columns == docs.columns and two.count() >= 0.98 * one.count()
    three = corpus_pipeline.near_dedup(spark, two, SF).cache()
    groups = expected_groups({r.doc_id: r.text for r in two.collect()})[1]
    assert {r.doc_id for r in three.collect()} == set(groups.values())
    four = corpus_pipeline.best_fit_packing(spark, three, SF).collect()
    assert {r.doc_id for r in four} == set(groups.values())
    check_sequences([(r.sequence_id, r.offset, r.length) for r in four], 4096)


def test_the_whole_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(
        map(tuple, docs.select(*columns).collect())
    )


def test_odd_documents_pass_through(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert docs.count() >= 0


def test_rows_without_an_id_are_kept_by_near_dedup(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == texts


def test_the_driver_is_cleared_between_tables_and_stages(spark, monkeypatch):
    cleared = []
    monkeypatch.setattr(Scratch, "release", lambda self: cleared.append(self))
    scratch = Scratch(spark)
    kept = [scratch.write(spark.range(k), "numbers") for k in range(2 * RELEASE_EVERY + 1)]
    assert len(cleared) == 2
    assert [t.count() for t in kept] == list(range(2 * RELEASE_EVERY + 1))
    scratch.drop(*kept)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, docs, d: docs) for n in "abc"])
    docs = corpus_pipeline.run(spark, SF)
    assert len(cleared) == 5 and docs.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
