"""Documents to packed training sequences, in four stages.

quality_rules keeps the documents no rule rejects, language_id those whose language is
told with enough certainty, near_dedup one document of every group of near duplicates,
and packing places what is left into sequences. Every stage works on all the stage
before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import langid, packing, quality, setsketch
from lapsewise.llm.common import table
from lapsewise.llm.queries import pieces_of
from lapsewise.session import Scratch, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return quality.passing(docs.select(*COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is not rejected. The model learns from those
    that name theirs, and none is used to predict."""
    model = langid.fit(docs)
    return langid.identify(docs.select(*COLUMNS), model).filter("NOT rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group: one with the smallest id, if any has an id. A row that is
    repeated with its id stays once; rows of one id with unlike texts all stay."""
    return setsketch.without_near_duplicates(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and place."""
    pieces = pieces_of(docs.select("doc_id", "text"))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Likelihoods, trained models and packing are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        Scratch(spark).release()
    return docs
