"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm import bpe, divergence, langid, merkle, ngram_bloom, nndescent, packing, quality, setsketch, sharding, suffix_dedup, toxicity, wrappers
from lapsewise.llm.common import ascii_lower, fold, table
from lapsewise.session import materialise

Query = Callable[[SparkSession, str], DataFrame]


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialise(sharding.weigh(docs, keep=("doc_id",)), "weighed")
    placed = materialise(sharding.shard(rows), "sharded")
    return sharding.number_slots(placed, ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ngram_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_bloom.score(docs, F.coalesce(fold("doc_id", 7) == 2, F.lit(False)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "finds"
    )


def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents"))
    named = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", named)


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = materialise(wrappers.infer(pages), "page-wrappers")
    return wrappers.extract(pages, found).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(encoded, path, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(pieces_of(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def pieces_of(docs: DataFrame) -> DataFrame:
    """The cut documents with a checksum in place of their ids, as a written table."""
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut(packing.tokenise(docs, path).drop("text"))
    checked = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return materialise(checked, "pieces")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    altered = F.when(F.coalesce(fold("doc_id", 5) == 0, F.lit(False)), ascii_lower(text)).otherwise(text)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.digest(*[merkle.encoded(F.col(c)) for c in fields])
    claimed = merkle.digest(*[merkle.encoded(F.col(c)) for c in fields[:-1]], merkle.encoded(altered))
    leaves = docs.select("source", "doc_id", leaf.alias("leaf"), claimed.alias("claimed"))
    return merkle.manifest(leaves).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Query] = {
    "op1_nn_descent": op1_nn_descent,
    "op2_sharding": op2_sharding,
    "op3_ngram_bloom": op3_ngram_bloom,
    "op4_toxicity": op4_toxicity,
    "op5_setsketch_near_dedup": op5_setsketch_near_dedup,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_divergence": op13_source_divergence,
}
