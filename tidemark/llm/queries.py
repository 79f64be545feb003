"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, byte_pairs, fill_in_middle, htmltext, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, secrets, topk, warc
from tidemark.llm.common import table


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


def op2_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents")).drop("class_divergence", "common_divergence")


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return byte_pairs.digests(table(spark, folder, "documents"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, folder, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_exact_top_k, op3_mixing, op4_best_fit_packing, op5_ngram_jaccard_join, op6_warc,
    op7_quality_classifier, op8_lm_scoring, op9_quality_rules, op10_secret_scans,
    op11_byte_pairs, op12_fill_in_middle, op13_tokenizer_alignment)}
ORACLE = {"op2_exact_top_k": topk.ORACLE, "op3_mixing": mixing.ORACLE, "op5_ngram_jaccard_join": ngram_join.ORACLE,
          "op6_warc": warc.ORACLE, "op9_quality_rules": quality_rules.oracle(), "op12_fill_in_middle": fill_in_middle.ORACLE}
