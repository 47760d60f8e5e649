"""The registered queries of these operators, over whole tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, table
from .jaccard import jaccard_components
from .language import language_id
from .licences import catalogue, licence_scan
from .mixing import mix
from .neighbours import search
from .packing import pack
from .pages import main_text
from .quality import quality
from .simhash import simhash_components
from .spelling import variants
from .suffixes import without_repeats
from .credentials import report
from .whitening import whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, n_words(F.col("text"))).select("doc_id", "source", "n_tokens", "n_uses")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("n_tokens"))
    return pack(docs, "doc_id", "n_tokens")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"), catalogue(spark))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_source_mixing,
        op3_quality_rules,
        op4_learned_partitions,
        op5_best_fit_packing,
        op6_license_scan,
        op7_suffix_dedup,
        op8_secret_scan,
        op9_language_id,
        op10_html_extraction,
        op11_simhash_near_dedup,
        op12_spelling_variants,
        op13_embedding_whitening,
    )
}
ORACLES: dict[str, str] = {}
