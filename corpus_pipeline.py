"""Preparation of a training corpus: language, near duplicates, secrets, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet to the shared scratch folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import n_words
from tamis.llm.credentials import redact
from tamis.llm.jaccard import one_of_each
from tamis.llm.language import learn, predict
from tamis.llm.mixing import mix, repeated
from tamis.llm.packing import pack
from tamis.session import materialize

# Below this cosine the language of a text of WHOLE characters or more is not believed. The cosine of a short text is small by
# itself, so the limit falls with the length, to nothing at SHORT characters.
MIN_SCORE = 0.1
SHORT, WHOLE = 30, 300


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, under the language that was found.

    Null and empty texts, texts without letters, and longer texts unlike any language that was learned go. Rows with null or repeated
    ids are judged like others; with no language to learn from all go, and an empty table gives none.
    """
    learned = learn(docs)
    found = docs.withColumn("_found", predict(F.col("text"), learned))
    limit = F.lit(MIN_SCORE) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length("text") - SHORT) / (WHOLE - SHORT)))
    kept = found.where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= limit))
    return kept.withColumn("lang", F.col("_found.lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words and rows with a null id stay; of rows with one id and one text one stays, other texts under that id are
    judged for themselves. An empty table gives none.
    """
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes. Null texts stay null, and repeated rows and ids are masked each."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as many times as the mixture uses it.

    A null source is one of its own; texts without words never decide a budget. An empty table gives none.
    """
    return repeated(mix(docs, n_words(F.col("text")))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths. Null and empty texts give no piece; a null id is packed too."""
    return pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")), "doc_id", "n_tokens")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("sequences", sequences),
]

# A learned language and a best-fit search have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
