"""The supplied tables, and postings read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import RuleSet


TEXT_TABLES = {"documents", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Spread rows that are costly to parse over the cores, when they arrive in fewer splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def register(name: str, sql: str | None = None):
        def wrap(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return wrap

    return queries, oracles, register


def title_of(text: str = "text"):
    """First line of a text, as a whole."""
    return F.substring_index(F.col(text), "\n", 1)


TITLE_SQL = "split_part(text, chr(10), 1)"


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as postings: language is the company, the first line is the title."""
    none = F.lit(None).cast("double")
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("url"),
        "source",
        F.col("lang").alias("company"),
        title_of().alias("title"),
        F.col("text").alias("description"),
        none.alias("salary_min"),
        none.alias("salary_max"),
        F.array().cast("array<string>").alias("skills"),
        F.col("doc_id").alias("ingest_seq"),
    )


# Rules in the invented languages of the supplied texts, in the shape of the real ones.
SAMPLE_RULES = RuleSet(
    industries={
        "press": ["tion the", "ention", "heblest"],
        "trade": ["queaux", "les eau", "ment"],
        "craft": ["schen", "lich die", "und ver"],
        "travel": ["ción", "ando", "para los"],
        "bank": ["her the", "ing of", "est and"],
        "games": ["ouenan", "thatble"],
    },
    industry_excludes={"press": ["of the", "edthe"], "bank": ["ering the", "in the", "ble"]},
    roles={
        "writer": ["the", "of the", "and a"],
        "baker": ["de la", "que", "les"],
        "smith": ["und", "der die", "für"],
        "guide": ["los", "para la", "que el"],
        "clerk": ["in - the", "with/for", "a"],
    },
    excluded_roles=["is", "von", "le", "en la", "are / is"],
    levels={
        "junior": ["on", "un", "ein"],
        "senior": ["of", "du", "das", "del"],
        "lead": ["the", "by the"],
    },
    skills=["tion", "EAU", "sch", "ing", "que"],
)
