"""Hand-label files: reading, cleaning, and label sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.base import SPACE
from ..functions.keys import split_keys
from ..operators.checks import require_labels
from ..schemas import GOLD, PAIR_GOLD

# --- fixed values: columns of the sheets ------------------------------------------------------------
SHEET_COLUMNS = ["url", "source", "company", "title", "description"]
LABEL_COLUMNS = ["ds_role", "roles", "industries", "industry_other", "unsure", "comment"]
PAIR_COLUMNS = [
    "company", "title_a", "title_b", "source_a", "source_b", "url_a", "url_b", "description_a", "description_b",
]
PAIR_LABELS = ["is_dup", "unsure", "comment"]
GOLD_PAIR_COLUMNS = ["company", "source_a", "title_a", "url_a", "source_b", "title_b", "url_b"]
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def type_gold(rows: DataFrame) -> DataFrame:
    """Labels with proper types; ``is_target`` follows from role and industries."""
    flag = F.col("ds_role").cast("boolean")
    return rows.withColumns(
        {
            "ds_role": flag,
            "unsure": F.coalesce(F.col("unsure").cast("boolean"), F.lit(False)),
            "roles": split_keys("roles"),
            "industries": split_keys("industries"),
        }
    ).withColumn("is_target", F.col("ds_role") & (F.size("industries") > 0))


def type_pairs(rows: DataFrame) -> DataFrame:
    sample = F.col("sample") if "sample" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns(
        {
            "is_dup": F.col("is_dup").cast("boolean"),
            "unsure": F.coalesce(F.col("unsure").cast("boolean"), F.lit(False)),
            "sample": F.coalesce(sample, F.lit("candidate")),
        }
    )


def read_named_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of ``schema`` by their names in the header, whatever their order; a byte-order mark is dropped.

    Quoted fields may hold line breaks and doubled quotes. Columns that the file lacks are null.
    """
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    rows = rows.toDF(*(c.lstrip("\ufeff").strip().strip('"') for c in rows.columns))
    wanted = StructType.fromDDL(schema)
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled postings from CSV."""
    rows = read_named_csv(spark, path, GOLD)
    require_labels(rows, "ds_role", "url")
    return type_gold(rows)


def read_pair_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = read_named_csv(spark, path, PAIR_GOLD)
    require_labels(rows, "is_dup", "url_a")
    return type_pairs(rows)


def label_sheet(rows: DataFrame, columns: list[str], labels: list[str], order: Column, description_chars: int | None = None) -> DataFrame:
    """Rows for hand labelling: clean text, no predictions, empty label columns, shuffled.

    Descriptions are whole unless ``description_chars`` says how many characters a sheet takes.
    """

    def clean(name: str) -> Column:
        text = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), CONTROL_CHARACTERS, "")
        return F.left(text, F.lit(description_chars)) if description_chars and name.startswith("description") else text

    empty = [F.lit(None).cast("string").alias(name) for name in labels]
    return rows.orderBy(order).select(*[clean(c).alias(c) for c in columns], *empty)


def _stripped(sheet: DataFrame) -> DataFrame:
    return sheet.select(*[F.regexp_replace(F.col(c).cast("string"), f"^{SPACE}+|{SPACE}+$", "").alias(c) for c in sheet.columns])


def _whole(c: str) -> Column:
    """«1.0» of a spreadsheet as 1."""
    return F.col(c).try_cast("double").try_cast("int")


def import_labels(sheet: DataFrame, dev_gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A filled sheet as (new labels, repeated labels of dev rows), both in url order."""
    rows = _stripped(sheet.select("url", *LABEL_COLUMNS))
    require_labels(rows, "ds_role", "url")
    typed = rows.withColumns({"ds_role": _whole("ds_role"), "unsure": _whole("unsure")})
    dev = dev_gold.select("url")
    return typed.join(dev, "url", "left_anti").orderBy("url"), typed.join(dev, "url", "left_semi").orderBy("url")


def import_pairs(sheet: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A filled pair sheet as (test pairs, repeated pairs); the hidden sample column comes back by url pair."""
    from ..operators.checks import require_unique

    rows = _stripped(sheet)
    require_labels(rows, "is_dup", "url_a")
    keys = ["url_a", "url_b"]
    require_unique(rows, keys)
    require_unique(samples, keys)
    typed = rows.withColumns({"is_dup": _whole("is_dup"), "unsure": _whole("unsure")}).join(samples.select(*keys, "sample"), keys)
    columns = [*GOLD_PAIR_COLUMNS, *PAIR_LABELS, "sample"]
    repeat = F.col("sample") == "recheck"
    return (
        typed.filter(~repeat).select(*columns).orderBy("sample", "company", *keys),
        typed.filter(repeat).select(*columns[:-1]).orderBy("company", *keys),
    )
