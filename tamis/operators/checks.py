"""Data-quality checks: queries that return violations, and guards that raise on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.base import text_array


class BadLabels(ValueError):
    pass


def missing_labels(rows: DataFrame, label: str, key: str) -> DataFrame:
    return rows.filter(F.col(label).isNull()).select(key)


def require_labels(rows: DataFrame, label: str, key: str) -> None:
    found = [r[0] for r in missing_labels(rows, label, key).take(10)]
    if found:
        raise BadLabels(f"{label} is missing for {found}")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> None:
    found = repeated_keys(rows, keys).take(10)
    if found:
        raise BadLabels(f"repeated {keys}: {found}")


def gold_violations(gold: DataFrame, role_keys: list[str], industry_keys: list[str]) -> DataFrame:
    """``(url, problem)`` of a typed gold table: repeated urls, unknown keys, inconsistent labels.

    ``other`` is a valid role but not a valid industry.
    """
    repeated = repeated_keys(gold, ["url"]).select("url", F.lit("repeated url").alias("problem"))
    unknown = F.array_union(
        F.array_except("roles", text_array([*role_keys, "other"])), F.array_except("industries", text_array(industry_keys))
    )
    rules = F.array_compact(
        F.array(
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown keys "), F.array_join(F.array_sort(unknown), ","))),
            F.when(F.col("ds_role") & (F.size("roles") == 0), F.lit("role without roles")),
            F.when(~F.col("ds_role") & ((F.size("roles") > 0) | (F.size("industries") > 0)), F.lit("keys without role")),
        )
    )
    return repeated.unionByName(gold.select("url", F.explode(rules).alias("problem")))


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that occur more than once, in either order."""
    return (
        pairs.groupBy(F.least("url_a", "url_b").alias("low"), F.greatest("url_a", "url_b").alias("high"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def unknown_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct values of ``column`` that the other table does not hold."""
    return rows.select(F.col(column).alias(key)).distinct().join(known.select(key), key, "left_anti")


def require_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> None:
    found = [r[0] for r in unknown_references(rows, column, known, key).take(10)]
    if found:
        raise BadLabels(f"{column} not in the snapshot: {found}")
