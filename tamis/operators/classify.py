"""Normalizing and classifying whole tables of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import find_excluded_roles, find_grouped, find_roles, industry_text
from ..functions.postings import search_text
from ..functions.text import blanks_to_null, normalize_location, normalize_text, normalize_work_format
from ..rules import RuleSet
from ..rules.fixed import NAIVE_TITLE


def normalize_postings(df: DataFrame) -> DataFrame:
    """Common spelling of text fields and types; columns that are absent stay absent."""
    kinds = dict(df.dtypes)
    fixes: dict[str, Column] = {}
    for name in ("title", "company", "description"):
        fixes[name] = normalize_text(name)
    fixes["location"] = normalize_location("location")
    fixes["work_format"] = normalize_work_format("work_format")
    for name in ("salary_min", "salary_max"):
        fixes[name] = F.col(name).try_cast("double")
    fixes["published_at"] = F.col("published_at").try_cast("timestamp_ntz")
    return df.withColumns({k: v for k, v in fixes.items() if k in kinds})


def classify(df: DataFrame, rules: RuleSet, wide: bool = False) -> DataFrame:
    """Append ``industries`` (industry -> hit keywords), ``matched_roles``, ``excluded_roles``, ``is_target``.

    With ``wide`` every industry also becomes a column of hit keywords, empty when none.
    """

    def opt(name: str) -> Column | None:
        return F.col(name) if name in df.columns else None

    none = F.lit(None).cast("string")
    title = opt("title") if "title" in df.columns else none
    company = opt("company") if "company" in df.columns else none
    text = search_text(
        title, company, *[opt(c) for c in ("description", "specialization", "industry", "skills")]
    )
    # one lower-cased copy of the text feeds every industry
    body = F.col("_text")
    searched = {key: industry_text(company, title, body, rules.industry_excludes.get(key, []), lowered_text=True) for key in rules.industries}
    found = F.struct(
        find_grouped(body, rules.industries, searched).alias("_hits"),
        find_roles(title, rules.roles).alias("matched_roles"),
        find_excluded_roles(title, rules.excluded_roles).alias("excluded_roles"),
    )
    # a generated row is evaluated once, however often its fields are used or filtered on
    out = df.withColumn("_text", F.lower(text)).withColumn("_found", F.explode(F.array(found)))
    out = out.select(*df.columns, "_found.*").withColumn("industries", F.map_filter("_hits", lambda k, v: F.size(v) > 0))
    if wide:
        out = out.withColumns({k: F.try_element_at("_hits", F.lit(k)) for k in rules.industries})
    return out.withColumn(
        "is_target",
        (F.size("matched_roles") > 0) & (F.size("excluded_roles") == 0) & (F.size("industries") > 0),
    ).drop("_hits")


def naive_title_match(title: Column | str) -> Column:
    """Baseline: a title with one of a few telling words."""
    t = F.col(title) if isinstance(title, str) else title
    return F.rlike(F.coalesce(t, F.lit("")), F.lit("(?U)" + NAIVE_TITLE))


def predict(snapshot: DataFrame, rules: RuleSet) -> DataFrame:
    """Predictions for a labelled snapshot: normalized and classified, but not de-duplicated."""
    out = classify(normalize_postings(blanks_to_null(snapshot)), rules)
    return out.withColumns(
        {
            "role_pred": (F.size("matched_roles") > 0) & (F.size("excluded_roles") == 0),
            "naive_pred": naive_title_match("title"),
            "ind_pred": F.map_keys("industries"),
        }
    ).withColumnRenamed("is_target", "target_pred")


def funnel(df: DataFrame, n_raw: int | None = None) -> DataFrame:
    """Counts from classified rows to rows with a wanted role to targets, in one pass."""
    role = (F.size("matched_roles") > 0) & (F.size("excluded_roles") == 0)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_deduped"),
        F.count_if(role).alias("n_role"),
        F.count_if("is_target").alias("n_target"),
    )
    return counts if n_raw is None else counts.withColumn("n_raw", F.lit(n_raw).cast("bigint"))
