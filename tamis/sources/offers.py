"""Offer feed: landed JSON payloads to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_recent
from ..functions.matching import guess_level
from ..functions.money import parse_salary_text
from ..functions.text import resolve_url, strip_html
from ..rules.fixed import LEVEL_TAXONOMY
from ..schemas import OFFERS

BASE_URL = "https://getmatch.ru"


def read_offers(payloads: DataFrame, now: Column, days: int = 7, base_url: str = BASE_URL, source: str = "getmatch") -> DataFrame:
    """One posting per active, recent vacancy offer of ``(payload)`` rows; other columns are carried.

    Salary text is read only when both displayed bounds are missing. An unreadable date drops the offer.
    """
    carried = [c for c in payloads.columns if c != "payload"]
    offers = payloads.withColumn("_p", F.from_json("payload", OFFERS)).select(
        *carried, F.posexplode("_p.offers").alias("position", "o")
    )
    published = F.col("o.published_at").try_cast("timestamp_ntz")
    live = offers.withColumn("published_at", published).filter(
        (F.col("o.offer_type") == "vacancy") & F.coalesce("o.is_active", F.lit(False)) & is_recent("published_at", now, days)
    )
    hidden = F.col("o.salary_display_from").isNull() & F.col("o.salary_display_to").isNull()
    read = live.withColumn("_s", parse_salary_text("o.salary_description"))
    place = F.get("o.location_items", F.lit(0))
    named = F.filter("o.skills_objects", lambda s: F.coalesce(s["name"], F.lit("")) != "")
    return read.select(
        *carried,
        "position",
        F.col("o.position").alias("title"),
        F.col("o.company.name").alias("company"),
        place["label"].alias("location"),
        place["format"].alias("work_format"),
        F.when(hidden, F.col("_s.salary_min")).otherwise(F.col("o.salary_display_from")).alias("salary_min"),
        F.when(hidden, F.col("_s.salary_max")).otherwise(F.col("o.salary_display_to")).alias("salary_max"),
        F.coalesce(F.nullif("o.salary_currency", F.lit("")), F.when(hidden, F.col("_s.currency"))).alias("currency"),
        F.lit("month").alias("salary_period"),
        "published_at",
        resolve_url(base_url, F.coalesce("o.url", F.lit(""))).alias("url"),
        strip_html(F.nullif("o.offer_description", F.lit(""))).alias("description"),
        F.coalesce(F.transform(named, lambda s: F.lower(s["name"])), F.array().cast("array<string>")).alias("skills"),
        F.lit(source).alias("source"),
        guess_level("o.position", LEVEL_TAXONOMY).alias("level"),
    )
