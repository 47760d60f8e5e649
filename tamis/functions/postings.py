"""Columns of a posting: search text, digest block, captions, all of its urls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, lookup


def search_text(title=None, company=None, description=None, specialization=None, industry=None, skills=None) -> Column:
    """Everything a posting says, as one text; missing and empty parts are skipped."""
    parts = [F.nullif(col(c), F.lit("")) for c in (title, company, description) if c is not None]
    parts += [col(c) for c in (specialization, industry, skills) if c is not None]
    return F.concat_ws(" ", *parts)


def capitalize_first(c: Column | str) -> Column:
    c = col(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def posting_body(title: Column, company: Column, level: Column, url: Column) -> Column:
    """A digest entry without its number; absent company and url lines are left out."""
    name = F.coalesce(F.nullif(capitalize_first(title), F.lit("")), F.lit("—"))
    grade = F.coalesce(F.nullif(F.array_join(level, ", "), F.lit("")), F.lit("не указан"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("*"), name, F.lit("*")),
        F.concat(F.lit("🏢 "), F.nullif(capitalize_first(company), F.lit(""))),
        F.concat(F.lit("🎯 Грейд: "), grade),
        F.nullif(url, F.lit("")),
    )


def posting_block(number: Column, title: Column, company: Column, level: Column, url: Column) -> Column:
    """One numbered entry of a digest."""
    return F.concat(number.cast("string"), F.lit(". "), posting_body(title, company, level, url))


def caption(keys: Column, labels: Mapping[str, str], everything: str) -> Column:
    """Readable list of chosen keys; unknown keys are shown as they are, none chosen means all."""
    named = F.array_join(F.transform(keys, lambda k: lookup(k, labels)), ", ")
    return F.when(F.coalesce(F.size(keys), F.lit(0)) == 0, F.lit(everything)).otherwise(named)


def intro(first_time: Column, industries: Column, roles: Column, industry_labels, role_labels, days: int = 7) -> Column:
    """Opening line of a digest: for a new reader the period, for the others the news."""
    scope = F.concat(
        caption(industries, industry_labels, "все сферы"), F.lit(" · "), caption(roles, role_labels, "все роли")
    )
    return F.when(first_time, F.concat(F.lit(f"📅 Вакансии за последние {days} дней — "), scope)).otherwise(
        F.concat(F.lit("🆕 Новые вакансии — "), scope)
    )


def all_urls(url: Column, duplicate_urls: Column) -> Column:
    """Own url first, then those of its duplicates."""
    joined = F.concat(F.array(url), F.coalesce(duplicate_urls, F.array().cast("array<string>")))
    return F.filter(joined, lambda u: u.isNotNull())
