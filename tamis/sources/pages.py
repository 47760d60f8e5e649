"""Listing and detail pages of two boards: elements of landed HTML as columns.

Elements are found by tag and class and end at their own closing tag, so nested elements of the same
kind stay inside. Everything is a column expression over the page text.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, let, lookup
from ..functions.dates import is_recent, parse_day_month, parse_relative
from ..functions.matching import find_keywords, guess_level
from ..functions.money import parse_salary
from ..functions.text import decode_entities, joined_html, resolve_url, strip_html
from ..rules.fixed import LEVEL_TAXONOMY, SKILLS_VOCABULARY

GEEKJOB_URL = "https://geekjob.ru/vacancies"
HIRIFY_URL = "https://hirify.me/"

# --- fixed values: headings and labels of the detail pages -----------------------------------------
TAG_HEADINGS = {
    "Специализация": "specialization",
    "Отрасль и сфера применения": "industry",
    "Уровень должности": "level",
}
DETAIL_LABELS = {"work_format": "Формат работы", "location": "Страна", "grade": "Грейд"}


def opening(tag: str, *classes: str, whole: str | None = None, ident: str | None = None) -> str:
    """Pattern of an opening tag with one of ``classes``, a whole class attribute, or an id."""
    need = ""
    if classes:
        names = "|".join(classes)
        need = rf"""(?=[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:{names})(?:\s[^"']*)?["'])"""
    if whole:
        need = rf"""(?=[^>]*\bclass\s*=\s*["']{whole}["'])"""
    if ident:
        need = rf"""(?=[^>]*\bid\s*=\s*["']{ident}["'])"""
    return rf"(?i)<{tag}\b{need}[^>]*>"


def _inner_length(rest: Column, tag: str) -> Column:
    """How many characters of ``rest`` come before the closing tag that ends the open element."""
    bits = F.split(rest, rf"(?i)(?=<{tag}\b|</{tag}\s*>)")

    def step(acc: Column, bit: Column) -> Column:
        change = F.when(F.rlike(bit, F.lit(rf"(?i)^<{tag}\b")), 1).when(F.rlike(bit, F.lit(rf"(?i)^</{tag}\s*>")), -1).otherwise(0)
        depth = acc["depth"] + change
        done = acc["done"] | (depth < 0)
        return F.struct(
            depth.alias("depth"),
            (acc["size"] + F.when(done, 0).otherwise(F.length(bit))).alias("size"),
            done.alias("done"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
    return F.aggregate(bits, start, step, lambda acc: acc["size"])


def inner(html: Column | str, tag: str, open_pattern: str) -> Column:
    """Content of the first matching element; NULL when there is none."""
    rest = F.get(F.split(col(html), open_pattern, 2), F.lit(1))
    return let(rest, lambda r: F.left(r, _inner_length(r, tag)))


def without(html: Column | str, tag: str, open_pattern: str) -> Column:
    """The page text with the first matching element cut out."""

    def cut(parts: Column) -> Column:
        tail = let(
            F.get(parts, F.lit(1)),
            lambda r: F.regexp_replace(F.substr(r, _inner_length(r, tag) + 1), rf"(?i)^</{tag}\s*>", ""),
        )
        return F.when(F.size(parts) > 1, F.concat(parts.getItem(0), F.lit("<br>"), tail)).otherwise(parts.getItem(0))

    return let(F.split(col(html), open_pattern, 2), cut)


def all_inner(html: Column | str, tag: str, open_pattern: str) -> Column:
    """Contents of every matching element, in page order; NULL for a NULL page."""
    bare = open_pattern.removeprefix("(?i)")
    chunks = F.split(col(html), f"(?i)(?={bare})")
    starts = F.filter(chunks, lambda c: F.rlike(c, F.lit(f"(?i)^{bare}")))
    return F.transform(starts, lambda c: inner(c, tag, open_pattern))


def attribute(html: Column, open_pattern: str, name: str) -> Column:
    """Value of an attribute of the first matching opening tag."""
    bare = open_pattern.removeprefix("(?i)")
    tag_text = F.regexp_extract(html, f"(?i)({bare})", 1)
    found = F.regexp_extract(tag_text, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1)
    return F.when(F.rlike(html, F.lit(open_pattern)), decode_entities(found))


def explode_cards(pages: DataFrame, tag: str, open_pattern: str) -> DataFrame:
    """One row per listing card with its page columns, ``position`` and ``card`` (its HTML)."""
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(*keep, F.posexplode(all_inner("html", tag, open_pattern)).alias("position", "card"))


# ---- board one: cards with a date like «17 августа» ------------------------------------------------


def geekjob_cards(pages: DataFrame, base_url: str = GEEKJOB_URL) -> DataFrame:
    cards = explode_cards(pages, "li", opening("li", whole="collection-item avatar"))
    salary_tag = opening("span", "salary")
    out = cards.withColumn("_info", inner("card", "div", opening("div", "info")))
    title = opening("a", "title")
    return out.select(
        *[c for c in cards.columns if c != "card"],
        joined_html(inner("card", "a", title)).alias("title"),
        joined_html(inner("card", "p", opening("p", "company-name"))).alias("company"),
        F.nullif(strip_html(without("_info", "span", salary_tag)), F.lit("")).alias("location"),
        joined_html(inner("_info", "span", salary_tag)).alias("salary_text"),
        joined_html(inner("card", "span", opening("span", "inhouse-label", "remote-label"))).alias("work_format"),
        joined_html(inner("card", "time", opening("time", "datetime-info"))).alias("date_text"),
        resolve_url(base_url, attribute(F.col("card"), title, "href")).alias("url"),
        F.lit("geekjob").alias("source"),
    )


def page_description(html: Column | str) -> Column:
    return strip_html(inner(html, "div", opening("div", ident="vacancy-description")))


def grouped_tags(html: Column | str, headings: dict[str, str] = TAG_HEADINGS) -> Column:
    """Chips under the last heading seen, per known heading; NULL when a heading has none."""
    marks = F.regexp_extract_all(
        inner(html, "div", opening("div", "tags-list")), F.lit(r"(?is)(<b\b[^>]*>.*?</b\s*>|<a\b[^>]*>.*?</a\s*>)"), F.lit(1)
    )
    names = list(headings.values())
    chip = opening("a", "chip").replace("(?i)", "(?i)^")

    def step(acc: Column, mark: Column) -> Column:
        heading = F.rlike(mark, F.lit(r"(?i)^<b\b"))
        label = joined_html(mark)
        known = F.nullif(lookup(label, headings, default=F.lit("")), F.lit(""))
        fields = [F.when(heading, known).otherwise(acc["current"]).alias("current")]
        for n in names:
            add = ~heading & F.rlike(mark, F.lit(chip)) & F.coalesce(acc["current"] == n, F.lit(False))
            fields.append(F.when(add, F.array_append(acc[n], label)).otherwise(acc[n]).alias(n))
        return F.struct(*fields)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("current"), *[none.alias(n) for n in names])
    return F.aggregate(
        F.coalesce(marks, none), start, step,
        lambda acc: F.struct(*[F.when(F.size(acc[n]) > 0, acc[n]).alias(n) for n in names]),
    )


def assemble_geekjob(cards: DataFrame, details: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cards of the period joined to their pages ``(url, html)``; a missing page leaves its fields NULL."""
    dated = cards.withColumn("published_at", parse_day_month("date_text", now)).filter(is_recent("published_at", now, days))
    pages = details.select("url", page_description("html").alias("description"), grouped_tags("html").alias("_t"))
    return (
        dated.join(pages, "url", "left")
        .withColumn("_s", parse_salary("salary_text"))
        .withColumns(
            {
                "specialization": F.col("_t.specialization"),
                "industry": F.col("_t.industry"),
                "level": F.coalesce(F.col("_t.level"), guess_level("title", LEVEL_TAXONOMY)),
                "skills": find_keywords("description", SKILLS_VOCABULARY),
            }
        )
        .select("*", "_s.*")
        .drop("_t", "_s", "salary_text", "date_text")
    )


# ---- board two: cards with a relative date ----------------------------------------------------------


def hirify_cards(pages: DataFrame, base_url: str = HIRIFY_URL) -> DataFrame:
    cards = explode_cards(pages, "div", opening("div", "vacancy-card"))
    link = opening("a", "vacancy-card-link")
    return cards.select(
        *[c for c in cards.columns if c != "card"],
        joined_html(inner("card", "h3", opening("h3", "title"))).alias("title"),
        joined_html(inner("card", "div", opening("div", "company"))).alias("company"),
        resolve_url(base_url, attribute(F.col("card"), link, "href")).alias("url"),
        joined_html(inner("card", "div", opening("div", "date-full"))).alias("date_text"),
        strip_html(inner("card", "div", opening("div", "salary"))).alias("salary_text"),
        F.lit("hirify").alias("source"),
    )


def summary_and_body(html: Column | str) -> Column:
    """Short summary and body text without the body's first button; NULL when the page has neither."""
    brief = strip_html(inner(html, "div", opening("div", "vacancy-tldr__text")))
    body = strip_html(without(inner(html, "div", opening("div", "description")), "button", opening("button")))
    return F.when(brief.isNotNull() | body.isNotNull(), F.concat_ws(" ", brief, body))


def detail_map(html: Column | str) -> Column:
    """Label -> value of the details block; a repeated label keeps its last value; empty without a block."""
    block = inner(html, "div", opening("div", "vacancy-common-tags"))
    items = F.transform(
        all_inner(block, "div", opening("div", "common-detail-item")),
        lambda i: F.struct(
            joined_html(inner(i, "div", opening("div", "label"))).alias("k"),
            joined_html(inner(i, "div", opening("div", "value"))).alias("v"),
        ),
    )
    both = F.filter(items, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        F.coalesce(both, F.array().cast("array<struct<k:string,v:string>>")), empty,
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])),
    )


def skill_buttons(html: Column | str) -> Column:
    block = inner(html, "div", opening("div", "vacancy-detail-tags"))
    found = F.transform(all_inner(block, "button", opening("button", "tag")), joined_html)
    return F.coalesce(found, F.array().cast("array<string>"))


def assemble_hirify(cards: DataFrame, details: DataFrame, now: Column, days: int = 7) -> DataFrame:
    dated = (
        cards.filter(F.coalesce("url", F.lit("")) != "")
        .withColumn("published_at", parse_relative("date_text", now))
        .filter(is_recent("published_at", now, days))
    )
    pages = details.select(
        "url",
        summary_and_body("html").alias("description"),
        detail_map("html").alias("_d"),
        skill_buttons("html").alias("_skills"),
    )

    def label(name: str) -> Column:
        return F.try_element_at("_d", F.lit(DETAIL_LABELS[name]))

    grade = F.nullif(label("grade"), F.lit(""))
    return (
        dated.join(pages, "url", "left")
        .withColumn("_s", parse_salary("salary_text", detect_period=False))
        .withColumns(
            {
                "work_format": label("work_format"),
                "location": label("location"),
                "level": F.when(grade.isNotNull(), guess_level(grade, LEVEL_TAXONOMY)).otherwise(guess_level("title", LEVEL_TAXONOMY)),
                "skills": F.coalesce("_skills", F.array().cast("array<string>")),
            }
        )
        .select("*", "_s.*")
        .drop("_d", "_s", "_skills", "salary_text", "date_text")
    )


