"""Sources: HTML listings and details, offer feeds, union, label files. Inputs are made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import resolve_url
from ..operators import store
from ..operators.evaluation import value_counts
from ..rules.fixed import SKILLS_VOCABULARY
from ..session import scratch_path
from ..sources import labels, offers, pages
from ..sources.union import union_sources
from .inputs import TITLE_SQL, postings, registry, spread, table
from .text_queries import sql_list

QUERIES, ORACLES, register = registry()

NOW = "2026-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---- the supplied pages -------------------------------------------------------------------------------------


@register(
    "page_links",
    """SELECT page_id, i - 1 AS position, trim(regexp_extract(x, '">([^<]*)</a>', 1)) AS label, 'https://site.example' || regexp_extract(x, 'href="([^"]*)"', 1) AS url
       FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
         SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages))""",
)
def page_links(spark, sf):
    cards = pages.explode_cards(table(spark, sf, "pages").drop("url"), "li", pages.opening("li"))
    link = pages.opening("a")
    return cards.select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        pages.joined_html(pages.inner("card", "a", link)).alias("label"),
        resolve_url("https://site.example/en/", pages.attribute(F.col("card"), link, "href")).alias("url"),
    )


@register(
    "url_resolve",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://base.example' || p ELSE 'https://base.example/a/' || substr(p, 2) END AS u
       FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS p FROM pages)""",
)
def url_resolve(spark, sf):
    p, kind = F.regexp_extract("url", "^https?://[^/]*(/.*)$", 1), F.col("page_id") % 3
    href = F.when(kind == 0, F.col("url")).when(kind == 1, p).otherwise(F.substr(p, F.lit(2)))
    return table(spark, sf, "pages").select("page_id", resolve_url("https://base.example/a/b", href).alias("u"))


# ---- boards ---------------------------------------------------------------------------------------------------

_DAY = "(p_size % 28 + 1)"


def _listing(spark, sf, card) -> DataFrame:
    """Listing pages of twenty cards each, made of parts."""
    cards = table(spark, sf, "part").select(F.expr("p_partkey div 20").alias("page"), "p_partkey", card.alias("card"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))).getField("card"), "\n")
    made = cards.groupBy("page").agg(F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul></body></html>")).alias("html"))
    return made.repartition(spark.sparkContext.defaultParallelism)


def _geekjob_card():
    return F.concat(
        F.lit('<li class="collection-item avatar"><p class="truncate company-name"> '), F.col("p_brand"),
        F.lit('</p><a class="title" href="/vacancy/'), F.col("p_partkey").cast("string"), F.lit('?a=1&amp;b=2"> '), F.col("p_name"),
        F.lit(' Team Lead</a><div class="info">Москва <span class="salary">от '), F.format_number(F.floor("p_retailprice"), 0),
        F.lit(" ₽ в год</span> <div>"), F.col("p_type"), F.lit('</div></div><span class="remote-label">Удалённо</span>'),
        F.lit('<time class="datetime-info">'), (F.col("p_size") % 28 + 1).cast("string"), F.lit(" января</time></li>"),
    )


@register(
    "page_cards",
    f"""SELECT p_partkey // 20 AS page, p_partkey % 20 AS position, p_name || ' Team Lead' AS title, p_brand AS company, 'Москва ' || p_type AS location,
        'от ' || format('{{:,}}', floor(p_retailprice)::BIGINT) || ' ₽ в год' AS salary_text, 'Удалённо' AS work_format, {_DAY} || ' января' AS date_text,
        'https://geekjob.ru/vacancy/' || p_partkey || '?a=1&b=2' AS url, 'geekjob' AS source FROM part""",
)
def page_cards(spark, sf):
    cards = pages.geekjob_cards(_listing(spark, sf, _geekjob_card()))
    return cards.withColumn("position", F.col("position").cast("bigint"))


def _geekjob_details(spark, sf) -> DataFrame:
    """Detail pages; those of the smallest sizes cannot be fetched."""
    level = F.when(F.col("p_size") > 25, '<a class="chip">Senior</a>').otherwise("")
    html = F.concat(
        F.lit('<div class="side"><b>x</b></div><div class="tags-list"><b>Специализация</b><a class="chip" href="#">'), F.col("p_name"),
        F.lit('</a> <a class="small chip">'), F.col("p_type"), F.lit('</a><a class="other">no</a><b>Прочее</b><a class="chip">zzz</a><b>Уровень должности</b>'),
        level, F.lit('</div><div id="vacancy-description"><div>Описание <b>python</b></div><div> sql &amp; '), F.col("p_name"),
        F.lit(" </div> итог<script>var go = 1;</script></div><div>after</div>"),
    )
    url = F.concat(F.lit("https://geekjob.ru/vacancy/"), F.col("p_partkey").cast("string"), F.lit("?a=1&b=2"))
    return spread(table(spark, sf, "part")).filter("p_size > 5").select(url.alias("url"), html.alias("html"))


@register(
    "page_sections",
    """SELECT 'https://geekjob.ru/vacancy/' || p_partkey || '?a=1&b=2' AS url, p_name || '|' || p_type AS specialization, NULL::VARCHAR AS industry,
        CASE WHEN p_size > 25 THEN 'Senior' END AS level FROM part WHERE p_size > 5""",
)
def page_sections(spark, sf):
    tags = _geekjob_details(spark, sf).select("url", pages.grouped_tags("html").alias("t"))
    return tags.select("url", *[F.array_join(f"t.{n}", "|").alias(n) for n in ("specialization", "industry", "level")])


_DESCRIPTION = "CASE WHEN p_size > 5 THEN 'Описание python sql & ' || p_name || ' итог' END"
_SKILLS = f"array_to_string(list_filter({sql_list(SKILLS_VOCABULARY)}, lambda k: contains(lower(coalesce(descr, '')), k)), '|')"


@register(
    "page_assemble",
    f"""SELECT *, {_SKILLS} AS skills FROM (
        SELECT 'https://geekjob.ru/vacancy/' || p_partkey || '?a=1&b=2' AS url, {_DESCRIPTION} AS descr,
        CASE WHEN p_size > 25 THEN 'Senior' ELSE 'Тимлид/Руководитель группы' END AS level,
        floor(p_retailprice)::DOUBLE AS salary_min, 'RUB' AS currency, 'year' AS salary_period, {_DAY}::BIGINT AS d
        FROM part WHERE {_DAY} BETWEEN 13 AND 21)""",
)
def page_assemble(spark, sf):
    cards = pages.geekjob_cards(_listing(spark, sf, _geekjob_card()))
    out = pages.assemble_geekjob(cards, _geekjob_details(spark, sf), _now())
    return out.select(
        "url", F.col("description").alias("descr"), F.array_join("level", "|").alias("level"), F.array_join("skills", "|").alias("skills"),
        "salary_min", "currency", "salary_period", F.dayofmonth("published_at").cast("bigint").alias("d"),
    )


def _hirify_card():
    return F.concat(
        F.lit('<div class="vacancy-card wide"><div class="top"><a class="vacancy-card-link" href="vacancy/'), F.col("p_partkey").cast("string"),
        F.lit('"><h3 class="title">Junior '), F.col("p_name"), F.lit('</h3></a></div><div class="company">'), F.col("p_brand"),
        F.lit('</div><div class="date-full">'), F.col("p_size").cast("string"), F.lit(" дня назад</div>"),
        F.lit('<div class="salary"><span>'), F.floor("p_retailprice").cast("string"), F.lit("</span><span>$</span></div></div>"),
    )


def _hirify_details(spark, sf) -> DataFrame:
    url = F.concat(F.lit("https://hirify.me/vacancy/"), F.col("p_partkey").cast("string"))
    grade = F.when(F.col("p_size") % 2 == 0, '<div class="common-detail-item"><div class="label">Грейд</div><div class="value">Senior</div></div>').otherwise("")
    html = F.concat(
        F.lit('<div class="vacancy-tldr__text">Кратко: '), F.col("p_type"), F.lit('</div><div class="description"><p>Текст</p><div>'), F.col("p_name"),
        F.lit('</div><button>показать контакты</button> конец</div><div class="vacancy-common-tags">'),
        F.lit('<div class="common-detail-item"><div class="label">Страна</div><div class="value">нет</div></div>'),
        F.lit('<div class="common-detail-item"><div class="label">Страна</div><div class="value">Россия</div></div>'),
        F.lit('<div class="common-detail-item"><div class="label">Пусто</div></div>'), grade,
        F.lit('</div><div class="vacancy-detail-tags"><button class="tag">'), F.col("p_brand"), F.lit('</button><button class="tag x">SQL</button><button>no</button></div>'),
    )
    return spread(table(spark, sf, "part")).filter("p_size > 2").select(url.alias("url"), html.alias("html"))


@register(
    "page_meta_map",
    """SELECT 'https://hirify.me/vacancy/' || p_partkey AS url, 'Россия' AS country, CASE WHEN p_size % 2 = 0 THEN 'Senior' END AS grade,
        CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, p_brand || '|SQL' AS skills, 'Кратко: ' || p_type || ' Текст ' || p_name || ' конец' AS description
       FROM part WHERE p_size > 2""",
)
def page_meta_map(spark, sf):
    m = _hirify_details(spark, sf).select("url", "html", pages.detail_map("html").alias("m"))
    return m.select(
        "url", F.try_element_at("m", F.lit("Страна")).alias("country"), F.try_element_at("m", F.lit("Грейд")).alias("grade"),
        F.size("m").cast("bigint").alias("n"), F.array_join(pages.skill_buttons("html"), "|").alias("skills"),
        pages.summary_and_body("html").alias("description"),
    )


@register(
    "page_assemble_relative",
    """SELECT 'https://hirify.me/vacancy/' || p_partkey AS url, 'Junior ' || p_name AS title, p_brand AS company,
        CASE WHEN p_size > 2 THEN 'Россия' END AS location, CASE WHEN p_size > 2 AND p_size % 2 = 0 THEN 'Сеньор' ELSE 'Джуниор' END AS level,
        CASE WHEN p_size > 2 THEN p_brand || '|SQL' ELSE '' END AS skills, floor(p_retailprice) AS salary_min, 'USD' AS currency, 'month' AS salary_period,
        strftime(TIMESTAMP '2026-01-20 00:00:00' - to_days(p_size), '%Y-%m-%d') AS d
       FROM part WHERE p_size <= 7""",
)
def page_assemble_relative(spark, sf):
    cards = pages.hirify_cards(_listing(spark, sf, _hirify_card()))
    out = pages.assemble_hirify(cards, _hirify_details(spark, sf), _now())
    return out.select(
        "url", "title", "company", "location", F.array_join("level", "|").alias("level"), F.array_join("skills", "|").alias("skills"),
        "salary_min", "currency", "salary_period", F.date_format("published_at", "yyyy-MM-dd").alias("d"),
    )


# ---- offer feed ---------------------------------------------------------------------------------------------------


def _payloads(spark, sf) -> DataFrame:
    """Feed pages of fifty offers each, made of events."""
    e = F.col("event_type")
    offer = F.struct(
        F.when(e.isin("view", "click"), "vacancy").otherwise("promo").alias("offer_type"),
        (F.col("value") > 10).alias("is_active"),
        F.when(F.col("user_id") == 7, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("published_at"),
        F.concat(F.lit("Senior "), e).alias("position"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("company"),
        F.when(F.col("user_id") > 75, F.array(F.struct(F.lit("Москва").alias("label"), F.lit("remote").alias("format")))).alias("location_items"),
        F.when(e == "view", F.floor(F.col("value") * 1000)).alias("salary_display_from"),
        F.lit("от 300 000 ₽/мес на руки").alias("salary_description"),
        F.concat(F.lit("/vacancies/"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("<p>Финтех <b>"), F.col("props"), F.lit("</b></p>")).alias("offer_description"),
        F.array(F.struct(F.lit("Python").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.upper(e).alias("name"))).alias("skills_objects"),
    )
    rows = table(spark, sf, "events").select(F.expr("event_id div 50").alias("feed"), offer.alias("o"))
    body = F.to_json(F.struct(F.struct(F.count(F.lit(1)).alias("total")).alias("meta"), F.collect_list("o").alias("offers")))
    return rows.groupBy("feed").agg(body.alias("payload")).repartition(spark.sparkContext.defaultParallelism)


@register(
    "offers_flatten",
    """SELECT event_id // 50 AS feed, 'Senior ' || event_type AS title, 'u' || user_id AS company, CASE WHEN user_id > 75 THEN 'Москва' END AS location,
        CASE WHEN user_id > 75 THEN 'remote' END AS work_format, CASE WHEN event_type = 'view' THEN floor(value * 1000) ELSE 300000 END AS salary_min,
        CASE WHEN event_type = 'view' THEN NULL ELSE 'RUB' END AS currency, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published,
        'https://getmatch.ru/vacancies/' || event_id AS url, 'Финтех ' || props AS description, 'python|' || event_type AS skills, 'Сеньор' AS level
       FROM events WHERE event_type IN ('view', 'click') AND value > 10 AND user_id <> 7
         AND date_trunc('second', ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY""",
)
def offers_flatten(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    out = offers.read_offers(_payloads(spark, sf), now, days=20)
    return out.select(
        "feed", "title", "company", "location", "work_format", "salary_min", "currency",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "url", "description",
        F.array_join("skills", "|").alias("skills"), F.array_join("level", "|").alias("level"),
    )


# ---- union, sheets, files ---------------------------------------------------------------------------------------------


@register(
    "source_union",
    """SELECT source, count(*) AS n, count(url) AS n_urls, sum(length(coalesce(body, '')))::BIGINT AS chars FROM (
        SELECT 'documents' AS source, NULL AS url, text AS body FROM documents UNION ALL SELECT 'pages', url, html FROM pages
        UNION ALL SELECT 'benchmark', NULL, text FROM benchmark) GROUP BY source""",
)
def source_union(spark, sf):
    def read(name, body, *more):
        return lambda: table(spark, sf, name).select(F.lit(name).alias("source"), F.col(body).alias("body"), *more)

    df, _ = union_sources(
        {
            "documents": read("documents", "text"),
            "broken": lambda: spark.read.parquet(f"{sf}/no_such_board.parquet"),
            "pages": read("pages", "html", "url"),
            "benchmark": read("benchmark", "text"),
        }
    )
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("url").alias("n_urls"), F.sum(F.length(F.coalesce("body", F.lit("")))).cast("bigint").alias("chars")
    )


@register("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf):
    return value_counts(table(spark, sf, "documents"), "source")


@register(
    "label_sheet",
    f"""SELECT doc_id::VARCHAR AS url, source, lang AS company, {TITLE_SQL} AS title, text AS description, NULL::VARCHAR AS ds_role, NULL::VARCHAR AS comment
       FROM documents""",
)
def label_sheet(spark, sf):
    return labels.label_sheet(postings(spark, sf), labels.SHEET_COLUMNS, ["ds_role", "comment"], F.md5("url"))


@register(
    "csv_roundtrip",
    """SELECT p_partkey, p_name, '["' || replace(p_name, ' ', '","') || '"]' AS words, p_retailprice FROM part""",
)
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"), "p_retailprice")
    store.export_csv(p, path)
    return spark.read.csv(path, header=True, escape='"', schema="p_partkey long, p_name string, words string, p_retailprice double")


@register("snapshot_freeze", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def snapshot_freeze(spark, sf):
    from pyspark.errors import AnalysisException

    path = scratch_path(spark, "frozen")
    docs = table(spark, sf, "documents")
    store.freeze(docs, path)
    try:
        store.freeze(docs, path)
    except AnalysisException:
        return spark.read.parquet(path).select("doc_id", F.md5("text").alias("text_md5"))
    raise AssertionError("a frozen snapshot was overwritten")
