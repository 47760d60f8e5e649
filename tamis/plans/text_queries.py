"""Text clean-up, rules, salary and date parsing over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, keys, matching, money, text
from ..functions.base import quote
from ..functions.postings import search_text
from ..operators.classify import classify, naive_title_match, normalize_postings
from .inputs import SAMPLE_RULES as R
from .inputs import TITLE_SQL, postings, registry, table, title_of

QUERIES, ORACLES, register = registry()

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NW = r"[^\p{L}\p{N}_]"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def bordered(terms) -> str:
    """RE2 pattern for terms between word borders."""
    return f"(^|{NW})(?:" + "|".join(quote(t) for t in terms) + f")($|{NW})"


def tight_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '{WS}*/{WS}*', '/', 'g'), '{WS}*-{WS}*', '-', 'g')"


def norm_sql(c: str) -> str:
    return f"nullif(trim(lower(regexp_replace({c}, '{WS}+', ' ', 'g')), ' '), '')"


def taxonomy_sql(c: str, taxonomy: dict) -> str:
    t = tight_sql(c)
    cases = ", ".join(
        f"CASE WHEN regexp_matches({t}, '{bordered([matching._tight_py(a) for a in aliases])}') THEN '{role}' END"
        for role, aliases in taxonomy.items()
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


# ---- F01, F04, S05 --------------------------------------------------------------------------------------


@register(
    "normalize_text",
    f"""SELECT doc_id, md5(n) AS norm_md5, length(n) AS norm_len FROM (
        SELECT doc_id, {norm_sql("chr(160) || ' ' || text || chr(9) || chr(8195)")} AS n FROM documents)""",
)
def normalize_text(spark, sf):
    n = text.normalize_text(F.concat(F.lit("  "), F.col("text"), F.lit("\t ")))
    docs = table(spark, sf, "documents").select("doc_id", n.alias("n"))
    return docs.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("bigint").alias("norm_len"))


@register(
    "blank_to_null",
    f"""SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE NOT regexp_full_match(x, '{WS}*')) AS n_kept FROM (
        SELECT lang, regexp_replace(unnest(string_split(text, chr(10))), '[A-Za-z.,]+', '', 'g') AS x FROM documents) GROUP BY lang""",
)
def blank_to_null(spark, sf):
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("x"))
    stripped = lines.select("lang", F.regexp_replace("x", "[A-Za-z.,]+", "").alias("x"))
    return text.blanks_to_null(stripped).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"), F.count("x").alias("n_kept"))


@register(
    "normalize_types",
    """SELECT o_orderkey, lower(o_orderpriority) AS title, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS salary_min,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published FROM orders""",
)
def normalize_types(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "unknown").otherwise(F.col("o_totalprice").cast("string")).alias("salary_min"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
    )
    out = normalize_postings(o)
    return out.select("o_orderkey", "title", "salary_min", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


# ---- F02, F03 -----------------------------------------------------------------------------------------------


@register(
    "normalize_category",
    """SELECT location, work_format, count(*) AS n FROM (
        SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'москва' WHEN 'MACHINERY' THEN 'санкт-петербург' WHEN 'FURNITURE' THEN 'казань'
               ELSE 'город' || lower(n_name) END AS location,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'hybrid' WHEN '2-HIGH' THEN 'remote' WHEN '3-MEDIUM' THEN 'onsite'
               ELSE lower(o_orderpriority) END AS work_format
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL""",
)
def normalize_category(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segment, urgency = F.col("c_mktsegment"), F.col("o_orderpriority")
    place = (
        F.when(segment == "HOUSEHOLD", " г. Мск ")
        .when(segment == "MACHINERY", "Город  СПб,")
        .when(segment == "FURNITURE", "г.Казань")
        .otherwise(F.concat(F.lit("ГОРОД"), F.col("n_name"), F.lit(" ,")))
    )
    fmt = (
        F.when(urgency == "1-URGENT", "Гибрид: офис + удалёнка")
        .when(urgency == "2-HIGH", "Можно удалённо")
        .when(urgency == "3-MEDIUM", "в Офисе")
        .otherwise(urgency)
    )
    rows = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return (
        rows.select(text.normalize_location(place).alias("location"), text.normalize_work_format(fmt).alias("work_format"))
        .groupBy("location", "work_format")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- M01 - M07, M17, F05 --------------------------------------------------------------------------------------

_WORDS = ["tion", "the", "queaux", "sch", "ción", "ere the", "les", "und", "EAU", "ing", "heble", "a", "zzz"]


@register(
    "keyword_hits",
    f"SELECT doc_id, array_to_string(list_filter({sql_list(_WORDS)}, lambda k: contains(lower(text), lower(k))), '|') AS hits FROM documents",
)
def keyword_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(matching.find_keywords("text", _WORDS), "|").alias("hits"))


@register("role_match", f"SELECT doc_id, array_to_string({taxonomy_sql('text', R.roles)}, '|') AS roles FROM documents")
def role_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(matching.find_roles("text", R.roles), "|").alias("roles"))


@register(
    "excluded_match",
    f"SELECT doc_id, array_to_string({taxonomy_sql('text', {r: [r] for r in R.excluded_roles})}, '|') AS excluded FROM documents",
)
def excluded_match(spark, sf):
    hits = matching.find_excluded_roles("text", R.excluded_roles)
    return table(spark, sf, "documents").select("doc_id", F.array_join(hits, "|").alias("excluded"))


def _level_sql() -> str:
    t = tight_sql('text')
    lead = f"(regexp_matches(t, '{bordered(['by the'])}') OR (regexp_matches(t, '{bordered(['the'])}') AND NOT contains(t, 'tion')))"
    return f"""SELECT doc_id, nullif(concat_ws('|', CASE WHEN regexp_matches(t, '{bordered(R.levels['junior'])}') THEN 'junior' END,
        CASE WHEN regexp_matches(t, '{bordered(R.levels['senior'])}') THEN 'senior' END, CASE WHEN {lead} THEN 'lead' END), '') AS level
        FROM (SELECT doc_id, {t} AS t FROM documents)"""


@register("level_match", _level_sql())
def level_match(spark, sf):
    level = matching.guess_level("text", R.levels, unless={"the": "tion"})
    return table(spark, sf, "documents").select("doc_id", F.array_join(level, "|").alias("level"))


def scrub_sql(body: str, phrases) -> str:
    for p in phrases:
        body = f"replace({body}, '{p}', ' ')"
    return body


def industry_sql(key: str) -> str:
    """Text searched for one industry, given columns company, title and low (the lower-cased text)."""
    phrases = R.industry_excludes.get(key, [])
    if not phrases:
        return "low"
    head = " OR ".join(f"contains(lower(concat_ws(' ', company, title)), '{p}')" for p in phrases)
    return f"CASE WHEN {head} THEN '' ELSE {scrub_sql('low', phrases)} END"


@register(
    "phrase_scrub",
    f"""SELECT doc_id, md5(x) AS text_md5, length(x) AS text_len FROM (SELECT doc_id, {industry_sql("bank")} AS x FROM (
        SELECT doc_id, lang AS company, {TITLE_SQL} AS title, lower(text) AS low FROM documents))""",
)
def phrase_scrub(spark, sf):
    x = matching.industry_text(F.col("lang"), title_of(), F.col("text"), R.industry_excludes["bank"])
    docs = table(spark, sf, "documents").select("doc_id", x.alias("x"))
    return docs.select("doc_id", F.md5("x").alias("text_md5"), F.length("x").cast("bigint").alias("text_len"))


CLASSIFIED = f"""SELECT url, company, title, roles, excluded, {", ".join(f"list_filter({sql_list(w)}, lambda k: contains({industry_sql(i)}, k)) AS hit_{i}" for i, w in R.industries.items())}
    FROM (SELECT doc_id::VARCHAR AS url, lang AS company, title, lower(concat_ws(' ', title, lang, text)) AS low, {taxonomy_sql('title', R.roles)} AS roles,
          {taxonomy_sql('title', {r: [r] for r in R.excluded_roles})} AS excluded
          FROM (SELECT *, {TITLE_SQL} AS title FROM documents))"""
ANY_HIT = " OR ".join(f"len(hit_{i}) > 0" for i in R.industries)


@register(
    "classify_funnel",
    f"""SELECT company, count(*) AS n, count(*) FILTER (WHERE len(roles) > 0 AND len(excluded) = 0) AS n_role,
        count(*) FILTER (WHERE len(roles) > 0 AND len(excluded) = 0 AND ({ANY_HIT})) AS n_target FROM ({CLASSIFIED}) GROUP BY company""",
)
def classify_funnel(spark, sf):
    done = classify(postings(spark, sf), R)
    role = (F.size("matched_roles") > 0) & (F.size("excluded_roles") == 0)
    return done.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(role).alias("n_role"), F.count_if("is_target").alias("n_target")
    )


@register(
    "industry_hits",
    " UNION ALL ".join(
        f"SELECT '{i}' AS industry, count(*) FILTER (WHERE len(hit_{i}) > 0) AS n, coalesce(sum(len(hit_{i})), 0)::BIGINT AS n_words FROM classified"
        for i in R.industries
    ).join([f"WITH classified AS ({CLASSIFIED}) ", ""]),
)
def industry_hits(spark, sf):
    done = classify(postings(spark, sf), R, wide=True)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("industry"), F.size(i).alias("k")) for i in R.industries])).alias("e")
    return done.select(one).groupBy("e.industry").agg(F.count_if(F.col("e.k") > 0).alias("n"), F.sum("e.k").alias("n_words"))


@register(
    "naive_baseline",
    f"""SELECT lang, count(*) FILTER (WHERE regexp_matches(coalesce(t, ''), '{bordered(["data", "ml", "ai"])}|дата|данных')) AS n FROM (
        SELECT lang, replace({tight_sql("text")}, 'aile', 'ai ') AS t FROM documents) GROUP BY lang""",
)
def naive_baseline(spark, sf):
    t = F.replace(matching.tight("text"), F.lit("aile"), F.lit("ai "))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_if(naive_title_match(t)).alias("n"))


@register(
    "search_text",
    """SELECT p_partkey, concat_ws(' ', nullif(CASE WHEN p_size > 25 THEN p_name ELSE '' END, ''), p_brand, array_to_string(string_split(p_name, ' '), ' ')) AS t
       FROM part""",
)
def search_text_query(spark, sf):
    p = table(spark, sf, "part").withColumn("title", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(""))
    t = search_text("title", "p_brand", skills=F.split("p_name", " "))
    return p.select("p_partkey", t.alias("t"))


# ---- F06, F11, F12 ----------------------------------------------------------------------------------------------

_TEXT = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<![^>]*>', chr(1), 'g'), '(?s)</?[A-Za-z][^>]*>', chr(1), 'g'), 'zzzz', '')"
_DECODE = r"regexp_replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


@register(
    "strip_html",
    f"""SELECT page_id, md5(t) AS text_md5, length(t) AS text_len FROM (SELECT page_id,
        array_to_string(list_filter(list_transform(string_split({_TEXT}, chr(1)), lambda x: regexp_replace({_DECODE}, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), ' ') AS t
        FROM pages)""",
)
def strip_html(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("text_len"))


@register(
    "url_key",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '/([a-z]{2})/([0-9]+)', '/vacancies/\2-\1', 'g'), '(/(?:vacancies|jobs)/\d+)-[^/?#]*', '\1', 'g') AS k
       FROM pages""",
)
def url_key(spark, sf):
    made = F.regexp_replace("url", "/([a-z]{2})/([0-9]+)", "/vacancies/$2-$1")
    return table(spark, sf, "pages").select("page_id", keys.url_key(made).alias("k"))


# ---- F07, F08, F22, F23, S19, J13 ---------------------------------------------------------------------------------


@register(
    "salary_parse",
    """SELECT o_orderkey, CASE WHEN p IN ('1', '2', '4', '5') THEN CASE p WHEN '4' THEN n * 1000 WHEN '2' THEN least(n, c) ELSE n END END::DOUBLE AS salary_min,
        CASE p WHEN '2' THEN greatest(n, c) WHEN '3' THEN n END::DOUBLE AS salary_max,
        CASE p WHEN '1' THEN 'RUB' WHEN '2' THEN 'RUB' WHEN '3' THEN 'USD' WHEN '4' THEN 'GBP' ELSE 'EUR' END AS currency,
        CASE p WHEN '5' THEN 'year' WHEN '3' THEN 'hour' ELSE 'month' END AS salary_period
       FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS p,
                    CASE WHEN left(o_orderpriority, 1) = '4' THEN floor(o_totalprice / 1000)::BIGINT ELSE floor(o_totalprice)::BIGINT END AS n, o_custkey AS c FROM orders)
    """,
)
def salary_parse(spark, sf):
    n, p = F.floor("o_totalprice"), F.left("o_orderpriority", F.lit(1))
    made = (
        F.when(p == "1", F.concat(F.lit("От "), F.translate(F.format_number(n, 0), ",", " "), F.lit(" ₽ на руки")))
        .when(p == "2", F.concat(n.cast("string"), F.lit(" – "), F.col("o_custkey").cast("string"), F.lit(" Руб.")))
        .when(p == "3", F.concat(F.lit("up to "), F.format_number(n, 0), F.lit(" usd / hour")))
        .when(p == "4", F.concat(F.lit("£"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k")))
        .otherwise(F.concat(n.cast("string"), F.lit(",00 € в год")))
    )
    return table(spark, sf, "orders").select("o_orderkey", money.parse_salary(made).alias("s")).select("o_orderkey", "s.*")


@register(
    "salary_text_parse",
    """SELECT o_orderkey, CASE p WHEN '3' THEN NULL WHEN '2' THEN least(n, c) WHEN '5' THEN NULL ELSE n END::DOUBLE AS salary_min,
        CASE p WHEN '2' THEN greatest(n, c) WHEN '3' THEN n END::DOUBLE AS salary_max,
        CASE p WHEN '1' THEN 'RUB' WHEN '2' THEN 'EUR' WHEN '3' THEN 'USD' WHEN '4' THEN NULL ELSE 'GBP' END AS currency
       FROM (SELECT o_orderkey, left(o_orderpriority, 1) AS p, floor(o_totalprice)::BIGINT AS n, o_custkey AS c FROM orders)""",
)
def salary_text_parse(spark, sf):
    n, p = F.floor("o_totalprice"), F.left("o_orderpriority", F.lit(1))
    spaced = F.translate(F.format_number(n, 0), ",", " ")
    made = (
        F.when(p == "1", F.concat(F.lit("от "), spaced, F.lit(" ₽/мес на руки")))
        .when(p == "2", F.concat(spaced, F.lit(" — "), F.col("o_custkey").cast("string"), F.lit(" €/мес")))
        .when(p == "3", F.concat(F.lit("До "), n.cast("string"), F.lit("‍ $/мес")))
        .when(p == "4", spaced)
        .otherwise(F.lit("по договорённости, £"))
    )
    return table(spark, sf, "orders").select("o_orderkey", money.parse_salary_text(made).alias("s")).select("o_orderkey", "s.*")


@register(
    "salary_month_rub",
    """SELECT o_orderkey, round_even(m * r, 0) AS salary_min_rub, NULL::DOUBLE AS salary_max_rub FROM (
        SELECT o_orderkey, round_even(o_totalprice * CASE WHEN left(o_orderpriority, 1) = '1' THEN 0.08333333333333333::DOUBLE
               WHEN left(o_orderpriority, 1) = '2' THEN 168::DOUBLE ELSE 1::DOUBLE END, 0) AS m,
          CASE c_mktsegment WHEN 'BUILDING' THEN 1.0::DOUBLE WHEN 'MACHINERY' THEN (80 + r)::DOUBLE WHEN 'FURNITURE' THEN (1000 + r)::DOUBLE / 10::DOUBLE
               WHEN 'HOUSEHOLD' THEN 115::DOUBLE ELSE 1.0::DOUBLE END AS r
        FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT max(r_regionkey) AS r FROM region))""",
)
def salary_month_rub(spark, sf):
    key = F.col("r_regionkey").cast("string")
    payload = F.concat(
        F.lit('{"Valute": {"USD": {"Value": '), (F.col("r_regionkey") + 80).cast("string"),
        F.lit(', "Nominal": 1}, "EUR": {"Value": '), (F.col("r_regionkey") + 1000).cast("string"), F.lit(', "Nominal": 10}}}'),
    )
    rates = money.exchange_rates(table(spark, sf, "region").select(payload.alias("payload"), key.alias("seq")))
    codes = {"BUILDING": "RUB", "MACHINERY": "USD", "FURNITURE": "EUR", "HOUSEHOLD": "GBP"}
    segment, p = F.col("c_mktsegment"), F.left("o_orderpriority", F.lit(1))
    currency = F.lit(None).cast("string")
    for s, c in codes.items():
        currency = F.when(segment == s, c).otherwise(currency)
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("o_totalprice").alias("salary_min"),
        F.lit(None).cast("double").alias("salary_max"),
        currency.alias("currency"),
        F.when(p == "1", "year").when(p == "2", "hour").otherwise("month").alias("salary_period"),
    )
    return money.add_rub_salaries(rows, rates).select("o_orderkey", "salary_min_rub", "salary_max_rub")


# ---- F09, F10, M10 -------------------------------------------------------------------------------------------------

_MONTHS_SQL = sql_list(dates.MONTHS)


@register(
    "date_from_day_month",
    """SELECT o_orderkey, strftime(CASE WHEN a > TIMESTAMP '1998-06-15 12:00:00' + INTERVAL 1 DAY THEN b ELSE a END, '%Y-%m-%d') AS d FROM (
        SELECT o_orderkey, try_cast(printf('1998-%02d-%02d', month(o_orderdate), d) AS TIMESTAMP) AS a,
               try_cast(printf('1997-%02d-%02d', month(o_orderdate), d) AS TIMESTAMP) AS b
        FROM (SELECT *, (o_custkey % 31 + 1)::INTEGER AS d FROM orders))""",
)
def date_from_day_month(spark, sf):
    name = F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS]), F.month("o_orderdate"))
    made = F.concat((F.col("o_custkey") % 31 + 1).cast("string"), F.lit(" "), F.initcap(name), F.lit(" в 10:00"))
    now = F.lit("1998-06-15 12:00:00").cast("timestamp_ntz")
    d = dates.parse_day_month(made, now)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("d"))


@register(
    "relative_date",
    """SELECT event_id, strftime(TIMESTAMP '2024-02-01 12:00:00' - CASE event_type WHEN 'click' THEN to_minutes(n) WHEN 'view' THEN to_hours(n)
        WHEN 'purchase' THEN to_days(n * 7) WHEN 'signup' THEN to_days(1) END, '%Y-%m-%d %H:%M:%S') AS d
       FROM (SELECT event_id, event_type, floor(value)::INTEGER AS n FROM events)""",
)
def relative_date(spark, sf):
    n, e = F.floor("value").cast("string"), F.col("event_type")
    made = (
        F.when(e == "click", F.concat(n, F.lit(" минут назад")))
        .when(e == "view", F.concat(n, F.lit(" часа назад")))
        .when(e == "purchase", F.concat(n, F.lit(" недель назад")))
        .when(e == "signup", " Вчера ")
        .otherwise("давно")
    )
    d = dates.parse_relative(made, F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("d"))


@register(
    "recency_filter",
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY event_type",
)
def recency_filter(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").filter(dates.is_recent("ts", now, 7)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- F13 - F20 --------------------------------------------------------------------------------------------------------


@register(
    "company_key",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '' WHEN 'MACHINERY' THEN '' WHEN 'FURNITURE' THEN 'yandexschukazhizn' || n
        WHEN 'BUILDING' THEN 'ndata' || n ELSE 'axioma' || lower(replace(c_name, '#', '')) END AS k
       FROM (SELECT *, c_nationkey::VARCHAR AS n FROM customer)""",
)
def company_key(spark, sf):
    s, n = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    made = (
        F.when(s == "HOUSEHOLD", " N.D.A. ")
        .when(s == "MACHINERY", F.concat(F.lit("Компания скрыта ("), F.col("c_name"), F.lit(")")))
        .when(s == "FURNITURE", F.concat(F.lit("ООО «Яндекс-Щука_Жизнь» "), n))
        .when(s == "BUILDING", F.concat(F.lit("nData "), n, F.lit(", LLC")))
        .otherwise(F.concat(F.lit("ПАО \"Аксиома\" "), F.col("c_name"), F.lit(" Inc.")))
    )
    return table(spark, sf, "customer").select("c_custkey", keys.company_key(made).alias("k"))


def words_sql(t: str) -> str:
    syn = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in keys.TITLE_SYNONYMS.items()) + " ELSE w END"
    found = f"regexp_extract_all(replace(lower({t}), 'ё', 'е'), '[a-zа-я0-9+#]+')"
    return f"list_sort(list_distinct(list_filter(list_transform({found}, lambda w: {syn}), lambda w: NOT list_contains({sql_list(keys.TITLE_STOP_WORDS)}, w))))"


_MADE_TITLE = "CASE WHEN p_size > 25 THEN 'Старший ' ELSE 'Sr ' END || p_name || CASE WHEN p_size > 40 THEN ' (ИИ, ' || p_type || ')' WHEN p_size > 20 THEN ' в команду ' || p_brand ELSE ' – ещё C++' END"


def _made_title():
    size = F.col("p_size")
    tail = (
        F.when(size > 40, F.concat(F.lit(" (ИИ, "), F.col("p_type"), F.lit(")")))
        .when(size > 20, F.concat(F.lit(" в команду "), F.col("p_brand")))
        .otherwise(" – ещё C++")
    )
    return F.concat(F.when(size > 25, "Старший ").otherwise("Sr "), F.col("p_name"), tail)


@register("title_words", f"SELECT p_partkey, array_to_string({words_sql(_MADE_TITLE)}, '|') AS words FROM part")
def title_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys.title_words(_made_title()), "|").alias("words"))


def head_sql(t: str) -> str:
    return words_sql(f"regexp_split_to_array({t}, '{WS}*[(,]|{WS}+(?:в|для|на){WS}+|{WS}+[-–—/|]{WS}+')[1]")


@register("title_head", f"SELECT p_partkey, array_to_string({head_sql(_MADE_TITLE)}, '|') AS head FROM part")
def title_head(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys.title_head(_made_title()), "|").alias("head"))


SHINGLES_SQL = """SELECT doc_id, lang, source, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    ELSE [] END AS s FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)"""


@register("shingles", f"SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS s_md5 FROM ({SHINGLES_SQL})")
def shingles(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", keys.shingles("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("s_md5"))


@register(
    "completeness_score",
    """SELECT p_partkey, (CASE WHEN p_size > 25 THEN 1 ELSE 0 END + 1) + length(p_name) / 1000.0::DOUBLE + len(string_split(p_name, ' ')) AS score FROM part""",
)
def completeness_score(spark, sf):
    low = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    score = keys.completeness(low, F.col("p_retailprice"), F.col("p_name"), F.split("p_name", " "))
    return table(spark, sf, "part").select("p_partkey", score.alias("score"))


@register(
    "split_keys",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(replace(p_name, 'e', ' | ') || '|' || p_brand, '|'), lambda x: trim(x)), lambda x: x <> ''))), ',') AS k FROM part""",
)
def split_keys(spark, sf):
    made = F.concat(F.replace(F.col("p_name"), F.lit("e"), F.lit(" | ")), F.lit("|"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys.split_keys(made), ",").alias("k"))


@register(
    "list_cells",
    "SELECT p_partkey, array_to_string(string_split(p_name, ' '), ',') AS cells FROM part",
)
def list_cells(spark, sf):
    made = F.concat(F.lit("['"), F.array_join(F.split("p_name", " "), "', '"), F.lit("']"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(keys.parse_list_cell(made), ",").alias("cells"))


@register(
    "rename_keys",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN 'crimson' WHEN 'bolt' THEN 'screw' ELSE x END))), ',') AS k FROM part""",
)
def rename_keys(spark, sf):
    renamed = keys.rename_keys(F.split("p_name", " "), {"red": "crimson", "bolt": "screw"})
    return table(spark, sf, "part").select("p_partkey", F.array_join(renamed, ",").alias("k"))
