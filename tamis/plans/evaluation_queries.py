"""Measuring rules: labels joined to predictions over documents, agreement, sampling, checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import repost_key
from ..operators import checks, sampling
from ..operators import evaluation as E
from ..operators.classify import classify
from ..sources import labels as L
from .inputs import SAMPLE_RULES, TITLE_SQL, postings, registry, table
from .labelling import compare_versions, score_versions, week_sheet
from .text_queries import CLASSIFIED, taxonomy_sql

QUERIES, ORACLES, register = registry()

OLD_RULES = replace(SAMPLE_RULES, roles={k: v for k, v in SAMPLE_RULES.roles.items() if k != "clerk"}, excluded_roles=["is"], version="old")
VERSIONS = {"current": SAMPLE_RULES, "old": OLD_RULES}
KEYS = list(SAMPLE_RULES.industries)


# ---- labels and predictions -----------------------------------------------------------------------------------


def _gold(spark, sf) -> DataFrame:
    """Labels as gold: quality is the role label, toxic the unsure flag, the source decides the industries."""
    source = F.col("source")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(source < "src13", "press | trade").when(source < "src17", "craft|").when(source < "src5", "bank").otherwise(None).alias("i"),
        F.concat(F.lit("writer |"), F.when(F.col("lang") == "en", "smith").otherwise("bogus")).alias("r"),
    )
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("url"),
        F.col("quality").alias("ds_role"),
        F.when(F.col("quality") == 1, F.col("r")).alias("roles"),
        F.when(F.col("quality") == 1, F.col("i")).alias("industries"),
        F.lit(None).cast("string").alias("industry_other"),
        F.when(F.col("toxic") == 1, 1).alias("unsure"),
        F.lit(None).cast("string").alias("comment"),
    )
    return L.type_gold(rows)


_GOLD = """gold AS MATERIALIZED (SELECT doc_id::VARCHAR AS url, quality = 1 AS ds_role, toxic = 1 AS unsure,
    CASE WHEN quality = 1 THEN CASE WHEN lang = 'en' THEN ['smith', 'writer'] ELSE ['bogus', 'writer'] END ELSE [] END AS roles,
    CASE WHEN quality = 1 THEN CASE WHEN source < 'src13' THEN ['press', 'trade'] WHEN source < 'src17' THEN ['craft'] WHEN source < 'src5' THEN ['bank'] ELSE [] END ELSE [] END AS industries
    FROM labels JOIN documents USING (doc_id))"""
_PRED = f"""pred AS MATERIALIZED (SELECT url, len(roles) > 0 AND len(excluded) = 0 AS role_pred,
    list_filter([{", ".join(f"CASE WHEN len(hit_{i}) > 0 THEN '{i}' END" for i in KEYS)}], lambda x: x IS NOT NULL) AS ind_pred FROM ({CLASSIFIED})),
    scored AS MATERIALIZED (SELECT *, ds_role AND len(industries) > 0 AS is_target, role_pred AND len(ind_pred) > 0 AS target_pred FROM gold JOIN pred USING (url) WHERE NOT unsure)"""
_COUNTS = """count(*) FILTER (WHERE {t} AND {p}) AS tp, count(*) FILTER (WHERE NOT {t} AND {p}) AS fp, count(*) FILTER (WHERE {t} AND NOT {p}) AS fn, count(*) FILTER (WHERE NOT {t} AND NOT {p}) AS tn"""
_RATES = "tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


def _scored(spark, sf) -> DataFrame:
    return score_versions(_gold(spark, sf), postings(spark, sf), {"current": SAMPLE_RULES})


@register("prf_report", f"WITH {_GOLD}, {_PRED} SELECT {_RATES} FROM (SELECT {_COUNTS.format(t='ds_role', p='role_pred')} FROM scored)")
def prf_report(spark, sf):
    return _rounded(E.prf(_scored(spark, sf), "ds_role", "role_pred"))


@register(
    "prf_by_slice",
    f"""WITH {_GOLD}, {_PRED}, s AS (SELECT *, len(ind_pred) > 1 AS many FROM scored)
        SELECT slice, {_RATES} FROM (SELECT CASE WHEN grouping(many) = 1 THEN 'all' WHEN many THEN 'yes' ELSE 'no' END AS slice, {_COUNTS.format(t='is_target', p='target_pred')}
        FROM s GROUP BY ROLLUP (many))""",
)
def prf_by_slice(spark, sf):
    return _rounded(E.prf_slices(_scored(spark, sf).withColumn("many", F.size("ind_pred") > 1), "is_target", "target_pred", "many"))


@register(
    "industry_metrics",
    f"""WITH {_GOLD}, {_PRED}, e AS (SELECT k AS key, list_contains(industries, k) AS t, list_contains(ind_pred, k) AS p FROM scored, (SELECT unnest({KEYS}) AS k) WHERE ds_role),
        c AS (SELECT CASE WHEN grouping(key) = 1 THEN 'micro' ELSE key END AS key, {_COUNTS.format(t='t', p='p')} FROM e GROUP BY ROLLUP (key))
        SELECT key, {_RATES} FROM c WHERE key = 'micro' OR tp + fp + fn > 0""",
)
def industry_metrics(spark, sf):
    return _rounded(E.key_metrics(_scored(spark, sf).filter("ds_role"), "industries", "ind_pred", KEYS))


@register(
    "error_buckets",
    f"""WITH {_GOLD}, {_PRED} SELECT error, count(*) AS n FROM (SELECT CASE WHEN ds_role AND NOT role_pred THEN 'fn_role' WHEN NOT ds_role AND role_pred THEN 'fp_role'
        WHEN is_target <> target_pred THEN 'industry' END AS error FROM scored) WHERE error IS NOT NULL GROUP BY error""",
)
def error_buckets(spark, sf):
    return E.value_counts(E.error_table(_scored(spark, sf), E.label_error(), "url"), "error")


_OLD = f"""old AS MATERIALIZED (SELECT doc_id::VARCHAR AS url, len({taxonomy_sql('t', OLD_RULES.roles)}) > 0 AND len({taxonomy_sql('t', {'is': ['is']})}) = 0 AS old_pred
    FROM (SELECT doc_id, {TITLE_SQL} AS t FROM documents)),
    bth AS MATERIALIZED (SELECT * FROM scored JOIN old USING (url))"""


@register(
    "version_compare",
    f"""WITH {_GOLD}, {_PRED}, {_OLD} SELECT version, {_RATES} FROM (SELECT 'current' AS version, {_COUNTS.format(t='ds_role', p='role_pred')} FROM bth
        UNION ALL SELECT 'old', {_COUNTS.format(t='ds_role', p='old_pred')} FROM bth)""",
)
def version_compare(spark, sf):
    points, _ = compare_versions(_gold(spark, sf), postings(spark, sf), VERSIONS, intervals=False)
    return _rounded(points)


@register(
    "bootstrap_ci",
    f"""WITH {_GOLD}, {_PRED}, {_OLD}, r AS (SELECT row_number() OVER (ORDER BY ds_role, role_pred, old_pred) - 1 AS k, ds_role AS t, role_pred AS current, old_pred AS old FROM bth),
        z AS (SELECT count(*) AS n FROM r),
        x AS (SELECT i // n AS rep, ('0x' || left(md5('42|' || (i // n) || '|' || (i % n)), 8))::BIGINT % n AS k FROM z, (SELECT unnest(range(1000 * (SELECT n FROM z))) AS i)),
        c AS (SELECT rep, count(*) FILTER (WHERE t) AS nt, count(*) FILTER (WHERE current) AS cp, count(*) FILTER (WHERE t AND current) AS ct,
              count(*) FILTER (WHERE old) AS op, count(*) FILTER (WHERE t AND old) AS ot FROM x JOIN r USING (k) GROUP BY rep),
        m AS (SELECT 'current' AS name, 'precision' AS metric, ct / nullif(cp, 0) AS v FROM c UNION ALL SELECT 'current', 'recall', ct / nullif(nt, 0) FROM c
          UNION ALL SELECT 'current', 'f1', 2.0::DOUBLE * ct / nullif(cp + nt, 0) FROM c UNION ALL SELECT 'old', 'precision', ot / nullif(op, 0) FROM c
          UNION ALL SELECT 'old', 'recall', ot / nullif(nt, 0) FROM c UNION ALL SELECT 'old', 'f1', 2.0::DOUBLE * ot / nullif(op + nt, 0) FROM c)
        SELECT name, metric, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM m GROUP BY ALL""",
)
def bootstrap_ci(spark, sf):
    _, intervals = compare_versions(_gold(spark, sf), postings(spark, sf), VERSIONS)
    return intervals.select("name", "metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("bootstrap_cells")
def bootstrap_cells(spark, sf):
    return E.bootstrap_cells(_scored(spark, sf), "ds_role", ["role_pred", "naive_pred"])


# ---- agreement ---------------------------------------------------------------------------------------------------


@register(
    "kappa_agreement",
    """SELECT count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement,
        round((avg((quality = toxic)::INT) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / (1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))), 6) AS kappa
       FROM labels""",
)
def kappa_agreement(spark, sf):
    out = E.kappa(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


_AGAIN = """again AS (SELECT url, CASE WHEN url::BIGINT % 5 = 0 THEN NOT ds_role ELSE ds_role END AS ds_role, unsure,
    CASE WHEN url::BIGINT % 5 = 0 AND NOT ds_role THEN ['writer'] ELSE list_filter(roles, lambda x: NOT (url::BIGINT % 7 = 0 AND x = 'smith')) END AS roles, industries FROM gold)"""


@register(
    "label_agreement",
    f"""WITH {_GOLD}, {_AGAIN}, j AS (SELECT d.ds_role AS a, r.ds_role AS b, list_sort(d.roles) = list_sort(r.roles) AS sr, list_sort(d.industries) = list_sort(r.industries) AS si
          FROM gold d JOIN again r USING (url) WHERE NOT d.unsure AND NOT r.unsure),
        k AS (SELECT count(*) AS n, avg((a = b)::INT) AS g, avg(a::INT) AS x, avg(b::INT) AS y, count(*) FILTER (WHERE a AND b) AS n_both,
              avg(sr::INT) FILTER (WHERE a AND b) AS same_roles, avg(si::INT) FILTER (WHERE a AND b) AS same_industries FROM j)
        SELECT n, round(g, 6) AS agreement, round((g - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa, n_both, round(same_roles, 6) AS same_roles,
               round(same_industries, 6) AS same_industries FROM k""",
)
def label_agreement(spark, sf):
    gold = _gold(spark, sf)
    number = F.col("url").cast("bigint")
    again = gold.select(
        "url", "unsure", "industries",
        F.when(number % 5 == 0, ~F.col("ds_role")).otherwise(F.col("ds_role")).alias("ds_role"),
        F.when((number % 5 == 0) & ~F.col("ds_role"), F.array(F.lit("writer"))).otherwise(F.filter("roles", lambda x: ~((number % 7 == 0) & (x == "smith")))).alias("roles"),
    )
    out = E.label_agreement(gold, again)
    return out.select("n", "n_both", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "same_roles", "same_industries")])


# ---- pair labels ----------------------------------------------------------------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    """Labelled pairs: every label row against a document three further on; a prediction of its own."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", F.md5("text").alias("m"))
    a = docs.select(F.col("doc_id").alias("a"), F.col("source").alias("source_a"), F.col("lang").alias("company"))
    b = docs.select((F.col("doc_id") - 3).alias("a"), F.col("source").alias("source_b"), "m")
    rows = table(spark, sf, "labels").withColumnRenamed("doc_id", "a").join(a, "a").join(b, "a")
    return rows.select(
        F.col("a").cast("string").alias("url_a"), (F.col("a") + 3).cast("string").alias("url_b"), "company", "source_a", "source_b",
        (F.col("quality") == 1).alias("is_dup"), (F.col("toxic") == 1).alias("unsure"), (F.col("m") < "8").alias("pred"),
        F.when(F.col("source_b") < "src15", "control").otherwise("candidate").alias("sample"),
    )


_PAIR_GOLD = """pg AS (SELECT l.doc_id::VARCHAR AS url_a, y.doc_id::VARCHAR AS url_b, x.lang AS company, x.source AS source_a, y.source AS source_b, quality = 1 AS is_dup, toxic = 1 AS unsure,
    md5(y.text) < '8' AS pred, CASE WHEN y.source < 'src15' THEN 'control' ELSE 'candidate' END AS sample FROM labels l JOIN documents x ON x.doc_id = l.doc_id JOIN documents y ON y.doc_id = l.doc_id + 3)"""


@register(
    "pair_slices",
    f"""WITH {_PAIR_GOLD}, s AS (SELECT *, source_a <> source_b AS across FROM pg WHERE NOT unsure AND sample = 'candidate')
        SELECT slice, {_RATES} FROM (SELECT CASE WHEN grouping(across) = 1 THEN 'all' WHEN across THEN 'yes' ELSE 'no' END AS slice, {_COUNTS.format(t='is_dup', p='pred')} FROM s GROUP BY ROLLUP (across))""",
)
def pair_slices(spark, sf):
    rows = _pairs(spark, sf).filter("not unsure and sample = 'candidate'").withColumn("across", F.col("source_a") != F.col("source_b"))
    return _rounded(E.prf_slices(rows, "is_dup", "pred", "across"))


@register(
    "control_recall",
    f"WITH {_PAIR_GOLD} SELECT count(*) AS n, count(*) FILTER (WHERE is_dup) AS n_dup, count(*) FILTER (WHERE is_dup AND NOT pred) AS missed FROM pg WHERE sample = 'control' AND NOT unsure",
)
def control_recall(spark, sf):
    return E.control_recall(_pairs(spark, sf))


@register("sample_counts", f"WITH {_PAIR_GOLD} SELECT sample, count(*) AS n, count(*) FILTER (WHERE is_dup) AS n_dup, count(*) FILTER (WHERE unsure) AS n_unsure FROM pg GROUP BY sample")
def sample_counts(spark, sf):
    return E.sample_counts(_pairs(spark, sf))


@register(
    "pair_errors",
    f"WITH {_PAIR_GOLD} SELECT CASE WHEN is_dup THEN 'fn' ELSE 'fp' END AS error, count(*) AS n FROM pg WHERE is_dup <> pred GROUP BY 1",
)
def pair_errors(spark, sf):
    return E.value_counts(E.error_table(_pairs(spark, sf), E.pair_error()), "error")


@register(
    "pair_agreement",
    f"""WITH {_PAIR_GOLD}, k AS (SELECT count(*) AS n, avg((is_dup = pred)::INT) AS g, avg(is_dup::INT) AS x, avg(pred::INT) AS y FROM pg WHERE NOT unsure)
        SELECT n, round(g, 6) AS agreement, round((g - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM k""",
)
def pair_agreement(spark, sf):
    dev = _pairs(spark, sf)
    again = dev.select("url_a", "url_b", "unsure", F.col("pred").alias("is_dup"))
    out = E.pair_agreement(dev, again)
    return out.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


# ---- checks -----------------------------------------------------------------------------------------------------------


@register(
    "gold_checks",
    f"""WITH {_GOLD} SELECT url, 'unknown keys ' || array_to_string(list_sort(list_filter(list_concat(roles, industries), lambda x: x NOT IN ('writer', 'smith', 'other', 'press', 'trade', 'bank'))), ',') AS problem
        FROM gold WHERE len(list_filter(list_concat(roles, industries), lambda x: x NOT IN ('writer', 'smith', 'other', 'press', 'trade', 'bank'))) > 0
        UNION ALL SELECT url, 'repeated url' FROM gold GROUP BY url HAVING count(*) > 1""",
)
def gold_checks(spark, sf):
    return checks.gold_violations(_gold(spark, sf), ["writer", "smith"], ["press", "trade", "bank"])


@register(
    "pair_checks",
    """SELECT least(l_partkey, l_suppkey)::VARCHAR AS low, greatest(l_partkey, l_suppkey)::VARCHAR AS high, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem
        UNION ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 40) GROUP BY ALL HAVING count(*) > 1""",
)
def pair_checks(spark, sf):
    li = table(spark, sf, "lineitem")
    both = li.select("l_partkey", "l_suppkey").union(li.filter("l_quantity > 40").select("l_suppkey", "l_partkey"))
    wide = both.select(F.col("l_partkey").alias("url_a"), F.col("l_suppkey").alias("url_b"))
    return checks.repeated_pairs(wide).select(F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "n")


@register("missing_labels", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def missing_labels(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return checks.missing_labels(rows, "quality", "doc_id")


@register("unknown_references", "SELECT DISTINCT o_custkey + 5 AS c_custkey FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)")
def unknown_references(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") + 5).alias("k"))
    return checks.unknown_references(rows, "k", table(spark, sf, "customer"), "c_custkey")


# ---- sampling ------------------------------------------------------------------------------------------------------------

_KEY_SQL = "lang || '|' || trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ')"


@register("repost_key", f"SELECT doc_id, {_KEY_SQL} AS k FROM (SELECT *, {TITLE_SQL} AS title FROM documents)")
def repost_key_query(spark, sf):
    return postings(spark, sf).select(F.col("ingest_seq").alias("doc_id"), repost_key("company", "title", "url").alias("k"))


_TEST = f"""k AS (SELECT doc_id, source, {_KEY_SQL} AS k, toxic FROM (SELECT documents.*, toxic, {TITLE_SQL} AS title FROM documents LEFT JOIN labels USING (doc_id))),
    test AS (SELECT min(doc_id) AS doc_id FROM k GROUP BY k HAVING min(doc_id) NOT IN (SELECT doc_id FROM k WHERE toxic = 1) AND count(*) FILTER (WHERE toxic = 1) = 0)"""


def _dev(spark, sf) -> DataFrame:
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ingest_seq"))
    return postings(spark, sf).join(toxic, "ingest_seq", "left_semi")


@register("select_test", f"WITH {_TEST} SELECT doc_id::VARCHAR AS url FROM test")
def select_test(spark, sf):
    return sampling.select_test(postings(spark, sf), _dev(spark, sf), "ingest_seq").select("url")


@register(
    "week_sheet",
    f"""WITH {_TEST}, g AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) AS n FROM labels WHERE toxic = 1)
        SELECT doc_id::VARCHAR AS url FROM test UNION ALL SELECT doc_id::VARCHAR FROM g WHERE n <= 10""",
)
def week_sheet_query(spark, sf):
    dev_gold = table(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("url"), (F.col("quality") == 1).alias("ds_role"), F.lit(False).alias("unsure")
    )
    _, sheet = week_sheet(postings(spark, sf), _dev(spark, sf), dev_gold, n_recheck=20)
    return sheet.select("url")


@register(
    "stratified_sample",
    "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7|' || doc_id)) AS n FROM labels) WHERE n <= 25",
)
def stratified_sample(spark, sf):
    return sampling.sample_per_class(table(spark, sf, "labels"), 25, "quality", "doc_id", 7).select("doc_id", "quality")


@register("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id) LIMIT 100")
def seeded_sample(spark, sf):
    return sampling.sample_rows(table(spark, sf, "documents"), 100, "doc_id").select("doc_id", "lang")


@register("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1 AS place FROM labels")
def seeded_shuffle(spark, sf):
    return sampling.shuffled_places(table(spark, sf, "labels").select("doc_id"), "doc_id")


# ---- imports -----------------------------------------------------------------------------------------------------------------


def _sheet(spark, sf) -> DataFrame:
    """A filled label sheet as a spreadsheet would save it."""
    return table(spark, sf, "labels").select(
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("url"), F.concat(F.col("quality").cast("string"), F.lit(".0 ")).alias("ds_role"),
        F.lit("writer ").alias("roles"), F.lit(None).cast("string").alias("industries"), F.lit("").alias("industry_other"),
        F.when(F.col("toxic") == 1, " 1").alias("unsure"), F.lit("ok").alias("comment"),
    )


@register(
    "label_import",
    """SELECT doc_id::VARCHAR AS url, quality AS ds_role, coalesce(CASE WHEN toxic = 1 THEN 1 END, 0) AS unsure, CASE WHEN lang = 'fr' THEN 'again' ELSE 'new' END AS part
       FROM labels JOIN documents USING (doc_id)""",
)
def label_import(spark, sf):
    dev = table(spark, sf, "documents").filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("url"))
    new, again = L.import_labels(_sheet(spark, sf), dev)
    both = new.withColumn("part", F.lit("new")).unionByName(again.withColumn("part", F.lit("again")))
    return both.select("url", "ds_role", F.coalesce("unsure", F.lit(0)).alias("unsure"), "part")


@register(
    "pair_import",
    f"WITH {_PAIR_GOLD} SELECT url_a, url_b, is_dup::INT AS is_dup, CASE WHEN sample = 'control' THEN 'recheck' ELSE 'candidate' END AS sample FROM pg",
)
def pair_import(spark, sf):
    rows = _pairs(spark, sf)
    empty = F.lit(None).cast("string")
    sheet = rows.select(
        "company", "source_a", "source_b", "url_a", "url_b", empty.alias("title_a"), empty.alias("title_b"),
        F.concat(F.col("is_dup").cast("int").cast("string"), F.lit(".0")).alias("is_dup"), F.when(F.col("unsure"), "1").alias("unsure"), F.lit(" ").alias("comment"),
    )
    samples = rows.select("url_a", "url_b", F.when(F.col("sample") == "control", "recheck").otherwise("candidate").alias("sample"))
    test, again = L.import_pairs(sheet, samples)
    return test.select("url_a", "url_b", "is_dup", "sample").unionByName(again.select("url_a", "url_b", "is_dup", F.lit("recheck").alias("sample")))


@register("classified_urls", f"SELECT url, array_to_string(roles, '|') AS roles FROM ({CLASSIFIED})")
def classified_urls(spark, sf):
    return classify(postings(spark, sf), SAMPLE_RULES).select("url", F.array_join("matched_roles", "|").alias("roles"))
