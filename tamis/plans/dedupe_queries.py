"""Exact and near duplicates over the supplied documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import duplicates as D
from ..operators import pairs as P
from ..operators.exact import first_per_key, last_per_key
from ..operators.graph import components
from .inputs import TITLE_SQL, postings, registry, table
from .text_queries import SHINGLES_SQL, head_sql, words_sql

QUERIES, ORACLES, register = registry()


@register("exact_first", "SELECT arg_min(doc_id, doc_id) AS doc_id, lang, min_by(source, doc_id) AS source FROM documents GROUP BY lang, md5(text)")
def exact_first(spark, sf):
    docs = table(spark, sf, "documents").withColumn("key", F.concat("lang", F.md5("text")))
    return first_per_key(docs, "key", "doc_id").select("doc_id", "lang", "source")


@register("keep_last", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_last(spark, sf):
    return last_per_key(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("company"), K.shingle_hashes("text").alias("shingles"))


@register(
    "shingle_df",
    f"SELECT n, count(*) AS shingles FROM (SELECT s, count(*) AS n FROM (SELECT unnest(s) AS s FROM ({SHINGLES_SQL})) GROUP BY s) GROUP BY n",
)
def shingle_df(spark, sf):
    return D.shingle_frequency(_texts(spark, sf)).groupBy("n").agg(F.count(F.lit(1)).alias("shingles"))


# rows, kept shingles and shared counts, for several oracles
_KEPT = f"""g AS MATERIALIZED (SELECT doc_id AS id, lang AS company, unnest(s) AS s FROM ({SHINGLES_SQL})),
    kept AS MATERIALIZED (SELECT * FROM g WHERE s IN (SELECT s FROM g GROUP BY s HAVING count(*) <= 5)),
    n AS MATERIALIZED (SELECT id, count(*) AS n FROM kept GROUP BY id),
    sh AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM kept x JOIN kept y ON x.s = y.s AND x.id < y.id AND x.company = y.company GROUP BY ALL)"""


@register(
    "text_overlap_pairs",
    f"""WITH {_KEPT} SELECT a, b, shared, round(shared / least(x.n, y.n), 6) AS overlap FROM sh JOIN n x ON a = x.id JOIN n y ON b = y.id
        WHERE least(x.n, y.n) >= 20 AND shared / least(x.n, y.n) >= 0.5""",
)
def text_overlap_pairs(spark, sf):
    kept, shared = D.shared_shingles(_texts(spark, sf))
    out = shared.join(kept.select(F.col("id").alias("a"), F.col("n_kept").alias("na")), "a").join(
        kept.select(F.col("id").alias("b"), F.col("n_kept").alias("nb")), "b"
    )
    short = F.least("na", "nb")
    return out.filter((short >= 20) & (F.col("shared") / short >= 0.5)).select("a", "b", "shared", F.round(F.col("shared") / short, 6).alias("overlap"))


@register(
    "prefix_join",
    """WITH k AS (SELECT DISTINCT k FROM (SELECT 'brand' || substr(p_brand, 7) AS k FROM part UNION ALL
          SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') FROM part UNION ALL SELECT lower(string_split(p_name, ' ')[1]) FROM part))
       SELECT x.k AS company, y.k AS other FROM k x JOIN k y ON starts_with(x.k, y.k) OR starts_with(y.k, x.k)""",
)
def prefix_join(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(F.col("p_brand").alias("c")).union(p.select("p_name")).union(p.select(F.split("p_name", " ").getItem(0)))
    return D.company_links(names.select(K.company_key("c").alias("company"))).select("company", "other")


# ---- duplicate rule -------------------------------------------------------------------------------------------

_FEATURES = f"""{_KEPT},
    d AS MATERIALIZED (SELECT doc_id AS id, source, lang AS company, -(length(text) / 1000.0::DOUBLE) AS neg, {words_sql(TITLE_SQL)} AS words,
        {head_sql(TITLE_SQL)} AS head, coalesce(n, 0) AS n FROM documents LEFT JOIN n ON n.id = doc_id),
    f AS MATERIALIZED (SELECT *, CASE WHEN n < 20 AND len(words) > 0
        THEN first(id) OVER (PARTITION BY company, source, words, n < 20 ORDER BY neg, id) ELSE id END AS node FROM d)"""
_PAIRS = """p AS (SELECT x.id AS a, y.id AS b, x.words AS xw, y.words AS yw, x.head AS xh, y.head AS yh, x.source <> y.source AS across,
        CASE WHEN least(x.n, y.n) >= 20 THEN coalesce(shared, 0) / least(x.n, y.n) END AS ov
        FROM {rows} x JOIN {rows} y ON x.company = y.company AND x.id < y.id LEFT JOIN sh ON sh.a = x.id AND sh.b = y.id),
    q AS (SELECT *, len(xw) > 0 AND len(yw) > 0 AND (list_has_all(xw, yw) OR list_has_all(yw, xw)) AS fits, len(xw) > 0 AND xw = yw AS same,
        len(xh) > 0 AND xh = yh AS headed, len(list_intersect(xw, yw)) / greatest(len(list_distinct(list_concat(xw, yw))), 1) AS jac FROM p)"""
_RULE = """CASE WHEN across THEN CASE WHEN same THEN true WHEN ov IS NULL THEN fits ELSE ((fits OR headed) AND ov >= 0.1) OR ov >= 0.5 END
    ELSE CASE WHEN ov IS NULL THEN same ELSE fits AND ov >= 0.3 END END"""


@register(
    "duplicate_edges",
    f"""WITH {_FEATURES}, nodes AS (SELECT * FROM f WHERE id = node), {_PAIRS.format(rows="nodes")}
        SELECT a, b, round(coalesce(ov, 0), 6) AS overlap, round(jac, 6) AS jaccard FROM q WHERE {_RULE}""",
)
def duplicate_edges(spark, sf):
    features, shared = D.posting_features(postings(spark, sf), D.Thresholds())
    edges = D.duplicate_edges(features, shared)
    return edges.select("a", "b", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 6).alias("jaccard"))


@register(
    "edge_components",
    f"""WITH RECURSIVE {_KEPT}, e AS MATERIALIZED (SELECT a, b FROM sh JOIN n x ON a = x.id JOIN n y ON b = y.id
          WHERE least(x.n, y.n) >= 20 AND shared / least(x.n, y.n) >= 0.3),
        u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
        walk AS (SELECT a AS node, a AS seen FROM u UNION SELECT walk.node, u.b FROM walk JOIN u ON walk.seen = u.a)
        SELECT node, min(seen) AS component FROM walk GROUP BY node""",
)
def edge_components(spark, sf):
    kept, shared = D.shared_shingles(_texts(spark, sf))
    out = shared.join(kept.select(F.col("id").alias("a"), F.col("n_kept").alias("na")), "a").join(
        kept.select(F.col("id").alias("b"), F.col("n_kept").alias("nb")), "b"
    )
    short = F.least("na", "nb")
    return components(out.filter((short >= 20) & (F.col("shared") / short >= 0.3)).select("a", "b"))


# Complete linkage in rounds: groups that are each other's best partner merge, until none are left. A pair of
# groups counts only while all of its cross pairs are edges.
_GROUPS = f"""{_FEATURES}, nodes AS (SELECT * FROM f WHERE id = node), {_PAIRS.format(rows="nodes")},
    place AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY neg, id) AS k FROM nodes),
    e AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY coalesce(ov, 0) DESC, jac DESC, least(x.k, y.k), greatest(x.k, y.k)) AS k
        FROM q JOIN place x ON a = x.id JOIN place y ON b = y.id WHERE {_RULE}),
    m AS (SELECT 0 AS step, id AS node, id AS grp FROM nodes
        UNION ALL
        (WITH s AS (SELECT grp, count(*) AS n FROM m GROUP BY grp),
            l AS (SELECT least(x.grp, y.grp) AS ga, greatest(x.grp, y.grp) AS gb, count(*) AS c, min(k) AS best
                FROM e JOIN m x ON a = x.node JOIN m y ON b = y.node WHERE x.grp <> y.grp GROUP BY ALL),
            live AS (SELECT l.* FROM l JOIN s x ON ga = x.grp JOIN s y ON gb = y.grp WHERE c = x.n * y.n),
            top AS (SELECT g, min(best) AS best FROM (SELECT ga AS g, best FROM live UNION ALL SELECT gb, best FROM live) GROUP BY g),
            chosen AS (SELECT ga, gb FROM live JOIN top x ON ga = x.g JOIN top y ON gb = y.g WHERE live.best = x.best AND live.best = y.best)
        SELECT step + 1, node, coalesce(ga, grp) FROM m LEFT JOIN chosen ON grp = gb WHERE EXISTS (SELECT 1 FROM chosen))),
    members AS MATERIALIZED (SELECT id, neg, first(id) OVER (PARTITION BY grp ORDER BY neg, id) AS kept
        FROM f JOIN m USING (node) WHERE step = (SELECT max(step) FROM m))"""


@register("dedupe_clusters", f"WITH RECURSIVE {_GROUPS} SELECT id::VARCHAR AS url, kept::VARCHAR AS kept_url FROM members")
def dedupe_clusters(spark, sf):
    return D.duplicate_members(postings(spark, sf)).select("url", "kept_url")


@register(
    "dedupe_urls",
    f"""WITH RECURSIVE {_GROUPS} SELECT kept::VARCHAR AS url, coalesce(string_agg(id::VARCHAR, '|' ORDER BY neg, id) FILTER (WHERE id <> kept), '') AS duplicate_urls
        FROM members GROUP BY kept""",
)
def dedupe_urls(spark, sf):
    return D.deduplicate(postings(spark, sf)).select("url", F.array_join("duplicate_urls", "|").alias("duplicate_urls"))


@register("dedupe_kept", f"WITH RECURSIVE {_GROUPS} SELECT kept::VARCHAR AS kept_url, count(*) - 1 AS n_duplicates FROM members GROUP BY kept")
def dedupe_kept(spark, sf):
    members = D.duplicate_members(postings(spark, sf))
    return members.groupBy("kept_url").agg((F.count(F.lit(1)) - 1).alias("n_duplicates"))


@register(
    "cluster_pair_labels",
    f"""WITH RECURSIVE {_GROUPS} SELECT shared > 60 AS is_dup, x.kept = y.kept AS pred, count(*) AS n
        FROM sh JOIN members x ON a = x.id JOIN members y ON b = y.id GROUP BY ALL""",
)
def cluster_pair_labels(spark, sf):
    _, shared = D.shared_shingles(_texts(spark, sf))
    labelled = shared.select(F.col("a").cast("string").alias("url_a"), F.col("b").cast("string").alias("url_b"), (F.col("shared") > 60).alias("is_dup"))
    members = D.duplicate_members(postings(spark, sf))
    return D.cluster_of_pairs(labelled, members).groupBy("is_dup", "pred").agg(F.count(F.lit(1)).alias("n"))


# ---- pairs for labelling --------------------------------------------------------------------------------------------


@register(
    "pair_candidates",
    f"""WITH {_FEATURES}, {_PAIRS.format(rows="f")} SELECT a, b FROM q WHERE fits OR headed OR jac >= 0.5 OR coalesce(ov, 0) >= 0.5""",
)
def pair_candidates(spark, sf):
    features, shared = D.posting_features(postings(spark, sf), D.Thresholds())
    return P.candidate_pairs(features, shared)


@register(
    "link_weights",
    """WITH c AS (SELECT lang AS company, count(*) AS n FROM documents GROUP BY lang)
       SELECT company AS c1, company AS c2, (n * (n - 1) // 2)::BIGINT AS pairs FROM c WHERE n > 1""",
)
def link_weights(spark, sf):
    return P.link_weights(postings(spark, sf).select(K.company_key("company").alias("company"))).select("c1", "c2", "pairs")


# Numbered draws over the ordered pairs of all rows of a company: a step without a common factor visits each number once.
_CONTROL = f"""{_FEATURES}, {_PAIRS.format(rows="f")},
    cand AS MATERIALIZED (SELECT a, b FROM q WHERE fits OR headed OR jac >= 0.5 OR coalesce(ov, 0) >= 0.5),
    r AS MATERIALIZED (SELECT doc_id AS id, lang AS company, row_number() OVER (PARTITION BY lang ORDER BY left(md5(doc_id::VARCHAR), 2), doc_id) - 1 AS at FROM documents),
    z AS (SELECT company, count(*) AS n FROM r GROUP BY company HAVING count(*) > 1),
    w AS MATERIALIZED (SELECT company, n, (sum(n * (n - 1)) OVER (ORDER BY left(md5(company || '|' || company), 2), company))::BIGINT - n * (n - 1) AS start FROM z),
    t AS (SELECT sum(n * (n - 1))::BIGINT AS total FROM z),
    u AS (SELECT total, ('0x' || left(md5('42|start'), 12))::BIGINT % total AS start, ('0x' || left(md5('42|step'), 12))::BIGINT % total AS step FROM t),
    v AS (SELECT total, start, (SELECT min(step + i) FROM (SELECT unnest(range(1, 1000)) AS i) WHERE gcd(step + i, total) = 1) AS step FROM u),
    draws AS (SELECT k, ((k::HUGEINT * step + start) % total)::BIGINT AS d FROM v, (SELECT unnest(range(20000)) AS k) WHERE k < total),
    o AS (SELECT k, company, n, d - start AS o FROM draws ASOF JOIN w ON d >= start),
    ij AS (SELECT k, company, o // (n - 1) AS i, o % (n - 1) AS j FROM o),
    drawn AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, min(k) AS k FROM ij JOIN r x ON x.company = ij.company AND x.at = i
        JOIN r y ON y.company = ij.company AND y.at = CASE WHEN j >= i THEN j + 1 ELSE j END GROUP BY ALL),
    control AS (SELECT a, b FROM drawn ANTI JOIN cand USING (a, b) ORDER BY k LIMIT 100)"""


@register("control_pairs", f"WITH {_CONTROL} SELECT a, b FROM control")
def control_pairs(spark, sf):
    features, shared = D.posting_features(postings(spark, sf), D.Thresholds())
    return P.control_pairs(features, P.candidates(features, shared), 100)


@register(
    "pair_sheet",
    f"""WITH p AS (SELECT doc_id AS a, doc_id + 3 AS b FROM documents),
        v AS (SELECT doc_id, source, lang, {TITLE_SQL} AS title, md5(text) AS m FROM documents)
        SELECT a::VARCHAR AS url_a, b::VARCHAR AS url_b, x.source AS source_a, x.lang AS company, x.title AS title_a, x.m AS md5_a,
               y.source AS source_b, y.title AS title_b, y.m AS md5_b FROM p LEFT JOIN v x ON a = x.doc_id LEFT JOIN v y ON b = y.doc_id""",
)
def pair_sheet(spark, sf):
    rows = postings(spark, sf)
    pairs = rows.select(F.col("url").alias("url_a"), (F.col("ingest_seq") + 3).cast("string").alias("url_b"))
    out = P.pair_sheet(pairs, rows, "ingest_seq")
    return out.select("url_a", "url_b", "source_a", "company", "title_a", F.md5("description_a").alias("md5_a"), "source_b", "title_b", F.md5("description_b").alias("md5_b"))
