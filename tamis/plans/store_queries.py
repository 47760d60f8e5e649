"""Raw and curated layers, backfill and streams over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backfill, store
from ..operators.classify import classify, funnel
from ..session import scratch_path
from ..streaming import jobs
from .inputs import SAMPLE_RULES, postings, registry, table
from .text_queries import ANY_HIT, CLASSIFIED

QUERIES, ORACLES, register = registry()

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_URL = "CASE WHEN event_type = 'error' AND value < 1 THEN '' ELSE user_id || '-' || event_type END"


def _sightings(events: DataFrame) -> DataFrame:
    """Events as sightings of postings; some have no url."""
    made = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"))
    return events.select(
        F.when((F.col("event_type") == "error") & (F.col("value") < 1), "").otherwise(made).alias("url"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("source"),
        F.concat(F.col("event_type"), F.col("props")).alias("title"),
        F.when(F.col("value") > 5, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("company"),
        "value",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("seen_at"),
        F.col("event_id").alias("ingest_seq"),
    )


_RAW_SQL = f"""SELECT url, first(source ORDER BY h, event_id) AS source, last(title ORDER BY h, event_id) AS title, last(company ORDER BY h, event_id) AS company,
      last(value ORDER BY h, event_id) AS value, strftime(min(h), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(h), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM (SELECT {_URL} AS url, 's' || event_id % 4 AS source, event_type || props AS title, CASE WHEN value > 5 THEN 'u' || user_id END AS company, value,
          date_trunc('hour', ts) AS h, event_id FROM events) WHERE url <> '' GROUP BY url"""


def _show_raw(raw: DataFrame) -> DataFrame:
    fmt = "yyyy-MM-dd HH:mm:ss"
    return raw.select(
        "url", "source", "title", "company", F.get_json_object("payload", "$.value").cast("double").alias("value"),
        F.date_format("first_seen_at", fmt).alias("first_seen"), F.date_format("last_seen_at", fmt).alias("last_seen"),
    )


def _folded(spark, sf) -> DataFrame:
    """Two batches folded one after the other."""
    rows = store.raw_rows(_sightings(table(spark, sf, "events")), F.col("seen_at"), skip=("seen_at",))
    middle = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    first = store.fold_raw(None, rows.filter(F.col("first_seen_at") < middle))
    return store.fold_raw(first, rows.filter(F.col("first_seen_at") >= middle))


@register("raw_fold", _RAW_SQL)
def raw_fold(spark, sf):
    return _show_raw(_folded(spark, sf))


@register(
    "raw_window_scan",
    f"""SELECT url, title, value, first_seen FROM ({_RAW_SQL}) WHERE first_seen >= '2024-01-01 12:00:00' AND first_seen < '2024-01-03 00:00:00'""",
)
def raw_window_scan(spark, sf):
    since, until = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 12:00:00", "2024-01-03 00:00:00"))
    out = store.raw_window(_folded(spark, sf), since, until, "url string, title string, value double")
    return out.select("url", "title", "value", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@register("first_seen", "SELECT user_id AS id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM events GROUP BY user_id")
def first_seen(spark, sf):
    ids = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("first_seen_at"), "value")
    known = store.first_seen(None, ids.filter("value < 20").drop("value"))
    out = store.first_seen(known, ids.filter("value >= 20").drop("value"))
    return out.select("id", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


# ---- curated layer ------------------------------------------------------------------------------------------------


def _order_targets(spark, sf) -> list[DataFrame]:
    """Orders as three batches of targets, one url per customer: two runs and a backfill of the archive."""
    o = table(spark, sf, "orders")
    out = []
    for run, cond in ((1, "year(o_orderdate) <= 1997"), (2, "year(o_orderdate) IN (1998, 1999)"), (None, "year(o_orderdate) > 1999")):
        last = o.filter(cond).groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey").alias("r"))
        rows = last.select(
            F.col("o_custkey").cast("string").alias("url"),
            F.col("r.o_orderpriority").alias("title"),
            F.col("r.o_orderdate").alias("published_at"),
            F.col("r.o_totalprice").alias("salary_min_rub"),
            F.create_map(F.lit("fintech"), F.array(F.col("r.o_orderpriority")), F.lit("it"), F.array().cast("array<string>")).alias("industries"),
        )
        out.append(store.encode_targets(rows, run))
    return out


_BATCHES = """b AS (SELECT o_custkey, CASE WHEN year(o_orderdate) <= 1997 THEN 1 WHEN year(o_orderdate) <= 1999 THEN 2 ELSE 3 END AS age, max(o_orderkey) AS k FROM orders GROUP BY ALL),
    t AS (SELECT o_custkey AS c, max(k) FILTER (WHERE age = m) AS k, max(age) FILTER (WHERE age < 3) AS run FROM (SELECT *, max(age) OVER (PARTITION BY o_custkey) AS m FROM b) GROUP BY 1)"""


@register(
    "target_fold",
    f"""WITH {_BATCHES} SELECT c::VARCHAR AS url, o_orderpriority AS title, trunc(o_totalprice)::BIGINT AS salary_min_rub, 'fintech' AS industries, 0::BIGINT AS n_duplicates, coalesce(run, -1)::BIGINT AS last_run_id
        FROM t JOIN orders ON k = o_orderkey""",
)
def target_fold(spark, sf):
    archive = None
    for batch in _order_targets(spark, sf):
        archive = store.fold_targets(archive, batch)
    return archive.select(
        "url", "title", "salary_min_rub", F.array_join(F.map_keys("industries"), "|").alias("industries"),
        F.size("duplicate_urls").cast("bigint").alias("n_duplicates"), F.coalesce("last_run_id", F.lit(-1)).alias("last_run_id"),
    )


@register(
    "latest_snapshot",
    f"""WITH {_BATCHES} SELECT c::VARCHAR AS url, true AS fintech, false AS it FROM t WHERE run = 2""",
)
def latest_snapshot(spark, sf):
    archive = None
    for batch in _order_targets(spark, sf):
        archive = store.fold_targets(archive, batch)
    # every run is logged by what it wrote; the backfill has no run, and the newest run failed
    runs = table(spark, sf, "orders").select(
        F.when(F.year("o_orderdate") <= 1997, 1).when(F.year("o_orderdate") <= 1999, 2).otherwise(3).cast("bigint").alias("run_id")
    ).distinct().withColumn("status", F.when(F.col("run_id") == 3, "failed").otherwise("ok"))
    out = store.with_industry_flags(store.latest_snapshot(archive, runs), ["fintech", "it"])
    return store.newest_first(out).select("url", "fintech", "it")


@register(
    "run_funnel",
    f"""SELECT count(*) AS n_deduped, count(*) FILTER (WHERE len(roles) > 0 AND len(excluded) = 0) AS n_role,
        count(*) FILTER (WHERE len(roles) > 0 AND len(excluded) = 0 AND ({ANY_HIT})) AS n_target FROM ({CLASSIFIED})""",
)
def run_funnel(spark, sf):
    return funnel(classify(postings(spark, sf), SAMPLE_RULES))


@register(
    "target_encode",
    f"""SELECT url, title, concat_ws('|', {", ".join(f"CASE WHEN len(hit_{i}) > 0 THEN '{i}' END" for i in SAMPLE_RULES.industries)}) AS industries,
        array_to_string(roles, '|') AS roles, 7::BIGINT AS last_run_id FROM ({CLASSIFIED}) WHERE len(roles) > 0 AND len(excluded) = 0 AND ({ANY_HIT})""",
)
def target_encode(spark, sf):
    rows = store.encode_targets(classify(postings(spark, sf), SAMPLE_RULES).filter("is_target"), 7)
    return rows.select("url", "title", F.array_join(F.map_keys("industries"), "|").alias("industries"), F.array_join("matched_roles", "|").alias("roles"), "last_run_id")


# ---- backfill --------------------------------------------------------------------------------------------------------


def _legacy(spark, sf) -> dict[str, DataFrame]:
    """Files of an older installation: JSON maps of about a hundred events each."""
    e = table(spark, sf, "events")
    chunk = F.expr("event_id div 100").alias("chunk")
    # one entry per chat and chunk, as a JSON object holds each key once
    per_chat = e.filter("event_type <> 'signup'").groupBy(chunk, F.col("user_id").cast("string").alias("key")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("u"), F.col("event_id").cast("string")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))).alias("value")
    )
    journal = per_chat.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("payload"))
    users = e.filter("event_type = 'signup' AND value > 30").groupBy("user_id").agg(F.max("event_id").alias("k"))
    filters = F.struct(
        F.array(F.concat(F.lit("ind"), (F.col("k") % 3).cast("string")), F.lit("a")).alias("industries"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("ai_ml_engineer"), F.lit("ai_engineer"))).alias("roles"),
    )
    subs = users.groupBy(F.expr("user_id div 10").alias("chunk")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), filters)))).alias("payload")
    )
    return {"journal": journal.select("payload"), "subscribers": subs.select("payload")}


_USERS = "u AS (SELECT user_id, max(event_id) AS k FROM events WHERE event_type = 'signup' AND value > 30 GROUP BY user_id)"


@register(
    "legacy_backfill",
    f"""WITH {_USERS}, j AS (SELECT user_id, min(date_trunc('second', ts)) AS t FROM events WHERE event_type <> 'signup' GROUP BY user_id)
        SELECT coalesce(u.user_id, j.user_id) AS chat_id, CASE WHEN k IS NULL THEN '' ELSE 'a|ind' || (k % 3) END AS industries,
               CASE WHEN k % 2 = 0 THEN 'ai_engineer' ELSE '' END AS roles, CASE WHEN k IS NULL THEN 'stopped' ELSE 'active' END AS status,
               strftime(coalesce(t, TIMESTAMP '2024-02-01'), '%Y-%m-%d %H:%M:%S') AS created FROM u FULL JOIN j ON u.user_id = j.user_id""",
)
def legacy_backfill(spark, sf):
    files = _legacy(spark, sf)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = backfill.subscriber_rows(backfill.legacy_subscribers(files["subscribers"]), backfill.legacy_journal(files["journal"]), now)
    twice = backfill.insert_absent(rows, rows, ["chat_id"])
    return twice.select(
        "chat_id", F.array_join("industries", "|").alias("industries"), F.array_join("roles", "|").alias("roles"), "status",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
    )


@register(
    "first_delivery",
    """SELECT c_custkey AS chat_id, strftime(coalesce(min(o_orderdate), TIMESTAMP '2002-01-01'), '%Y-%m-%d') AS created FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def first_delivery(spark, sf):
    chats = table(spark, sf, "customer").select(F.col("c_custkey").alias("chat_id"))
    journal = table(spark, sf, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderdate").alias("sent_at"))
    out = backfill.first_delivery(chats, journal, F.lit("2002-01-01").cast("timestamp_ntz"))
    return out.select("chat_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@register(
    "legacy_targets",
    """SELECT p_partkey::VARCHAR AS url, trunc(p_retailprice)::BIGINT AS salary_min_rub, CASE WHEN p_size > 25 THEN 'fintech' ELSE '' END AS industries,
        'ai_engineer|' || p_type AS roles FROM part""",
)
def legacy_targets(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("url"), F.col("p_retailprice").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"),
        F.array(F.col("p_type"), F.lit("ai_ml_engineer")).alias("matched_roles"), (F.col("p_size") > 25).alias("fintech"), F.lit(False).alias("edtech"),
        F.col("p_partkey").alias("seq"), "p_size",
    )
    empty = store.encode_targets(p.limit(0), None)
    first = backfill.legacy_targets(p.filter("p_size <= 30"), empty, ["fintech", "edtech"], "seq")
    both = backfill.legacy_targets(p.withColumn("salary_min", F.when(F.col("p_size") <= 30, 0.0).otherwise(F.col("salary_min"))), first, ["fintech", "edtech"], "seq")
    # upper-case role names sort before the renamed one; the oracle lists the renamed one first
    roles = F.concat(F.lit("ai_engineer|"), F.array_join(F.array_remove("matched_roles", "ai_engineer"), "|"))
    return both.select("url", "salary_min_rub", F.array_join(F.map_keys("industries"), "|").alias("industries"), roles.alias("roles"))


@register(
    "reconcile_counts",
    """SELECT 'journal' AS name, count(*) AS source, count(*) AS stored, true AS ok FROM events WHERE event_type <> 'signup'
       UNION ALL SELECT 'customers', count(*), (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM orders) >= count(*) FROM customer""",
)
def reconcile_counts(spark, sf):
    e = table(spark, sf, "events").filter("event_type <> 'signup'")
    stored = backfill.legacy_journal(_legacy(spark, sf)["journal"])
    customers, buyers = table(spark, sf, "customer"), table(spark, sf, "orders").select("o_custkey").distinct()
    return backfill.reconcile([("journal", e, stored), ("customers", customers, buyers)])


@register(
    "wrong_filters",
    f"""WITH {_USERS} SELECT user_id AS chat_id FROM u WHERE k % 3 = 1""",
)
def wrong_filters(spark, sf):
    files = _legacy(spark, sf)
    source = backfill.legacy_subscribers(files["subscribers"])
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    stored = backfill.subscriber_rows(source, backfill.legacy_journal(files["journal"]), now)
    broken = stored.withColumn("industries", F.when(F.array_contains("industries", "ind1"), F.array(F.lit("a"))).otherwise(F.col("industries")))
    return backfill.wrong_filters(source, broken)


# ---- streams -------------------------------------------------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    return jobs.read_files(spark, sf, EVENTS, "events.parquet")


@register("stream_raw_fold", _RAW_SQL)
def stream_raw_fold(spark, sf):
    root = scratch_path(spark, "stream")
    jobs.fold_raw_stream(_sightings(_event_stream(spark, sf)), root, f"{root}/checkpoint", "seen_at", "ingest_seq").awaitTermination()
    return _show_raw(jobs.read_raw(spark, root))


@register("stream_first_seen", ORACLES["first_seen"])
def stream_first_seen(spark, sf):
    root = scratch_path(spark, "stream")
    ids = _event_stream(spark, sf).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("first_seen_at"))
    jobs.first_seen_stream(ids, root, f"{root}/checkpoint").awaitTermination()
    return jobs.read_first_seen(spark, root).select("id", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@register(
    "stream_late_filter",
    """SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' + to_days(user_id::INTEGER % 31) - INTERVAL 7 DAY GROUP BY event_type""",
)
def stream_late_filter(spark, sf):
    root = scratch_path(spark, "stream")
    arrived = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("user_id") % 31).cast("int"))).cast("timestamp")
    rows = _event_stream(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("ts"), arrived.alias("arrived"))
    late = jobs.recent_only(rows, "ts", "arrived", 7)
    jobs.every_batch(late, lambda b, i: store.write_version(b, root, "recent", i, replay=True), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/recent").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_rejects",
    """SELECT event_type AS kind, count(*) AS n FROM (SELECT CASE WHEN value < 5 THEN 'rejected' ELSE event_type END AS event_type FROM events) GROUP BY 1""",
)
def stream_rejects(spark, sf):
    root = scratch_path(spark, "stream")
    payload = F.when(F.col("value") < 5, F.concat(F.lit('{"kind": '), F.col("event_type"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    rows = _event_stream(spark, sf).select(payload.alias("payload"))
    keep = lambda b, i: store.write_version(b, root, "good", i, replay=True)
    jobs.route_bad_records(rows, "kind string", keep, root, f"{root}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{root}/good").select("kind")
    bad = spark.read.parquet(f"{root}/rejects").select(F.lit("rejected").alias("kind"))
    return good.unionByName(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
