import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators import backfill, checks, delivery, evaluation, pairs, sampling, store, subscribers
from tamis.operators import duplicates as D
from tamis.operators.classify import classify, normalize_postings
from tamis.plans import batch
from tamis.rules import RuleSet
from tamis.schemas import COMMAND, DELIVERY, SUBSCRIBER, TARGET
from tamis.sources import labels, offers
from tamis.sources.union import union_sources
from tamis.streaming import jobs

from .test_duplicates import random_rows, table

RULES = RuleSet(
    industries={
        "it": ["яндекс", "yadro", "gigachat", "гигачат"],
        "fintech": ["fintech", "финтех", "платежные системы", "банковск", "сбер", "втб"],
        "ecommerce": ["маркетплейс", "яндекс маркет"],
    }
)


def ts(text):
    return dt.datetime.fromisoformat(text)


def lit_ts(text):
    return F.lit(text).cast("timestamp_ntz")


# ---- classification -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("row", "target", "it", "fintech"),
    [
        (("senior data scientist", "acme", "финтех, python"), True, [], ["финтех"]),
        (("data scientist", "acme", "классический офлайн-ритейл"), False, [], []),
        (("backend developer / data engineer", "acme", "финтех"), False, [], ["финтех"]),
        (("data scientist", "яндекс", "поиск и рекомендации"), True, ["яндекс"], []),
        (("data scientist", "яндекс маркет", "экосистема яндекса, маркетплейс"), True, [], []),
        (("data scientist", "yadro", "интеграция с яндекс маркет"), True, ["yadro"], []),
        (("ml engineer (gigachat tts)", "сбер", None), True, ["gigachat"], []),
        (("data scientist", "сбер", None), True, [], ["сбер"]),
        ((None, None, "финтех"), False, [], ["финтех"]),
    ],
)
def test_classify(spark, row, target, it, fintech):
    df = spark.createDataFrame([row], "title string, company string, description string")
    got = classify(df, RULES, wide=True).first()
    assert (got.is_target, got["it"], got.fintech) == (target, it, fintech)


def test_rule_table_versions(spark, tmp_path):
    lines = ["version,kind,category,cat_pos,term,term_pos", "v1,industry,it,1,b,2", "v1,industry,it,1,a,1", "v1,industry,fin,0,c,1", "v2,excluded_role,x,0,qa,0"]
    path = tmp_path / "rules.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    rules = RuleSet.read(spark, str(path), "v1")
    assert rules.industries == {"fin": ["c"], "it": ["a", "b"]} and list(rules.industries) == ["fin", "it"]
    assert RuleSet.read(spark, str(path), "v2").excluded_roles == ["qa"]


def test_normalize_types(spark):
    df = spark.createDataFrame([(" Data Scientist ", "100000", "2026-09-01"), ("x", "many", "soon")], "title string, salary_min string, published_at string")
    a, b = normalize_postings(df).collect()
    assert (a.title, a.salary_min, a.published_at) == ("data scientist", 100_000, ts("2026-09-01"))
    assert (b.salary_min, b.published_at) == (None, None)


# ---- sources ---------------------------------------------------------------------------------------


def test_offer_with_hidden_salary(spark):
    offer = {
        "offer_type": "vacancy", "is_active": True, "published_at": "2026-01-04T10:00:00", "position": "Senior Data Scientist", "company": {"name": "Acme"},
        "location_items": [{"label": "Москва", "format": "remote"}], "salary_description": "от 300 000 ₽/мес на руки", "url": "/vacancies/1",
        "offer_description": "<p>Финтех</p>", "skills_objects": [{"name": "Python"}],
    }
    shown = {**offer, "salary_display_to": 5.0, "salary_currency": "USD", "url": "/vacancies/2", "location_items": None, "skills_objects": None}
    skipped = [{**offer, "published_at": "no"}, {**offer, "is_active": False}, {**offer, "offer_type": "promo"}, {**offer, "published_at": "2025-12-01T00:00:00"}]
    feed = spark.createDataFrame([(json.dumps({"offers": [offer, shown, *skipped]}),)], "payload string")
    a, b = offers.read_offers(feed, lit_ts("2026-01-05 12:00:00")).orderBy("url").collect()
    assert (a.url, a.salary_min, a.currency, a.skills, a.description, a.level) == ("https://getmatch.ru/vacancies/1", 300_000, "RUB", ["python"], "Финтех", ["Сеньор"])
    assert (b.salary_min, b.salary_max, b.currency, b.location, b.skills) == (None, 5.0, "USD", None, [])


def test_rows_that_share_key_and_order_all_stay(spark):
    from tamis.operators.exact import first_per_key, last_per_key

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 5, "n"), (None, 6, "m")], "k string, o int, v string")
    assert sorted(r.v for r in first_per_key(rows, "k", "o").collect()) == ["n", "x", "y"]
    assert sorted(r.v for r in last_per_key(rows, "k", "o").collect()) == ["z"]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbers_go_on_over_ranges(spark, keys):
    from tamis.operators.rank import numbered

    rng = random.Random(2)
    rows = [(None if (k := rng.choice([1, 1, 1, 1, 2, None])) is None else k, i, rng.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, o int, v string").repartition(5)
    got = {(r.k, r.o): r.n for r in numbered(df, keys, [F.desc("v"), "o"], "n").collect()}
    order = sorted(rows, key=lambda r: (-ord(r[2]), r[1]))
    for k in {r[0] for r in rows}:
        mine = [r for r in order if not keys or r[0] == k]
        assert [got[r[0], r[1]] for r in mine] == list(range(1, len(mine) + 1))


def test_failing_source_is_skipped(spark, tmp_path):
    df, report = union_sources({"bad": lambda: spark.read.parquet(str(tmp_path / "none")), "good": lambda: spark.range(3)})
    assert df.count() == 3 and report["good"] == 3 and "none" in report["bad"]
    assert union_sources({"bad": lambda: spark.read.parquet(str(tmp_path / "none"))})[0] is None


def test_sources_are_read_once_and_leave_nothing_when_they_break(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    half = lambda: spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("cut off")).cast("long")).alias("id"))
    df, report = union_sources({"whole": lambda: spark.range(50).mapInArrow(counted, "id long"), "half": half, "none": lambda: spark.range(0)})
    assert df.count() == 50 and reads.value == 50
    assert report["whole"] == 50 and "cut off" in report["half"] and report["none"] == 0


def test_gold_files(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text("﻿url,ds_role,roles,industries,industry_other,unsure,comment\nu1,1,a | b,fintech,,,\nu2,0,,,,1,x\n", encoding="utf-8")
    a, b = labels.read_gold(spark, str(path)).orderBy("url").collect()
    assert (a.url, a.ds_role, a.roles, a.industries, a.unsure, a.is_target) == ("u1", True, ["a", "b"], ["fintech"], False, True)
    assert (b.ds_role, b.roles, b.unsure, b.is_target) == (False, [], True, False)
    path.write_text("url,ds_role,roles,industries,industry_other,unsure,comment\nu1,,,,,,\n", encoding="utf-8")
    with pytest.raises(checks.BadLabels):
        labels.read_gold(spark, str(path))


# ---- stores ----------------------------------------------------------------------------------------------


def test_raw_layer_keeps_first_seen(spark):
    schema = "url string, source string, title string, company string, ingest_seq long"
    old = store.fold_raw(None, store.raw_rows(spark.createDataFrame([("u1", "a", "старый", None, 0)], schema), lit_ts("2026-10-01")))
    new = spark.createDataFrame([("u1", "b", "новый", "c", 0), ("u1", "c", "последний", "d", 1), (None, "b", "без url", None, 2), ("", "b", "x", None, 3)], schema)
    rows = store.raw_rows(new, lit_ts("2026-10-02"))
    once = store.fold_raw(old, rows)
    (r,) = once.collect()
    assert (r.source, r.title, r.company, r.first_seen_at, r.last_seen_at) == ("a", "последний", "d", ts("2026-10-01"), ts("2026-10-02"))
    assert store.fold_raw(once, rows).collect() == [r]  # a replay changes nothing


def _targets(spark, urls, run):
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", F.array(F.lit("python")).alias("skills"), F.lit(250_000.9).alias("salary_min_rub"), F.lit(None).cast("double").alias("salary_max_rub"),
        F.create_map(F.lit("fintech"), F.array(F.lit("банк")), F.lit("it"), F.array().cast("array<string>")).alias("industries"), F.array(F.lit("data_scientist")).alias("matched_roles"),
    )
    return store.encode_targets(rows, run)


def test_snapshot_and_archive(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed")], "run_id long, status string")
    archive = store.fold_targets(store.fold_targets(None, _targets(spark, ["u1", "u2"], 1)), _targets(spark, ["u2"], 2))
    assert [r.url for r in store.latest_snapshot(archive, runs).collect()] == ["u2"]
    archive = store.fold_targets(archive, _targets(spark, ["u2", "old"], None))
    assert [r.url for r in store.latest_snapshot(archive, runs).collect()] == ["u2"]
    assert {r.url for r in archive.collect()} == {"u1", "u2", "old"}
    row = store.with_industry_flags(archive, ["fintech", "it"]).filter("url = 'u2'").first()
    assert (row.salary_min_rub, row.salary_max_rub, row.duplicate_urls, row.industries, row.fintech, row["it"]) == (250_000, None, [], {"fintech": ["банк"]}, True, False)
    assert archive.select(sorted(archive.columns)).schema.simpleString() == spark.createDataFrame([], TARGET).select(sorted(archive.columns)).schema.simpleString()


def _write_run(spark, root, run, rows, targets, when, full_every, ends="ok"):
    attempt = store.start_run(spark, root, run, when)
    store.write_layer(store.fold_raw(None, rows), root, "raw", attempt, when, full_every)
    store.write_layer(targets, root, "targets", attempt, when, full_every)
    if ends:
        store.end_run(spark, root, attempt, when, ends)


@pytest.mark.parametrize(("full_every", "order"), [(1, (1, 2, 3, 4, 5)), (3, (1, 3, 4, 5, 2)), (2, (5, 4, 3, 2, 1))])
def test_layers_equal_one_fold_whatever_order_runs_end_in(spark, tmp_path, full_every, order):
    root, schema = str(tmp_path / "s"), "url string, source string, title string, company string, ingest_seq long"
    batches, want, want_t = {}, None, None
    for run in range(1, 6):
        rows = spark.createDataFrame([(f"u{k}", f"s{run}", f"t{run}", None, k) for k in range(run, run + 3)], schema)
        raw = store.raw_rows(rows, lit_ts(f"2026-10-0{run}"))
        targets = _targets(spark, [f"u{run}", f"u{run + 1}"], None if run == 4 else run).withColumn("title", F.lit(f"t{run}"))
        batches[run] = (raw, targets)
        want, want_t = store.fold_raw(want, raw), store.fold_targets(want_t, targets)
    for n, run in enumerate(order):
        when = ts(f"2026-10-1{n}")
        if n == 2:  # one try fails after writing, one never ends
            bad = batches[run][0].withColumn("title", F.lit("bad"))
            _write_run(spark, root, 30, bad, batches[run][1], when, full_every, "failed")
            _write_run(spark, root, run, bad, batches[run][1], when, full_every, None)
        _write_run(spark, root, run, *batches[run], when, full_every)
        if n == 3:  # a run that is told twice
            _write_run(spark, root, run, *batches[run], when, full_every)
    assert sorted(store.read_layer(spark, root, "raw").collect()) == sorted(want.collect())
    pick = lambda df: sorted(tuple(str(v) for v in r) for r in df.select("url", "title", "last_run_id").collect())
    assert pick(store.read_layer(spark, root, "targets")) == pick(want_t)
    assert pick(store.read_run(spark, root, "targets", 2)) == pick(batches[2][1])


def test_run_log_shows_how_runs_ended(spark, tmp_path):
    root = str(tmp_path / "log")
    assert store.read_runs(spark, root).collect() == [] and store.next_run_id(store.read_runs(spark, root)) == 1
    begin = lambda run, day: store.start_run(spark, root, run, ts(f"2026-10-{day:02}"))
    store.end_run(spark, root, begin(1, 1), ts("2026-10-01 01:00:00"), "ok", (5, 4, 3))
    begin(2, 2)
    store.end_run(spark, root, begin(3, 3), ts("2026-10-03 01:00:00"), "failed")
    store.end_run(spark, root, begin(4, 4), ts("2026-10-04 01:00:00"), "failed")
    store.end_run(spark, root, begin(4, 5), ts("2026-10-05 01:00:00"), "ok", (1, 1, 0))
    begin(1, 6)  # a later try that has not ended hides nothing
    begin(5, 9)
    runs = store.audit_runs(store.read_runs(spark, root), lit_ts("2026-10-09 06:00:00"), F.expr("interval 1 day"))
    got = {r.run_id: (r.status, r.n_raw, r.n_target, r.tries) for r in runs.collect()}
    assert got == {1: ("ok", 5, 3, 2), 2: ("lost", None, None, 1), 3: ("failed", None, None, 1), 4: ("ok", 1, 0, 2), 5: ("started", None, None, 1)}
    assert store.last_ok_run(runs) == 4 and store.next_run_id(runs) == 6


def _landed(spark, rows):
    schema = "url string, source string, title string, company string, description string, salary_min double, salary_max double, skills array<string>, currency string, published_at timestamp_ntz, ingest_seq long"
    return spark.createDataFrame([(u, "fake", t, "Банк", d, 1000.0, None, ["sql"], "USD", ts("2026-10-01"), i) for i, (u, t, d) in enumerate(rows)], schema)


def test_run_publishes_snapshot_and_failed_run_does_not(spark, tmp_path):
    root = str(tmp_path / "store")
    rates = spark.createDataFrame([("USD", 90.0)], "currency string, rate double")
    landed = _landed(spark, [("https://x/1", "Data Scientist", "финтех, платежные системы"), ("https://x/2", "Повар", "финтех")])
    now = lit_ts("2026-10-02")
    batch.run_batch(spark, {"fake": lambda: landed, "down": lambda: 1 / 0}, root, 1, now, RULES, rates)
    with pytest.raises(RuntimeError):
        batch.run_batch(spark, {"down": lambda: 1 / 0}, root, 2, now, RULES, rates)
    snap = batch.snapshot(spark, root).collect()
    assert [(r.url, r.salary_min_rub, r.last_run_id) for r in snap] == [("https://x/1", 90_000, 1)]
    log = {r.run_id: (r.status, r.n_raw, r.n_deduped, r.n_target) for r in store.read_runs(spark, root).collect()}
    assert log == {1: ("ok", 2, 2, 1), 2: ("failed", None, None, None)}
    batch.run_batch(spark, {"fake": lambda: landed.filter("url = 'none'").unionByName(_landed(spark, [("https://x/3", "ml engineer", "сбер")]))}, root, 3, now, RULES, rates)
    assert [r.url for r in batch.snapshot(spark, root).collect()] == ["https://x/3"]
    assert {r.url for r in batch.archive(spark, root).collect()} == {"https://x/1", "https://x/3"}
    assert {r.url for r in batch.archive(spark, root, "raw").collect()} == {"https://x/1", "https://x/2", "https://x/3"}


def test_recurring_runs(spark, tmp_path):
    src, root = str(tmp_path / "landed"), str(tmp_path / "store")
    landed = _landed(spark, [("https://x/1", "Data Scientist", "финтех")])
    landed.write.parquet(src)
    rates = spark.createDataFrame([("USD", 90.0)], "currency string, rate double")
    stream = jobs.read_files(spark, src, landed.schema)
    for _ in range(2):  # the second start finds nothing new
        jobs.recurring_runs(stream, root, str(tmp_path / "cp"), lambda n: lit_ts("2026-10-02"), RULES, rates).awaitTermination()
    assert [(r.run_id, r.status, r.n_target) for r in store.read_runs(spark, root).collect()] == [(1, "ok", 1)]
    landed.withColumn("url", F.lit("https://x/9")).write.mode("append").parquet(src)
    jobs.recurring_runs(stream, root, str(tmp_path / "cp"), lambda n: lit_ts("2026-10-03"), RULES, rates).awaitTermination()
    assert [r.url for r in batch.snapshot(spark, root).collect()] == ["https://x/9"]


# ---- delivery ------------------------------------------------------------------------------------------------


def _postings(spark, rows):
    """rows: url, industry, role, duplicates"""
    return spark.createDataFrame(rows, "url string, industry string, role string, duplicate_urls array<string>").select(
        "url", F.col("url").alias("title"), F.lit("acme").alias("company"), F.array().cast("array<string>").alias("level"),
        F.create_map("industry", F.array("industry")).alias("industries"), F.array("role").alias("matched_roles"), "duplicate_urls",
        lit_ts("2026-10-01").alias("published_at"), F.lit(True).alias("is_target"),
    )


def test_delivery_is_personal_and_not_repeated(spark):
    posts = _postings(spark, [("a", "fintech", "data_scientist", ["a2"]), ("b", "edtech", "data_analyst", []), ("c", "fintech", "ai_engineer", None)])
    subs = spark.createDataFrame(
        [
            (1, [], [], "active", None, None, None), (2, ["fintech"], ["ai_ml_engineer"], "active", None, None, None), (3, ["nobody"], [], "active", ts("2026-10-02"), None, None),
            (4, [], [], "stopped", None, None, None), (5, ["fintech", "edtech"], ["data_scientist", "data_analyst"], "active", None, None, None),
        ],
        SUBSCRIBER,
    )
    journal = spark.createDataFrame([(1, "a2", ts("2026-10-01")), (3, "b", ts("2026-10-01")), (3, "c", ts("2026-10-02"))], DELIVERY)
    messages, rows = batch.deliver(posts, subs, journal, lit_ts("2026-10-03"))
    got = {(r.chat_id, r.url) for r in rows.collect()}
    assert got == {(1, "b"), (1, "c"), (2, "c"), (3, "a"), (3, "a2"), (3, "b"), (5, "a"), (5, "a2"), (5, "b")}
    texts = {r.chat_id: r.text for r in messages.collect()}
    assert texts[1].startswith("🆕 Новые вакансии — все сферы · все роли\n\n1. *B*") and texts[2].startswith("📅 Вакансии за последние 7 дней — Fintech · AI Engineer")
    again, more = batch.deliver(posts, subs, journal.unionByName(rows), lit_ts("2026-10-04"))
    assert more.isEmpty() and again.isEmpty()
    assert {r.chat_id for r in batch.catalogue(posts, subs).collect()} == {1, 2, 3, 5}


def test_filters(spark):
    posts = _postings(spark, [("1", "fintech", "data_scientist", []), ("2", "edtech", "data_scientist", []), ("3", "fintech", "data_analyst", []), ("4", "fintech", "data_scientist", [])])
    posts = posts.withColumn("is_target", F.col("url") != "4")
    urls = lambda *a: [r.url for r in delivery.filter_postings(posts, *a).orderBy("url").collect()]
    assert urls() == ["1", "2", "3"]
    assert urls(["fintech"], ["data_scientist"]) == ["1"]
    assert urls(["fintech", "edtech"]) == ["1", "2", "3"]
    assert urls(["unknown"]) == ["1", "2", "3"]


def test_message_size(spark):
    items = spark.range(30).select(F.lit(1).cast("long").alias("chat_id"), F.struct("id").alias("place"), F.lit("📅 начало").alias("intro"), F.repeat(F.lit("x"), 60).alias("body"))
    long_one = spark.createDataFrame([(2, "intro", "y" * 400), (2, "intro", "z")], "chat_id long, intro string, body string").withColumn("place", F.struct(F.length("body").alias("id")))
    got = delivery.pack_messages(items.unionByName(long_one.withColumn("place", F.struct(F.col("place.id").cast("long").alias("id")))), 300).collect()
    one = sorted((r.message_no, r.text) for r in got if r.chat_id == 1)
    assert len(one) > 1 and all(len(t) <= 300 for _, t in one) and one[0][1].startswith("📅")
    assert [r.text[:8] for r in sorted((r for r in got if r.chat_id == 2), key=lambda r: r.message_no)] == ["intro\n\n1", "2. yyyyy"]


def _one_entry_at_a_time(intro, bodies, limit):
    text, out = intro, []
    for k, body in enumerate(bodies, 1):
        entry = f"{k}. {body}"
        if len(text) + 2 + len(entry) > limit:
            out.append(text)
            text = entry
        else:
            text += "\n\n" + entry
    return [*out, text]


def test_a_chat_with_most_entries_is_packed_in_ranges(spark, monkeypatch):
    rng = random.Random(4)
    chats = {1: 900, 2: 1, 3: 300, **{i: 20 for i in range(4, 24)}}
    bodies = {c: ["x" * rng.choice([0, 1, 3, 8, 20, 90]) for _ in range(n)] for c, n in chats.items()}
    rows = [(c, f"{c}:" + "i" * (c % 7) * 9, b, i) for c, bs in bodies.items() for i, b in enumerate(bs)]
    items = spark.createDataFrame(rng.sample(rows, len(rows)), "chat_id long, intro string, body string, place long").repartition(3)
    for size, joined in ((18, 4), (18, 64), (64, 2), (2000, 64)):
        monkeypatch.setattr(delivery, "JOINED", joined)
        got = delivery.pack_messages(items, 80, size=size).collect()
        for c, bs in bodies.items():
            intro = f"{c}:" + "i" * (c % 7) * 9
            assert [r.text for r in sorted((r for r in got if r.chat_id == c), key=lambda r: r.message_no)] == _one_entry_at_a_time(intro, bs, 80)
            assert sorted(r.message_no for r in got if r.chat_id == c) == list(range(1, 1 + sum(r.chat_id == c for r in got)))


def test_top_skills(spark):
    archive = spark.createDataFrame(
        [("a", ["python", "sql"], {"fintech": ["банк"]}, ["data_scientist"]), ("b", ["python"], {"it": ["it"]}, ["ml_engineer"])],
        "url string, skills array<string>, industries map<string,array<string>>, matched_roles array<string>",
    ).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    top = lambda *a: [(r.skill, r.n) for r in delivery.top_skills(archive, *a).collect()]
    assert top() == [("python", 2), ("sql", 1)]
    assert top(["fintech"]) == [("python", 1), ("sql", 1)]
    assert top([], ["ml_engineer"]) == [("python", 1)]
    assert delivery.skills_message(delivery.top_skills(archive, ["edtech"])).first().message == delivery.NO_SKILLS
    assert delivery.skills_message(delivery.top_skills(archive)).first().message == "🏆 *Топ-2 навыков в вакансиях*\n1. python: 2\n2. sql: 1"


COMMANDS = [
    (1, 42, "2026-01-01 10:00:00", "toggle", "ind", "it"),  # not subscribed yet
    (2, 42, "2026-01-01 11:00:00", "start", None, None),
    (3, 42, "2026-01-01 12:00:00", "toggle", "ind", "fintech"),
    (4, 42, "2026-01-02 12:00:00", "toggle", "role", "ml"),
    (5, 42, "2026-01-02 13:00:00", "start", None, None),  # already active
    (6, 42, "2026-01-03 12:00:00", "toggle", "ind", "edtech"),
    (7, 42, "2026-01-03 13:00:00", "toggle", "ind", "fintech"),
    (8, 7, "2026-01-03 13:00:00", "start", None, None),
    (9, 7, "2026-01-03 14:00:00", "toggle", "ind", "it"),
    (10, 7, "2026-01-04 14:00:00", "stop", None, None),
    (11, 7, "2026-01-04 15:00:00", "toggle", "ind", "it"),
    (12, 7, "2026-01-05 15:00:00", "start", None, None),
    (13, 9, "2026-01-05 15:00:00", "stop", None, None),
    (14, 42, "2026-01-05 15:00:00", "reset", "role", None),
    (15, 5, "2026-01-05 15:00:00", "start", None, None),
    (16, 5, "2026-01-06 15:00:00", "stop", None, None),
]
STATES = {
    42: (["edtech"], [], "active", ts("2026-01-05 15:00:00"), ts("2026-01-01 11:00:00"), ts("2026-01-05 15:00:00")),
    7: ([], [], "active", ts("2026-01-03 14:00:00"), ts("2026-01-03 13:00:00"), ts("2026-01-05 15:00:00")),
    5: ([], [], "stopped", None, ts("2026-01-05 15:00:00"), ts("2026-01-06 15:00:00")),
}


def test_subscriber_state(spark):
    log = spark.createDataFrame([(u, c, ts(t), *r) for u, c, t, *r in COMMANDS], COMMAND)
    for width in (2, 5, 4096):
        assert {r.chat_id: tuple(r)[1:] for r in subscribers.subscriber_state(log, width).collect()} == STATES


def _one_command_at_a_time(log):
    chats = {}
    for _, chat, when, kind, name, value in sorted(log):
        s = chats.setdefault(chat, {"ind": set(), "role": set(), "status": None, "reset": None, "created": None, "updated": None})
        if kind == "start" and s["status"] != "active":
            s |= {"ind": set(), "role": set(), "status": "active", "updated": when, "created": s["created"] or when}
        elif kind == "stop" and s["status"]:
            s |= {"status": "stopped", "updated": when}
        elif kind in ("toggle", "reset") and s["status"] == "active":
            s |= {name: s[name] ^ {value} if kind == "toggle" else set(), "reset": when, "updated": when}
    return {c: (sorted(s["ind"]), sorted(s["role"]), s["status"], s["reset"], s["created"], s["updated"]) for c, s in chats.items() if s["status"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_chat_with_most_commands_is_folded_in_ranges(spark, seed):
    rng = random.Random(seed)
    log = []
    for i in range(600):
        kind = rng.choices(["toggle", "reset", "start", "stop", "confirm"], [60, 5, 6, 6, 3])[0]
        name = rng.choice(["ind", "role"]) if kind in ("toggle", "reset") else None
        log.append((i * 3 + 1, 1 if rng.random() < 0.6 else rng.randint(2, 9), ts("2026-01-01") + dt.timedelta(minutes=i), kind, name, rng.choice("abcd") if kind == "toggle" else None))
    frame = spark.createDataFrame(rng.sample(log, len(log)), COMMAND).repartition(3)
    for width in (4, 64):
        assert {r.chat_id: tuple(r)[1:] for r in subscribers.subscriber_state(frame, width).collect()} == _one_command_at_a_time(log)
    most = subscribers.segments(frame, 64).groupBy("chat_id").count().agg(F.max("count")).first()[0]
    assert most > 20  # its commands do not meet in one task


def test_subscriber_stream_over_batches(spark, tmp_path):
    log = spark.createDataFrame([(u, c, ts(t), *r) for u, c, t, *r in COMMANDS], COMMAND.replace("timestamp_ntz", "timestamp"))
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in ("update_id <= 6", "update_id between 7 and 11", "update_id > 11"):
        log.filter(part).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_files(spark, src, COMMAND.replace("timestamp_ntz", "timestamp"))
        jobs.subscriber_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.chat_id: (r.industries, r.roles, r.status, r.history_reset_at, r.created_at, r.updated_at) for r in jobs.read_subscribers(spark, out).collect()}
    assert got == STATES


# ---- evaluation ------------------------------------------------------------------------------------------------


def test_kappa(spark):
    one = lambda rows: evaluation.kappa(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b").first().kappa
    assert one([(True, True), (False, False)] * 2) == 1
    assert one([(True, True), (True, False), (False, True), (False, False)]) == 0
    assert one([(True, True), (True, True)]) is None


def test_prf_without_positives(spark):
    r = evaluation.prf(spark.createDataFrame([(False, False)], "t boolean, p boolean"), "t", "p").first()
    assert (r.precision, r.recall, r.f1, r.tn) == (None, None, None, 1)


def test_bootstrap_kinds_agree(spark):
    df = spark.range(400).select((F.col("id") % 3 == 0).alias("t"), ((F.col("id") % 3 == 0) != (F.col("id") % 10 == 0)).alias("p"))
    a = {(r.name, r.metric): (r.low, r.high) for r in evaluation.bootstrap(df, "t", ["p"]).collect()}
    b = {(r.name, r.metric): (r.low, r.high) for r in evaluation.bootstrap_cells(df, "t", ["p"]).collect()}
    assert a.keys() == b.keys() and all(abs(a[k][i] - b[k][i]) < 0.02 for k in a for i in (0, 1))
    point = evaluation.prf(df, "t", "p").first()
    assert all(a["p", m][0] < point[m] < a["p", m][1] for m in ("precision", "recall", "f1"))


def test_select_test(spark):
    schema = "url string, company string, title string, ingest_seq int"
    dev = spark.createDataFrame([("u1", "Сбер", "Data Scientist", 0)], schema)
    raw = spark.createDataFrame(
        [("u1", "Сбер", "Data Scientist", 0), ("u2", "ПАО Сбер", "Data  scientist", 1), ("u3", "Яндекс", "ML Engineer", 2), ("u4", "Yandex", "ml engineer", 3), ("u5", None, "Data Analyst", 4), ("u6", None, "Data Analyst", 5)],
        schema,
    )
    assert sorted(r.url for r in sampling.select_test(raw, dev, "ingest_seq").collect()) == ["u3", "u5", "u6"]


def test_gold_violations(spark):
    gold = spark.createDataFrame(
        [("a", True, ["x"], []), ("a", True, ["x"], ["other"]), ("b", False, [], ["i"]), ("c", True, [], []), ("d", True, ["other"], ["i"])],
        "url string, ds_role boolean, roles array<string>, industries array<string>",
    )
    got = sorted((r.url, r.problem) for r in checks.gold_violations(gold, ["x"], ["i"]).collect())
    assert got == [("a", "repeated url"), ("a", "unknown keys other"), ("b", "keys without role"), ("c", "role without roles")]


def test_control_pairs_avoid_candidates(spark):
    df, full = table(spark, random_rows(5, n=40))
    from tamis.operators.exact import first_per_key

    features, shared = D.posting_features(first_per_key(df, "url", "ingest_seq"), D.Thresholds())
    candidates = pairs.candidate_pairs(features, shared).cache()
    rows = {r.id: r.company for r in features.collect()}
    found = {(r.a, r.b) for r in candidates.collect()}
    every = {(a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and (rows[a].startswith(rows[b]) or rows[b].startswith(rows[a]))}
    assert found <= every
    assert pairs.link_weights(features).agg(F.sum("pairs")).first()[0] == len(every)
    control = [(r.a, r.b) for r in pairs.control_pairs(features, candidates, 25).collect()]
    assert len(control) == len(set(control)) == 25 and set(control) <= every - found
    # a larger sample begins with the smaller one, and one that asks for too much holds all pairs once
    more = [(r.a, r.b) for r in pairs.control_pairs(features, candidates, 10_000).collect()]
    assert more[:25] == control and len(more) == len(every - found) and set(more) == every - found
    assert pairs.control_pairs(features.limit(0), candidates, 5).isEmpty()


def test_candidates_in_short(spark):
    """Equal titles are one class however many rows hold them, and the short form tells the same pairs as the list."""
    from tamis.operators.exact import first_per_key

    copies = [dict(url=f"c{i}", source=f"s{i % 3}", title="data analyst for the harbour office") for i in range(60)]
    near = [dict(url="n1", title="data analyst harbour"), dict(url="n2", title="head cook"), dict(url="n3", title="data analyst for a harbour office in town")]
    df, _ = table(spark, copies + near + [{k: v for k, v in r.items() if k != "ingest_seq"} for r in random_rows(6, n=30)])
    features, shared = D.posting_features(first_per_key(df, "url", "ingest_seq"), D.Thresholds())
    rows = [r.asDict() for r in features.filter("company <> ''").collect()]
    text = {(r.a, r.b): r.shared for r in shared.collect()}

    def alike(x, y):
        a, b, least = set(x["words"]), set(y["words"]), min(x["n_kept"], y["n_kept"])
        titles = bool(a and b and (a <= b or b <= a)) or bool(x["head"] and x["head"] == y["head"]) or bool(a | b) and len(a & b) * 2 >= len(a | b)
        key = x["url_key"] is not None and x["url_key"] == y["url_key"]
        return titles or key or (least >= 20 and 2 * text.get((x["id"], y["id"]), 0) >= least)

    related = lambda c, d: c.startswith(d) or d.startswith(c)
    every = {(x["id"], y["id"]) for x in rows for y in rows if x["id"] < y["id"] and related(x["company"], y["company"])}
    by_id = {r["id"]: r for r in rows}
    want = {(a, b) for a, b in every if alike(by_id[a], by_id[b])}
    short = pairs.candidates(features, shared)
    listed = [(r.a, r.b) for r in short.pairs().collect()]
    assert len(listed) == len(set(listed)) and set(listed) == want
    assert short.count().first().n == len(want)
    assert short.classes.count() + short.listed.count() < len(want) / 2
    control = [(r.a, r.b) for r in pairs.control_pairs(features, short, 10_000).collect()]
    assert len(control) == len(every - want) and set(control) == every - want


def test_exploded_rows_are_not_broadcast(spark):
    titles = spark.range(20).select(F.col("id").alias("cls"), F.concat(F.lit("acme"), F.col("id") % 2).alias("company"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("word"))
    met = D.related(titles, titles, D.company_prefixes(titles), "word")
    assert met.count() == 2 * 2 * 10 * 10
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [company" in plan and "SortMergeJoin [word" not in plan


def test_catalogue_in_short(spark):
    """Chats with the same filters share one packing, and only what is asked for is handed to each of them."""
    postings = spark.createDataFrame(
        [(f"u{i}", f"t{i}", "acme", ["junior"], {"fintech": ["x"]}, ["ml"], None, True) for i in range(40)],
        "url string, title string, company string, level array<string>, industries map<string,array<string>>, matched_roles array<string>, published_at timestamp_ntz, is_target boolean",
    )
    chats = spark.createDataFrame([(c, ["fintech"], [], "active") for c in range(5)] + [(9, [], ["ml"], "active")], "chat_id long, industries array<string>, roles array<string>, status string")
    packed, readers = delivery.catalogue_parts(postings, chats, ["fintech"])
    assert packed.select("filters").distinct().count() == 2
    sizes = delivery.to_readers(packed.select("filters", "message_no", F.length("text").alias("chars")), readers)
    assert sizes.columns == ["chat_id", "message_no", "chars"]
    whole = delivery.catalogue_messages(postings, chats, ["fintech"])
    assert sorted(map(tuple, sizes.collect())) == sorted((r.chat_id, r.message_no, len(r.text)) for r in whole.collect())
    assert {r.chat_id for r in sizes.collect()} == {0, 1, 2, 3, 4, 9}


# ---- backfill -----------------------------------------------------------------------------------------------------


def test_backfill_twice_is_once(spark):
    text = lambda *p: spark.createDataFrame([(json.dumps(x),) for x in p], "payload string")
    subs = backfill.legacy_subscribers(text({"42": {"industries": ["fintech"], "roles": ["ai_ml_engineer"]}}, [8]))
    journal = backfill.legacy_journal(text({"42": {"u1": "2026-09-20T10:00:00"}, "7": {"u2": "2026-09-01T10:00:00"}}))
    rows = backfill.subscriber_rows(subs, journal, lit_ts("2026-10-01"))
    stored = backfill.insert_absent(rows, rows, ["chat_id"])
    got = {r.chat_id: (r.industries, r.roles, r.status, r.created_at) for r in stored.collect()}
    assert got == {42: (["fintech"], ["ai_engineer"], "active", ts("2026-09-20 10:00:00")), 7: ([], [], "stopped", ts("2026-09-01 10:00:00")), 8: ([], [], "active", ts("2026-10-01"))}
    key = ["chat_id", "url", "sent_at"]
    assert backfill.insert_absent(journal, journal, key).count() == 2
    assert backfill.wrong_filters(subs, stored).isEmpty()
    assert [r.ok for r in backfill.reconcile([("journal", journal, journal), ("less", journal, journal.limit(1))]).collect()] == [True, False]
    assert {r.id: r.first_seen_at for r in backfill.legacy_seen(text({"abc": "2026-09-15T08:00:00"})).collect()} == {"abc": ts("2026-09-15 08:00:00")}


def test_first_seen_keeps_vanished_ids(spark):
    schema = "id string, first_seen_at timestamp_ntz"
    known = spark.createDataFrame([("old", ts("2026-01-01"))], schema)
    new = spark.createDataFrame([("old", ts("2026-01-05")), ("new", ts("2026-01-05"))], schema)
    got = {r.id: r.first_seen_at for r in store.first_seen(known, new).collect()}
    assert got == {"old": ts("2026-01-01"), "new": ts("2026-01-05")}


def test_fan_out_keeps_rows_without_keys(spark):
    from tamis.operators.delivery import fan_out

    postings = spark.createDataFrame(
        [("u1", {"fintech": ["bank"]}, ["ds"]), ("u2", None, None), ("u3", {}, [])],
        "url string, industries map<string,array<string>>, matched_roles array<string>",
    )
    chats = spark.createDataFrame([(1, "active", None, None), (2, "active", ["fintech"], None)], "chat_id long, status string, industries array<string>, roles array<string>")
    got = sorted((r.chat_id, r.url) for r in fan_out(postings, chats, ["fintech"]).collect())
    assert got == [(1, "u1"), (1, "u2"), (1, "u3"), (2, "u1")]


def test_gold_csv_is_read_by_name(spark, tmp_path):
    from tamis.sources.labels import read_gold

    path = tmp_path / "gold.csv"
    path.write_text('\ufeffds_role,url,comment,roles,industries,unsure\n1,u1,"two\nlines, ""quoted""",a | b,,\n0,u2,,,,1\n', encoding="utf-8")
    got = {r.url: r for r in read_gold(spark, str(path)).collect()}
    assert got["u1"].ds_role is True and got["u1"].comment == 'two\nlines, "quoted"'
    assert got["u2"].ds_role is False and got["u2"].unsure is True


def test_fan_out_moves_no_pairs_of_chats_and_postings(spark):
    """Small tables make many rows: the work is spread over tasks, and blocks come out one chat after the other."""
    n, chats = 3000, 40
    postings = spark.range(n).select(
        F.col("id").cast("string").alias("url"), F.create_map(F.lit("fintech"), F.array(F.lit("x"))).alias("industries"), F.array(F.lit("ml")).alias("matched_roles")
    )
    subs = spark.range(chats).select(F.col("id").alias("chat_id"), F.lit("active").alias("status"), F.array().cast("array<string>").alias("industries"), F.array().cast("array<string>").alias("roles"))
    got = delivery.fan_out(postings, subs, ["fintech"])
    where = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in where) == n * chats and len(where) > 1
    rows = [(r.chat_id, r.url) for r in got.collect()]
    assert len(set(rows)) == n * chats
    assert sum(a[0] != b[0] for a, b in zip(rows, rows[1:])) < n * chats / 20


def _delivery_tables(spark, n=700, chats=12):
    """Postings known by two urls, two of them by a shared third one, one without any url; chats that have seen a few, all or none."""
    rows = [(str(i), ["fintech", "edtech"][i % 2], "ml", [f"x{i}"] + (["both"] if i in (4, 5) else [])) for i in range(n)] + [(None, "fintech", "ml", ["lost"])]
    posts = _postings(spark, rows)
    subs = spark.createDataFrame([(c, ["fintech"] if c % 3 == 0 else [], [], "active", None, None, None) for c in range(chats)], SUBSCRIBER)
    sent = [(c, ("x" if i % 4 else "") + str(i), ts("2026-10-01")) for c in range(1, chats) for i in range(0, n, c)] + [(7, "both", ts("2026-10-01")), (8, "lost", ts("2026-10-01"))]
    return posts, subs, spark.createDataFrame(sent, DELIVERY)


def _unseen_in_python(posts, subs, journal):
    sent = {(r.chat_id, r.url) for r in journal.collect()}
    return {
        (s.chat_id, p.url)
        for s in subs.collect() for p in posts.collect()
        if (not s.industries or set(s.industries) & set(p.industries)) and (p.url is None or not any((s.chat_id, u) in sent for u in [p.url, *p.duplicate_urls]))
    }


def _moved_rows(df):
    """Rows that the plan of ``df`` shuffles, known after it was run."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        while node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_unseen_postings_move_no_candidates(spark):
    posts, subs, journal = _delivery_tables(spark)
    new = delivery.new_postings(posts, subs, journal, ["fintech", "edtech"])
    got = [(r.chat_id, r.url) for r in new.collect()]
    assert len(got) == len(set(got)) and set(got) == _unseen_in_python(posts, subs, journal)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a history of some size
    few = _moved_rows(delivery.new_postings(posts, subs, journal, ["fintech", "edtech"]))
    many = _moved_rows(delivery.new_postings(posts, subs.unionByName(subs.withColumn("chat_id", F.col("chat_id") + 100)), journal, ["fintech", "edtech"]))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < many - few < 100 * 12  # further chats that have seen nothing take 701 or 351 postings each


def test_journal_rows_move_no_deliveries(spark):
    posts, subs, journal = _delivery_tables(spark)
    known, now = ["fintech", "edtech"], lit_ts("2026-10-03")
    rows = lambda s: delivery.journal_rows(posts, s, delivery.seen_urls(journal, s), now, known)
    urls = {p.url: [p.url, *p.duplicate_urls] for p in posts.collect() if p.url}
    want = {(c, u) for c, url in _unseen_in_python(posts, subs, journal) if url for u in urls[url]}
    got = [(r.chat_id, r.url) for r in rows(subs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (3, "both") in want and (9, "both") in want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    more = _moved_rows(rows(subs.unionByName(subs.withColumn("chat_id", F.col("chat_id") + 100)))) - _moved_rows(rows(subs))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < more < 200 * 12  # further chats are sent 1,401 or 701 urls each


def test_messages_of_a_delivery_in_ranges(spark):
    """The same as one entry at a time, also where a chat has seen whole ranges, and texts are not moved once per chat."""
    rng = random.Random(5)
    posts, subs, journal = _delivery_tables(spark, 140, 9)
    posts = posts.withColumn("title", F.expr("repeat('x', cast(coalesce(url, '0') as int) * 37 % 60)")).localCheckpoint()
    sent = [(5, str(i), ts("2026-10-01")) for i in range(rng.randrange(10), 100)] + [(6, str(i), ts("2026-10-01")) for i in range(140)]
    journal = journal.unionByName(spark.createDataFrame(sent, DELIVERY)).localCheckpoint()
    known = ["fintech", "edtech"]
    seen = delivery.seen_urls(journal, subs).localCheckpoint()
    chosen = delivery.new_postings(posts, subs, journal, known).filter("url is not null").localCheckpoint()
    items, openings = delivery.digest_items(chosen, posts, subs, seen)
    openings, bodies = {r.chat_id: r.intro for r in openings.collect()}, {}
    for r in items.orderBy("chat_id", "place").collect():
        bodies.setdefault(r.chat_id, []).append(r.body)
    for size, limit in ((16, 150), (16, 1500), (64, 300), (8192, 3500)):
        got = delivery.deliver_messages(posts, subs, seen, known, max_length=limit, size=size).collect()
        assert {r.chat_id for r in got} == set(bodies)
        for c, bs in bodies.items():
            mine = sorted((r for r in got if r.chat_id == c), key=lambda r: r.message_no)
            assert [r.text for r in mine] == _one_entry_at_a_time(openings[c], bs, limit), (size, limit, c)
            assert [r.message_no for r in mine] == list(range(1, 1 + len(mine)))
    assert _moved_rows(delivery.deliver_messages(posts, subs, seen, known)) < sum(map(len, bodies.values())) / 4


def test_catalogue_is_handed_out_without_broadcasts(spark):
    # a row per chat and share, and texts, are larger than the optimizer takes them to be
    chats = spark.range(20).select(F.col("id").alias("chat_id"), (F.col("id") % 2).cast("string").alias("filters"))
    packed = spark.range(100).select((F.col("id") % 2).cast("string").alias("filters"), F.col("id").alias("message_no"), F.lit("x").alias("text"))
    out = delivery.to_readers(packed, chats)
    assert out.count() == 1000
    posts = spark.createDataFrame([("a", "t", "c", None, None)], "url string, title string, company string, level array<string>, published_at timestamp_ntz")
    subs = spark.createDataFrame([(1, [], [])], "chat_id long, industries array<string>, roles array<string>")
    items, _ = delivery.digest_items(spark.createDataFrame([(1, "a")], "chat_id long, url string"), posts, subs, None)
    assert items.count() == 1
    for df in (out, items):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
