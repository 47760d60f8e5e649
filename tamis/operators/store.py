"""Raw and curated layers as folds over old rows and a new batch, and versioned Parquet tables."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, RUN_EVENT

TEXT_COLUMNS = ["url", "title", "company", "location", "work_format", "source"]
OPTIONAL_LISTS = ["specialization", "level", "skills"]
REQUIRED_LISTS = ["matched_roles", "duplicate_urls"]


# ---- raw layer --------------------------------------------------------------------------------------


def raw_rows(batch: DataFrame, seen_at: Column, order: str = "ingest_seq", skip: tuple[str, ...] = ()) -> DataFrame:
    """Postings as the source gave them; rows without a url are skipped. Keeps ``order`` as ``seq``."""
    payload = F.to_json(F.struct(*[c for c in batch.columns if c != order and c not in skip]))
    return batch.filter(F.coalesce("url", F.lit("")) != "").select(
        "url", "source", "title", "company", payload.alias("payload"),
        seen_at.alias("first_seen_at"), seen_at.alias("last_seen_at"), F.col(order).cast("bigint").alias("seq"),
    )


def fold_raw(raw: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Old raw layer and new rows as one row per url.

    First sight and source stay, last sight, title, company and payload follow the latest row. Folding
    the same rows again changes nothing, so a replayed batch is harmless. ``seq`` must not repeat for a url and a time.
    """
    new = rows.withColumn("first_seq", F.col("seq")).withColumnRenamed("seq", "last_seq")
    if raw is not None:
        old = F.lit(-1).cast("bigint")
        new = raw.withColumns({"first_seq": old, "last_seq": old}).unionByName(new)
    return _fold_raw(new).drop("first_seq", "last_seq")


def _fold_raw(both: DataFrame) -> DataFrame:
    """Fold rows that know the order of their first and of their last sight.

    What stays is picked on narrow columns; payloads move once, to meet the pick, and are never sorted.
    """
    picks = (
        both.groupBy("url")
        .agg(F.min(F.struct("first_seen_at", "first_seq", "source")).alias("f"), F.max(F.struct("last_seen_at", "last_seq")).alias("l"))
        .select("url", "f.source", "f.first_seen_at", "f.first_seq", "l.last_seen_at", "l.last_seq")
    )
    wide = both.select("url", "last_seen_at", "last_seq", "title", "company", "payload")
    return wide.join(picks.hint("shuffle_hash"), ["url", "last_seen_at", "last_seq"]).select(
        "url", "source", "title", "company", "payload", "first_seen_at", "last_seen_at", "first_seq", "last_seq"
    )


def raw_window(raw: DataFrame, since: Column, until: Column, schema: str) -> DataFrame:
    """Payload fields of postings first seen in ``[since, until)``, ordered by first sight."""
    rows = raw.filter((F.col("first_seen_at") >= since) & (F.col("first_seen_at") < until))
    out = rows.select("first_seen_at", F.from_json("payload", schema).alias("_p")).select("first_seen_at", "_p.*")
    if "published_at" in out.columns:
        out = out.withColumn("published_at", F.col("published_at").try_cast("timestamp_ntz"))
    return out.orderBy("first_seen_at", "url")


def first_seen(known: DataFrame | None, ids: DataFrame) -> DataFrame:
    """``(id, first_seen_at)``: earliest sight of every id ever met; ids that vanish stay."""
    both = ids if known is None else known.unionByName(ids)
    return both.groupBy("id").agg(F.min("first_seen_at").alias("first_seen_at"))


# ---- curated layer -----------------------------------------------------------------------------------


def encode_targets(df: DataFrame, run_id: int | None) -> DataFrame:
    """Classified postings in the stored form. ``run_id`` None marks a backfill of the archive."""

    def has(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    empty = F.array().cast("array<string>")
    return df.select(
        *[has(c, "string").alias(c) for c in TEXT_COLUMNS],
        has("published_at", "timestamp_ntz").alias("published_at"),
        *[has(c, "array<string>").alias(c) for c in OPTIONAL_LISTS],
        *[has(c, "double").try_cast("bigint").alias(c) for c in ("salary_min_rub", "salary_max_rub")],
        F.map_filter(has("industries", "map<string,array<string>>"), lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0).alias("industries"),
        *[F.coalesce(has(c, "array<string>"), empty).alias(c) for c in REQUIRED_LISTS],
        F.lit(run_id).cast("bigint").alias("last_run_id"),
    )


def fold_targets(archive: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Archive and a new batch as one row per url: new content wins, a backfill keeps the old run id."""
    both = batch.withColumns({"seq": F.lit(1).cast("bigint"), "run_seq": F.when(F.col("last_run_id").isNotNull(), F.lit(1).cast("bigint"))})
    if archive is not None:
        old = archive.withColumns({"seq": F.lit(0).cast("bigint"), "run_seq": F.when(F.col("last_run_id").isNotNull(), F.lit(0).cast("bigint"))})
        both = old.unionByName(both)
    return _fold_targets(both).drop("seq", "run_seq")


def _fold_targets(both: DataFrame) -> DataFrame:
    """Fold rows that know the order of their content (``seq``) and of their run id (``run_seq``, NULL without one)."""
    run = F.max(F.when(F.col("last_run_id").isNotNull(), F.struct("run_seq", "last_run_id")))
    picks = both.groupBy("url").agg(F.max("seq").alias("seq"), run.alias("r")).select("url", "seq", "r.run_seq", "r.last_run_id")
    return both.drop("last_run_id", "run_seq").join(picks.hint("shuffle_hash"), ["url", "seq"])


def latest_snapshot(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets of the newest successful run; failed runs do not move it."""
    newest = runs.filter("status = 'ok'").agg(F.max("run_id").alias("last_run_id"))  # one row
    return targets.join(F.broadcast(newest), "last_run_id", "left_semi")


def with_industry_flags(targets: DataFrame, keys: list[str]) -> DataFrame:
    return targets.withColumns({k: F.map_contains_key("industries", k) for k in keys}).withColumn("is_target", F.lit(True))


def newest_first(targets: DataFrame) -> DataFrame:
    return targets.orderBy(F.col("published_at").desc_nulls_last(), "url")


# ---- run log --------------------------------------------------------------------------------------------
#
# A run leaves a row when it starts and another when it ends. Its rows are never changed, so a run that dies hard is seen
# by the end that it lacks. A run may be tried again; every try has a name of its own.


def next_run_id(runs: DataFrame) -> int:
    return (runs.agg(F.max("run_id")).first()[0] or 0) + 1


def _log(spark: SparkSession, root: str, run: tuple[int, str], at: datetime, event: str, counts: tuple = (None, None, None)) -> None:
    spark.createDataFrame([(*run, at, event, *counts)], RUN_EVENT).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/runs")


def start_run(spark: SparkSession, root: str, run_id: int, at: datetime) -> tuple[int, str]:
    """Log the start of a try of a run; the returned name goes with everything that the try writes."""
    run = (run_id, uuid.uuid4().hex)
    _log(spark, root, run, at, "started")
    return run


def end_run(spark: SparkSession, root: str, run: tuple[int, str], at: datetime, status: str, counts: tuple = (None, None, None)) -> None:
    """Log the end of a try, ``ok`` or ``failed``. Readers see what it wrote from an ``ok`` on, all at once."""
    _log(spark, root, run, at, status, counts)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the run log, empty before the first run."""
    return _read_or_empty(spark, f"{root.rstrip('/')}/runs", RUN_EVENT)


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run out of the log: its best try (``ok`` before others, then the latest), and how many tries there were."""
    ended = F.col("event") != "started"
    tries = events.groupBy("run_id", "attempt").agg(
        F.min(F.when(~ended, F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.struct((F.col("event") == "ok").alias("good"), "at", F.col("event").alias("status"), "n_raw", "n_deduped", "n_target"))).alias("e"),
    )
    best = F.struct(F.coalesce("e.good", F.lit(False)).alias("good"), F.coalesce("started_at", "e.at").alias("t"), "attempt", "started_at", "e")
    return tries.groupBy("run_id").agg(F.max(best).alias("b"), F.count(F.lit(1)).alias("tries")).select(
        "run_id", "b.started_at", F.col("b.e.at").alias("finished_at"), F.coalesce("b.e.status", F.lit("started")).alias("status"),
        "b.e.n_raw", "b.e.n_deduped", "b.e.n_target", "b.attempt", "tries",
    )


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return fold_runs(read_events(spark, root))


def audit_runs(runs: DataFrame, now: Column, patience: Column) -> DataFrame:
    """Runs with ``lost`` for those that began longer than ``patience`` ago and never ended."""
    stale = (F.col("status") == "started") & (F.col("started_at") < now - patience)
    return runs.withColumn("status", F.when(stale, "lost").otherwise(F.col("status")))


# ---- versioned tables -----------------------------------------------------------------------------------


def version_path(root: str, table: str, version: int | str) -> str:
    return f"{root.rstrip('/')}/{table}/version={version}"


def write_version(df: DataFrame, root: str, table: str, version: int | str, replay: bool = False) -> None:
    """Write a table version. Readers follow the run log, so a half-written version is never seen."""
    df.write.mode("overwrite" if replay else "errorifexists").parquet(version_path(root, table, version))


# A layer (``raw`` or ``targets``) is what each run brought and, now and then, a full version besides, so a run costs what its
# batch costs and not what the archive has grown to. The manifest says of every try of a run whether it also wrote a
# full version and which runs that one holds. Readers take the newest full version of a successful try and fold it with the
# batch of every successful run that it does not hold, in whatever order the runs ended. Rows keep the runs of their first and
# last sight, so a run that comes late finds its place also among the rows of a full version.
FULL_EVERY = 42  # a week of runs four hours apart
_FOLDS = {"raw": _fold_raw, "targets": _fold_targets}
_ORDER = ("first_seq", "last_seq", "seq", "run_seq")


def _ranges(runs: list[int]) -> list[tuple[int, int]]:
    """Whole numbers as (first, last) of their gapless ranges."""
    out: list[tuple[int, int]] = []
    for r in sorted(set(runs)):
        if out and out[-1][1] == r - 1:
            out[-1] = (out[-1][0], r)
        else:
            out.append((r, r))
    return out


def _versions(spark: SparkSession, root: str, layer: str) -> tuple[Row | None, list[Row]]:
    """The newest full version, and the batches that it does not hold."""
    good = read_runs(spark, root).filter("status = 'ok'").select("run_id", "attempt")
    written = _read_or_empty(spark, f"{root.rstrip('/')}/manifest", MANIFEST).filter(F.col("layer") == layer).join(good, ["run_id", "attempt"])
    full = written.filter("full").orderBy(F.desc("at"), F.desc("run_id")).limit(1).collect()
    inside = F.lit(False)
    for r in full[0].holds if full else []:
        inside = inside | F.col("run_id").between(r.first, r.last)
    rest = written.filter(~inside).select("run_id", "attempt").distinct().orderBy("run_id").collect()
    return (full[0] if full else None), rest


def _batch_path(root: str, layer: str, run_id: int, attempt: str) -> str:
    return version_path(root, layer, f"{run_id}-{attempt}")


def _full_path(root: str, layer: str, run_id: int, attempt: str) -> str:
    return version_path(root, f"{layer}-full", f"{run_id}-{attempt}")


def _parts(spark: SparkSession, root: str, layer: str, full: Row | None, rest: list[Row]) -> DataFrame | None:
    paths = [_full_path(root, layer, full.run_id, full.attempt)] if full else []
    paths += [_batch_path(root, layer, v.run_id, v.attempt) for v in rest]
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths]) if paths else None


def read_layer(spark: SparkSession, root: str, layer: str) -> DataFrame | None:
    """State of ``raw`` or ``targets`` after all successful runs; None when there were none."""
    parts = _parts(spark, root, layer, *_versions(spark, root, layer))
    return None if parts is None else _FOLDS[layer](parts).drop(*_ORDER)


def write_layer(rows: DataFrame, root: str, layer: str, run: tuple[int, str], at: datetime, full_every: int = FULL_EVERY) -> None:
    """Add the rows of a try of a run (one per url), and the whole state when ``full_every`` batches would have to be folded."""
    spark, (run_id, attempt) = rows.sparkSession, run
    me = F.lit(run_id).cast("bigint")
    if layer == "raw":
        new = rows.drop("seq").withColumns({"first_seq": me, "last_seq": me})
    else:
        new = rows.withColumns({"seq": me, "run_seq": F.when(F.col("last_run_id").isNotNull(), me)})
    batch = _batch_path(root, layer, run_id, attempt)
    new.write.mode("overwrite").parquet(batch)
    full, rest = _versions(spark, root, layer)
    rest = [v for v in rest if v.run_id != run_id]
    held = [r for x in (full.holds if full else []) for r in range(x.first, x.last + 1)]
    whole = len(rest) + 1 >= full_every and run_id not in held
    if whole:
        old, mine = _parts(spark, root, layer, full, rest), spark.read.parquet(batch)
        _FOLDS[layer](mine if old is None else old.unionByName(mine)).write.mode("overwrite").parquet(_full_path(root, layer, run_id, attempt))
    holds = _ranges([*held, *(v.run_id for v in rest), run_id]) if whole else []
    entry = spark.createDataFrame([(layer, run_id, attempt, at, whole, holds)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")


def read_run(spark: SparkSession, root: str, layer: str, run_id: int) -> DataFrame | None:
    """What the good try of a run brought."""
    good = read_runs(spark, root).filter((F.col("status") == "ok") & (F.col("run_id") == run_id)).first()
    return None if good is None else spark.read.parquet(_batch_path(root, layer, run_id, good.attempt)).drop(*_ORDER)


def last_ok_run(runs: DataFrame) -> int | None:
    return runs.filter("status = 'ok'").agg(F.max("run_id")).first()[0]


def freeze(snapshot: DataFrame, path: str) -> None:
    """Store a snapshot that labels refer to; an existing one is never overwritten."""
    snapshot.write.mode("errorifexists").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Text copy for eyes; arrays and maps as JSON."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes
    ]
    df.select(*flat).write.csv(path, header=True, escape='"')
