"""The recurring parts as Structured Streaming jobs over landed files."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store, subscribers
from ..plans.batch import run_batch
from ..rules import RuleSet


def read_files(spark: SparkSession, folder: str, schema: str | StructType, name_filter: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream of landed Parquet files. The checkpoint remembers which files were taken."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def every_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run ``work`` on everything that has arrived, batch by batch, then stop (a scheduled run)."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_raw_stream(stream: DataFrame, root: str, checkpoint: str, seen_at: str, order: str) -> StreamingQuery:
    """Keep the raw layer: each batch is a run that adds its rows, folded to one per url (see :func:`store.write_layer`).

    A replayed batch is another try of the same run and replaces what the first one wrote.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, datetime.now(timezone.utc).replace(tzinfo=None)
        run = store.start_run(spark, root, batch_id + 1, now)
        rows = store.raw_rows(batch, F.col(seen_at), order, skip=(seen_at,))
        store.write_layer(store.fold_raw(None, rows), root, "raw", run, now)
        store.end_run(spark, root, run, now, "ok")

    return every_batch(stream, work, checkpoint)


def read_raw(spark: SparkSession, root: str) -> DataFrame | None:
    """The raw layer as the batches of :func:`fold_raw_stream` have left it."""
    return store.read_layer(spark, root, "raw")


def first_seen_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Earliest sight of every ``id``; each batch appends the ids whose date changed (see :func:`read_first_seen`)."""
    seen = stream.groupBy("id").agg(F.min("first_seen_at").alias("first_seen_at"))

    def work(batch: DataFrame, batch_id: int) -> None:
        store.write_version(batch, out, "first_seen", batch_id, replay=True)

    return every_batch(seen, work, checkpoint, mode="update")


def read_first_seen(spark: SparkSession, out: str) -> DataFrame:
    return store.first_seen(None, spark.read.parquet(f"{out}/first_seen").select("id", "first_seen_at"))


def recent_only(stream: DataFrame, published: str, arrived: str, days: int = 7) -> DataFrame:
    """Drop postings published more than ``days`` before they arrived; the watermark bounds later state."""
    limit = F.col(arrived) - F.make_dt_interval(F.lit(days))
    return stream.withWatermark(published, f"{days} days").filter(F.col(published) >= limit)


def route_bad_records(stream: DataFrame, schema: str, good: Callable[[DataFrame, int], None], rejects: str, checkpoint: str) -> StreamingQuery:
    """Parse JSON ``payload`` rows; what cannot be read goes to ``rejects`` and does not stop the rest."""

    def work(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.withColumn("r", F.from_json("payload", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
        bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
        store.write_version(parsed.filter(bad).drop("r"), rejects, "rejects", batch_id, replay=True)
        good(parsed.filter(~bad).select("r.*").drop("_bad"), batch_id)

    return every_batch(stream, work, checkpoint)


def recurring_runs(stream: DataFrame, root: str, checkpoint: str, now: Callable[[int], Column], rules: RuleSet, rates: DataFrame) -> StreamingQuery:
    """A collection run per batch of landed postings; the batch number gives the run id.

    A run that fails is logged and stops the query; started again, it takes up the same batch.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        run_batch(batch.sparkSession, {"landed": lambda: batch}, root, batch_id + 1, now(batch_id), rules, rates)

    return every_batch(stream, work, checkpoint)


# ---- subscribers ------------------------------------------------------------------------------------------

def subscriber_stream(commands: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep what each batch of commands does to each chat as one segment (see :mod:`operators.subscribers`).

    Nothing is held between batches, and a chat with most of a batch is folded in ranges of it. A replayed batch
    writes its segments again.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        whole = subscribers.composed(subscribers.segments(batch))
        store.write_version(whole.withColumn("part", F.lit(batch_id).cast("bigint")), out, "segments", batch_id, replay=True)

    return every_batch(commands, work, checkpoint)


def read_subscribers(spark: SparkSession, out: str) -> DataFrame:
    """State of every chat after all batches."""
    return subscribers.states(subscribers.composed(spark.read.parquet(f"{out}/segments").select("chat_id", "part", "segment")))
