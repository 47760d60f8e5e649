"""One-off import of the files an older installation left behind. Running it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rename_keys
from ..rules.fixed import ROLE_RENAMES
from .exact import last_per_key
from .store import encode_targets, fold_targets


def legacy_subscribers(files: DataFrame) -> DataFrame:
    """``(chat_id, industries, roles)`` from JSON texts ``payload``: a map with filters, or a plain list."""
    none = F.array().cast("array<string>")
    by_chat = F.from_json("payload", "map<string, struct<industries: array<string>, roles: array<string>>>")
    listed = F.from_json("payload", "array<string>")
    is_list = F.rlike("payload", F.lit(r"^\s*\["))
    maps = files.filter(~is_list).select(F.explode(by_chat).alias("chat", "f")).select(
        F.col("chat").cast("bigint").alias("chat_id"),
        F.coalesce(F.array_sort("f.industries"), none).alias("industries"),
        rename_keys("f.roles", ROLE_RENAMES).alias("roles"),
    )
    plain = files.filter(is_list).select(F.explode(listed).alias("chat")).select(
        F.col("chat").cast("bigint").alias("chat_id"), none.alias("industries"), none.alias("roles")
    )
    return maps.unionByName(plain)


def legacy_journal(files: DataFrame) -> DataFrame:
    """``(chat_id, url, sent_at)`` from JSON texts ``{chat: {url: time}}``."""
    return (
        files.select(F.explode(F.from_json("payload", "map<string, map<string, string>>")).alias("chat", "sent"))
        .select(F.col("chat").cast("bigint").alias("chat_id"), F.explode("sent").alias("url", "at"))
        .select("chat_id", "url", F.col("at").try_cast("timestamp_ntz").alias("sent_at"))
    )


def legacy_seen(files: DataFrame) -> DataFrame:
    """``(id, first_seen_at)`` from JSON texts ``{id: time}``."""
    return files.select(F.explode(F.from_json("payload", "map<string, string>")).alias("id", "at")).select(
        "id", F.col("at").try_cast("timestamp_ntz").alias("first_seen_at")
    )


def first_delivery(chats: DataFrame, journal: DataFrame, now: Column) -> DataFrame:
    """``(chat_id, created_at)``: first known delivery of each chat, ``now`` when there is none."""
    first = journal.groupBy("chat_id").agg(F.min("sent_at").alias("first"))
    return chats.select("chat_id").join(first, "chat_id", "left").select("chat_id", F.coalesce("first", now).alias("created_at"))


def subscriber_rows(subscribers: DataFrame, journal: DataFrame, now: Column) -> DataFrame:
    """Stored form; chats that only occur in the journal have left and become ``stopped``."""
    none = F.array().cast("array<string>")
    chats = subscribers.select("chat_id").union(journal.select("chat_id")).distinct()
    return (
        first_delivery(chats, journal, now)
        .join(subscribers.withColumn("_on", F.lit(True)), "chat_id", "left")
        .select(
            "chat_id",
            F.coalesce("industries", none).alias("industries"),
            F.coalesce("roles", none).alias("roles"),
            F.when(F.col("_on"), "active").otherwise("stopped").alias("status"),
            F.lit(None).cast("timestamp_ntz").alias("history_reset_at"),
            "created_at",
            now.alias("updated_at"),
        )
    )


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows plus those whose key is not there yet; what is stored stays as it is."""
    return stored.unionByName(rows.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys))


def legacy_targets(stats: DataFrame, archive: DataFrame, industry_keys: list[str], order: str) -> DataFrame:
    """Archive plus old statistics rows: last row per url, roles renamed, flags as a map, never overwriting."""
    latest = last_per_key(stats, "url", order)
    flags = [k for k in industry_keys if k in stats.columns]
    hit = F.filter(F.array(*[F.when(F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in flags]), lambda k: k.isNotNull())
    rows = latest.withColumns(
        {
            "salary_min_rub": F.col("salary_min"),
            "salary_max_rub": F.col("salary_max"),
            "matched_roles": rename_keys("matched_roles", ROLE_RENAMES),
            "industries": F.map_from_arrays(hit, F.transform(hit, lambda k: F.array(k))),
        }
    )
    return fold_targets(archive, encode_targets(rows.join(archive.select("url"), "url", "left_anti"), None))


def reconcile(counts: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """``(name, source, stored, ok)``: no table may hold fewer rows than the files it came from."""
    out = None
    for name, source, stored in counts:
        tagged = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).union(stored.select(F.lit(0), F.lit(1)))
        row = tagged.agg(
            F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source"), F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("stored")
        ).select(F.lit(name).alias("name"), "source", "stored", (F.col("stored") >= F.col("source")).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def wrong_filters(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Chats whose stored active filters differ from the files, or that are missing."""
    s = stored.filter("status = 'active'").select("chat_id", F.col("industries").alias("si"), F.col("roles").alias("sr"))
    same = F.col("industries").eqNullSafe(F.col("si")) & F.col("roles").eqNullSafe(F.col("sr"))
    return source.join(s, "chat_id", "left").filter(~same).select("chat_id")
