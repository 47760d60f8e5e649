"""Subscribers as they stand after a log of commands, folded from segments of the log.

A segment is what a stretch of commands does to a chat, whatever came before: one outcome for a chat that was active and one
for a chat that was not. Two neighbouring segments compose to one, so the log is folded in ranges of a bounded number
of commands, these in ranges of ranges, and so on; a chat that holds most of the log is spread over its ranges. A stream keeps the
segments of its batches, which compose in the same way.

An outcome says whether the chat is ``active`` in the end, whether it is ``known`` to exist, when it first joined, which filters were
wiped, which keys were switched an odd number of times since, and the times of the last edit, of the last change,
and of the last stop that counts only if the chat existed before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import toggle

RANGE = 4096
_FIELDS = ("active", "known", "joined_at", "wiped_ind", "wiped_role", "ind", "role", "edited_at", "changed_at", "stop_at")


def _outcome(**fields: Column) -> Column:
    return F.struct(*[fields[f].alias(f) for f in _FIELDS])


def _before(active: bool, kind: str) -> Column:
    """The outcome of no commands."""
    never, none = F.lit(None).cast(kind), F.array().cast("array<string>")
    yes, no = F.lit(True), F.lit(False)
    was = yes if active else no
    return _outcome(active=was, known=was, joined_at=never, wiped_ind=no, wiped_role=no, ind=none, role=none, edited_at=never, changed_at=never, stop_at=never)


def _command(f: Column, x: Column) -> Column:
    """The outcome ``f``, followed by a command."""
    kind, ts, none = x["kind"], x["ts"], F.array().cast("array<string>")
    joins = (kind == "start") & ~f["active"]
    stops = (kind == "stop") & f["known"]
    edits = kind.isin("toggle", "reset") & f["active"]
    wipes = lambda name: edits & (kind == "reset") & (x["filter"] == name)
    flips = lambda name: edits & (kind == "toggle") & (x["filter"] == name)
    keys = lambda name: F.when(joins | wipes(name), none).when(flips(name), toggle(f[name], x["value"])).otherwise(f[name])
    return _outcome(
        active=F.when(joins, True).when(kind == "stop", False).otherwise(f["active"]),
        known=joins | f["known"],
        joined_at=F.coalesce(f["joined_at"], F.when(joins, ts)),
        wiped_ind=f["wiped_ind"] | joins | F.coalesce(wipes("ind"), F.lit(False)),
        wiped_role=f["wiped_role"] | joins | F.coalesce(wipes("role"), F.lit(False)),
        ind=keys("ind"),
        role=keys("role"),
        edited_at=F.when(edits, ts).otherwise(f["edited_at"]),
        changed_at=F.when(joins | stops | edits, ts).otherwise(f["changed_at"]),
        stop_at=F.when((kind == "stop") & ~f["known"], ts).otherwise(f["stop_at"]),
    )


def _odd(a: Column, b: Column) -> Column:
    """Keys that are in one of two sets."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def _followed(f: Column, x: Column) -> Column:
    """The outcome ``f``, followed by a segment."""
    g = lambda name: F.when(f["active"], x["on"][name]).otherwise(x["off"][name])
    keys = lambda name: F.when(g(f"wiped_{name}"), g(name)).otherwise(_odd(f[name], g(name)))
    stop = F.when(~f["active"], x["off"]["stop_at"])
    return _outcome(
        active=g("active"),
        known=f["known"] | g("known"),
        joined_at=F.coalesce(f["joined_at"], g("joined_at")),
        wiped_ind=f["wiped_ind"] | g("wiped_ind"),
        wiped_role=f["wiped_role"] | g("wiped_role"),
        ind=keys("ind"),
        role=keys("role"),
        edited_at=F.coalesce(g("edited_at"), f["edited_at"]),
        changed_at=F.coalesce(g("changed_at"), F.when(f["known"], stop), f["changed_at"]),
        stop_at=F.coalesce(F.when(~f["known"], stop), f["stop_at"]),
    )


def _fold(rows: Column, kind: str, step) -> Column:
    """Both outcomes of a list of commands or segments, in order."""
    start = F.struct(_before(True, kind).alias("on"), _before(False, kind).alias("off"))
    return F.aggregate(F.array_sort(rows), start, lambda acc, x: F.struct(step(acc["on"], x).alias("on"), step(acc["off"], x).alias("off")))


def segments(commands: DataFrame, width: int = RANGE) -> DataFrame:
    """``(chat_id, part, segment)``: one segment per chat and range of ``width`` update ids; see ``schemas.COMMAND``."""
    kind = commands.schema["ts"].dataType.simpleString()
    rows = commands.select("chat_id", F.expr(f"update_id div {width}").alias("part"), F.struct("update_id", "ts", F.coalesce("kind", F.lit("")).alias("kind"), "filter", "value").alias("c"))
    held = rows.groupBy("chat_id", "part").agg(F.collect_list("c").alias("c"))
    return held.select("chat_id", "part", _fold(F.col("c"), kind, _command).alias("segment"))


def composed(parts: DataFrame, width: int = RANGE) -> DataFrame:
    """``(chat_id, segment)`` out of ``(chat_id, part, segment)``: ranges of ``width`` parts, then ranges of these, until one is left."""
    kind = parts.schema["segment"].dataType["on"].dataType["joined_at"].dataType.simpleString()
    ends = parts.agg(F.max("part").alias("high"), F.min("part").alias("low")).first()
    high, low = ends.high or 0, ends.low or 0
    while True:
        held = parts.groupBy("chat_id", F.expr(f"part div {width}").alias("part")).agg(F.collect_list(F.struct("part", "segment.on", "segment.off")).alias("c"))
        parts = held.select("chat_id", "part", _fold(F.col("c"), kind, _followed).alias("segment"))
        high, low = high // width, -(-low // width)
        if high == low == 0:
            return parts.select("chat_id", "segment")


def states(whole: DataFrame) -> DataFrame:
    """Subscribers (``schemas.SUBSCRIBER``) after everything; chats that never joined do not appear."""
    end = F.col("segment.off")
    return whole.filter(end["known"]).select(
        "chat_id",
        end["ind"].alias("industries"),
        end["role"].alias("roles"),
        F.when(end["active"], "active").otherwise("stopped").alias("status"),
        end["edited_at"].alias("history_reset_at"),
        end["joined_at"].alias("created_at"),
        end["changed_at"].alias("updated_at"),
    )


def subscriber_state(commands: DataFrame, width: int = RANGE) -> DataFrame:
    """Subscribers as they stand after a log of commands (see ``schemas.COMMAND``).

    A start by an active chat does nothing; a start after a stop clears the filters but keeps the
    history mark. Toggles and resets count only while active: a key is chosen when it was toggled an odd
    number of times since the last reset or start, and every change marks the history as reset.
    """
    return states(composed(segments(commands, width), width))
