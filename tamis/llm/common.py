"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words everywhere are runs of characters other than ASCII space, \t, \n, \v, \f and \r.
# ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


HOT_ROWS = 256


def join_hot(rows: DataFrame, values: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row per ``key`` and counts in ``size`` how many rows will meet it.

    Values that meet more than 1/256 of all rows number at most 256: these are broadcast, so their rows stay where they
    lie. All others meet by a shuffle. Rows whose key has no value are left out.
    """
    total = values.agg(F.sum(size)).first()[0] or 0
    hot = values.where(F.col(size) * HOT_ROWS > total).drop(size)
    cold = values.where(F.col(size) * HOT_ROWS <= total).drop(size)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def as_text(value: str | None) -> str:
    return value if isinstance(value, str) else ""


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task builds from one stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on between stages, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
