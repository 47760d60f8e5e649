"""Best-fit packing into sequences of several permitted lengths.

Rows are dealt to shards by a hash of the row, so many that a shard holds about ``shard_rows`` rows whatever the size of
the table. In a shard, pieces are taken longest first and put into the open bin that leaves the least room. If none has
room, a new bin is opened at the permitted length whose cost per token is least when it is filled with the pieces that are
still to come. In the end every bin is shrunk to the smallest permitted length that holds its content.

A row longer than the largest length is cut into pieces of that length and a rest; nothing is dropped. Defined cases: a
null, zero or negative length gives no piece; repeated rows are packed as rows of their own; a null id is packed too. An
empty table gives no rows. Only the id and length columns are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CAPACITIES = (256, 512, 1024, 2048)
SHARD_ROWS = 20_000
# Tokens that opening a sequence costs besides its length.
OVERHEAD = 16


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and final capacity of the bin, for each length (1 to the largest capacity).

    All permitted lengths are weighed whenever a bin is opened: each is filled in thought with the longest pieces that are
    still to come and fit, and the one with the least cost per token after shrinking to its content is opened.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    to_come = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    present = sum(1 << n for n, many in enumerate(to_come) if many)  # bit n is set if a piece of length n is to come
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    used: list[int] = []

    def cost(n: int, capacity: int) -> float:
        room, here = capacity - n, present
        while room:
            here &= (1 << room + 1) - 1
            if not here:
                break
            longest = here.bit_length() - 1
            room -= min(room // longest, to_come[longest]) * longest
            here ^= 1 << longest
        fill = capacity - room
        return (next(c for c in sizes if c >= fill) + overhead) / fill

    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        to_come[n] -= 1
        if not to_come[n]:
            present ^= 1 << n
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: (cost(n, c), c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    final = np.asarray(sizes)[np.searchsorted(sizes, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final[bins]


def pack(rows: DataFrame, id_col: str, length_col: str, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: id, piece, start and length in the row; bin_id, bin_capacity and offset in the bin."""
    top = max(capacities)
    narrow = materialize(rows.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("n")).where("n > 0"), "pack-rows")
    kind = narrow.schema["id"].dataType
    shards = max(1, -(-narrow.count() // shard_rows))
    # rows with one id are told apart by their length and, if that is equal too, by their place in the input
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("id", "n", F.lit(5)) + F.monotonically_increasing_id(), F.lit(shards)).cast("long"))

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "descending"), ("id", "ascending")])
        n = group["n"].to_numpy()
        pieces = -(-n // top)
        row = np.repeat(np.arange(len(n)), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * top
        length = np.minimum(n[row] - start, top)
        bins, offset, capacity = best_fit(length, capacities, overhead)
        names = pa.array([f"{key[0].as_py()}-{b}" for b in bins.tolist()], pa.string())
        columns = [group["id"].take(pa.array(row)).combine_chunks(), start // top, start, length, capacity, offset, names]
        return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["id", "piece", "start", "length", "bin_capacity", "offset", "bin_id"])

    schema = f"id {kind.simpleString()}, piece long, start long, length long, bin_capacity long, offset long, bin_id string"
    return dealt.groupBy("shard").applyInArrow(packed, schema).withColumnRenamed("id", id_col)
