"""SimHash near-duplicates: fingerprints of 64 bits that differ in few bits, as components.

1. Every text gives the XXH64 hashes of its 4-word shingles, repeats included; a bit of the fingerprint is 1 if it is set
   in more than half of them. Rows with one fingerprint are one node from here on, so copies cost nothing more.
2. The 64 bits are split into ``BLOCKS`` blocks. Two fingerprints that differ in at most ``DISTANCE`` bits differ in at most
   that many blocks, so they agree on all blocks of some choice of ``BLOCKS - DISTANCE``: each choice is one join key. With
   seven blocks that is 35 keys of 27 or 28 bits, so unlike fingerprints hardly ever meet, and a node is shuffled as 35 rows
   of three numbers, however long its texts are.
3. Nodes of one key lie side by side in a sorted partition. They are verified by Hamming distance and give the links of a
   spanning forest only, so a dense group makes as many rows as it has members, and no link between components is lost.
4. A key with more than ``CHUNK`` nodes is cut into chunks, and every two of these are compared in a task of their own.

Defined cases: a null text and one without words have the fingerprint zero and link like any other; with fewer than four
words the whole sequence is one shingle. Null and repeated ids are passed through, one output row per input row; a
component's id is its smallest id that is not null. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import materialize
from .common import join_hot, slices

WIDTH = 4
SEED = 42
BLOCKS = 7
DISTANCE = 4
CHUNK = 1 << 14
# Shingles whose bits are counted at once.
COUNTED = 1 << 14


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Majority of each bit over the hashes of all shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    bits = np.zeros(64, np.int64)
    for at in range(0, total, COUNTED):
        part = words[at : at + COUNTED + width - 1]
        runs = zip(*(part[k:] for k in range(width)), strict=False) if len(part) > width else [part]
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), "<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed number."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            found = np.array([fingerprint(t.as_py()) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found)], ["doc_id", "fp"])

    return rows.mapInArrow(described, f"doc_id {kind}, fp long")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask per choice of the blocks that agree, as signed numbers."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for choice in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << edge[i + 1]) - (1 << edge[i])) for i in choice)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of ``nodes``: each found node with the first one of its component."""
    left, ends, roots = nodes, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found, left = left[near], left[~near]
                ends.append(found)
                roots.append(np.full(len(found), root))
                queue.extend(found)
    none = np.empty(0, np.uint64)
    return (np.concatenate(roots), np.concatenate(ends)) if ends else (none, none)


KEYED = "a long, b long, mask int, part long, chunk int, nodes binary"


def keyed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    rest = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *rest], ["a", "b", "mask", "part", "chunk", "nodes"])


def chunked(mask: int, part: int, chunk: int, nodes: np.ndarray) -> pa.RecordBatch:
    columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([mask], pa.int32()), pa.array([part], pa.int64()), pa.array([chunk], pa.int32()), pa.array([nodes.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "mask", "part", "chunk", "nodes"])


def block_links(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that join the same nodes as all pairs of fingerprints within ``distance`` bits do."""
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(blocks, distance))))
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.part", "fp")
    lying = dealt.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, key = np.empty(0, np.uint64), 0, None  # the key that may go on in the next batch, and its chunks so far

        def closed() -> Iterator[pa.RecordBatch]:
            if number and len(held):
                yield chunked(*key, number, held)
            elif len(held) > 1:
                yield keyed(*forest(held, distance))

        for b in batches:
            mask, part = b["mask"].to_numpy(), b["part"].to_numpy()
            fp = b["fp"].to_numpy().view(np.uint64)
            if not len(fp):
                continue
            start = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
            size = np.diff(np.append(start, len(fp)))
            if key != (int(mask[0]), int(part[0])):
                yield from closed()
                held, number = np.empty(0, np.uint64), 0
            two = start[1:-1][size[1:-1] == 2]  # keys that lie wholly inside the batch
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
            if near.any():
                yield keyed(fp[two[near]], fp[two[near] + 1])
            inner = np.flatnonzero(size > 2)
            found = [forest(fp[start[i] : start[i] + size[i]], distance) for i in inner if 0 < i < len(start) - 1]
            if found:
                yield keyed(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for i in {0, len(start) - 1}:
                if i:
                    yield from closed()
                    held, number = np.empty(0, np.uint64), 0
                key = (int(mask[start[i]]), int(part[start[i]]))
                held = np.concatenate([held, fp[start[i] : start[i] + size[i]]])
                while len(held) > chunk:
                    yield chunked(*key, number, held[:chunk])
                    held, number = held[chunk:], number + 1
        yield from closed()

    found = materialize(lying.mapInArrow(scanned, KEYED), "simhash-blocks")
    links = found.where("chunk is null").select("a", "b").distinct()
    chunks = found.where("chunk is not null").select("mask", "part", "chunk", "nodes")
    if chunks.isEmpty():
        return links
    places = chunks.select("mask", "part", "chunk")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    couples = places.alias("x").join(places.alias("y"), ["mask", "part"]).where("x.chunk < y.chunk")
    couples = couples.select("mask", "part", F.col("x.chunk").alias("c"), F.col("y.chunk").alias("d")).repartition(tasks, "mask", "part", "c", "d")
    side = lambda c, nodes: chunks.select("mask", "part", F.col("chunk").alias(c), F.col("nodes").alias(nodes)).hint("shuffle_hash")
    both = couples.join(side("c", "left"), ["mask", "part", "c"]).join(side("d", "right"), ["mask", "part", "d"]).select("left", "right")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b["left"], b["right"], strict=True):
                a, z = forest(np.frombuffer(x.as_py() + y.as_py(), np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(z.view(np.int64))], ["a", "b"])

    return links.union(both.mapInArrow(compared, "a long, b long")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(fingerprints(rows), "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-prints")
    label = components(block_links(prints, blocks, distance, chunk)).select(F.col("node").alias("fp"), "component")
    linked = materialize(prints.join(label, "fp").select("fp", "first", "copies", "component"), "simhash-labels")
    groups = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = join_hot(linked.select("fp", "component", "copies"), groups, "component", "members").select("fp", "component_id", "copies")
    alone = prints.join(label, "fp", "left_anti").select("fp", F.col("first").alias("component_id"), "copies")
    found = materialize(named.union(alone), "simhash-found")
    out = join_hot(rows, found, "fp", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
