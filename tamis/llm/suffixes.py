"""Removal of text repeated from earlier documents, with a run-length compressed suffix index.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

1. Equal texts form a class, named by a digest; its first document stands for it, later ones go entirely.
2. Every window of ``LENGTH`` bytes has as anchor the smallest hash of its ``GRAM``-byte grams, so equal windows have
   equal anchors. Anchors are dealt to buckets and counted; windows whose anchor occurs in one class alone are unique.
3. Neighbouring windows of one anchor form a string. Strings with repeated anchors are dealt out by anchor. Each bucket
   sorts the suffixes of its distinct strings (prefix doubling up to ``LENGTH``), takes the Burrows-Wheeler transform,
   keeps its runs only, and samples the smallest document at the ends of the groups of equal windows. The strings are
   then streamed against the index from right to left: each step maps the interval of the current match by the runs, the
   match grows up to ``LENGTH`` and is then cut on the right. Where it has full length, the sample tells the smallest
   document that holds it.
4. The intervals of repeated windows go back to their class, and the covered bytes leave its text.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing. Rows with a null id lose nothing
and take nothing from others. Rows with one id and different texts don't take from each other; rows with one id and
one text have one result. Only the id and text columns are read; every input row gives one output row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices
from .jaccard import met_again, payload, unpacked

LENGTH = 50
GRAM = 18
PIECE = 1 << 20
BUCKET_ANCHORS = 1_000_000
STRINGS_PER_BUCKET = 60_000
INDEX_STRINGS = 4_000

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
EMPTY = hashlib.sha256(b"").hexdigest()


class Anchors:
    """Anchors of the windows of a text."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.span = length, gram, length - gram + 1
        n = PIECE + length
        steps = np.ones(n, np.uint64)
        self.up, self.down = steps.copy(), steps
        self.up[1:] = BASE & 0xFFFFFFFFFFFFFFFF
        self.down[1:] = INVERSE
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, end of windows, and anchor of each run of neighbouring windows with one anchor."""
        found = [self.piece(data, at) for at in range(0, len(data) - self.length + 1, PIECE)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def piece(self, data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, np.uint8, min(PIECE + self.length - 1, len(data) - at), at)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * self.up[: len(b)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(b) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low, width = h, 1
        while 2 * width <= self.span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = self.span - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        start = np.append(0, np.flatnonzero(low[1:] != low[:-1]) + 1)
        return at + start, at + np.append(start[1:], len(low)), low[start]


def described(rows: DataFrame) -> DataFrame:
    """Per row (doc_id, n_bytes, cls, sha256)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() or b"" for x in b["data"]]
            hashes = [hashlib.sha256(x) for x in data]
            columns = [b["doc_id"], pa.array(map(len, data), pa.int64()), pa.array([x.digest()[:16] for x in hashes]), pa.array([x.hexdigest() for x in hashes])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "cls", "sha256"])

    return rows.mapInArrow(describe, f"doc_id {kind}, n_bytes long, cls binary, sha256 string")


def class_name(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each anchor, by its low bits: an anchor is the least of many hashes, so its high bits are nearly all small."""
    return (anchors & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)


def repeated_anchors(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """(cls, anchors): the anchors of each class that another class has too, packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for b in slices(batches, 1000):
            out: dict[int, tuple[list, list]] = {}
            seen = set()
            for x in b["data"]:
                data = x.as_py() or b""
                if len(data) < length or (name := class_name(data)) in seen:
                    continue
                seen.add(name)
                h = np.unique(anchors.of(data)[2])
                at = bucket_of(h, buckets)
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
                for bucket, part in zip(at[np.append(0, cuts)].tolist(), np.split(h, cuts), strict=True):
                    names, parts = out.setdefault(bucket, ([], []))
                    names.append(name)
                    parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([payload(*x) for x in out.values()], pa.binary())], ["bucket", "payload"])

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        names, owner, anchor = unpacked(group["payload"], 16)
        again = met_again(anchor)
        owner, anchor = owner[again], anchor[again]
        order = np.lexsort((owner, anchor))
        owner, anchor = owner[order], anchor[order]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))[: len(owner)]
        owner, anchor = owner[new], anchor[new]
        many = met_again(anchor)
        owner, anchor = owner[many], anchor[many]
        to = np.frombuffer(names.tobytes(), np.uint64)[::2] % np.uint64(buckets)
        order = np.lexsort((owner, to[owner]))
        owner, anchor = owner[order], anchor[order]
        # one row per group of classes, in which a class has all its anchors of this bucket
        home, out = to[owner].astype(np.int64), []
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(home)) + 1) if len(owner) else ():
            held, size = np.unique(owner[part], return_counts=True)
            out.append((int(home[part[0]]), payload([names[i].tobytes() for i in held], np.split(anchor[part], np.cumsum(size)[:-1]))))
        return pa.Table.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], ["home", "payload"])

    def gathered(key: tuple, group: pa.Table) -> pa.Table:
        names, owner, anchor = unpacked(group["payload"], 16)
        order = np.argsort(owner, kind="stable")
        owner, anchor = owner[order], anchor[order]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
        parts = np.split(anchor, heads[1:]) if len(owner) else ()
        columns = [pa.array([names[i].tobytes() for i in owner[heads]], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary())]
        return pa.Table.from_arrays(columns, ["cls", "anchors"])

    dealt = rows.select("data").mapInArrow(packed, "bucket int, payload binary")
    met = dealt.groupBy("bucket").applyInArrow(counted, "home int, payload binary")
    return met.groupBy("home").applyInArrow(gathered, "cls binary, anchors binary")


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of strings, each with a number, sorted by ``length`` bytes.

    ``least`` samples, for each group of equal windows, the smallest number of a string that holds it.
    """

    def __init__(self, strings: list[bytes], numbers: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        text[np.cumsum(sizes) - 1] = 0
        n = len(text)
        # seven bytes fit into one number; from there on ranks are joined
        rank, depth, ahead = np.zeros(n, np.int64), 0, 0
        while depth < length:
            if depth == 0:
                for k in range(7):
                    rank *= 257
                    rank[: n - k] += text[k:]
                key, depth = rank, 7
            else:
                ahead = min(depth, length - depth)
                key = rank * np.int64(n + 2)
                key[: n - ahead] += rank[ahead:] + 1
                depth += ahead
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            group = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[suffixes] = group
        before = text[suffixes - 1]
        self.start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.head = before[self.start]
        runs = len(self.start)
        sizes_of = np.diff(np.append(self.start, n))
        self.run_of = np.repeat(np.arange(runs, dtype=np.int32), sizes_of)
        order = np.argsort(self.head.astype(np.int16), kind="stable")
        self.keys = self.head[order] * (runs + 1) + order
        self.runs = runs
        self.sums = np.append(0, np.cumsum(sizes_of[order]))
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=258)))
        self.base = self.sums[np.searchsorted(self.keys, np.arange(258) * (runs + 1))]
        self.edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        self.group = group.astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(numbers, sizes)[suffixes], self.edges)

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First place of the suffixes that begin with ``c`` and go on below place ``i``."""
        run = self.run_of[i]
        at = np.searchsorted(self.keys, c * (self.runs + 1) + run)
        inside = np.where(self.head[run] == c, i - self.start[run], 0)
        return self.first[c] + self.sums[at] - self.base[c] + inside

    def windows(self, strings: list[bytes]) -> np.ndarray:
        """Smallest number per window of each string, streamed from the right; windows in order, strings in order."""
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes)[order]
        long = sizes[order]
        counts = sizes - self.length + 1
        out = np.empty(counts.sum(), np.int64)
        places = (np.cumsum(counts) - counts)[order]
        # every string is in the index, so no interval runs empty, and its first place is enough
        low = np.zeros(len(strings), np.int64)
        for k in range(1, int(long[0]) + 1 if len(long) else 0):
            m = int(np.searchsorted(-long, -k, "right"))  # strings of k bytes and more
            low = self.step(data[ends[:m] - k], low[:m])
            if k >= self.length:
                group = self.group[low]
                out[places[:m] + long[:m] - k] = self.least[group]
                # cut on the right: the first of all suffixes that share the window
                low = self.edges[group]
        return out


def packed_strings(items: list[tuple[bytes, int, int, int, bytes]]) -> bytes:
    """(class, its document, first window, anchor, string) packed in order of classes; equal strings once."""
    # owners are rebuilt from counts, so the items of a class stand together
    items = sorted(items, key=lambda x: x[0])
    classes = Counter((x[0], x[1]) for x in items)
    strings: dict[bytes, tuple[int, int]] = {}
    which = [strings.setdefault(x[4], (len(strings), x[3]))[0] for x in items]
    return b"".join(
        [
            np.array([len(classes), len(items), len(strings)], np.int64).tobytes(),
            b"".join(c[0] for c in classes),
            np.array([c[1] for c in classes], np.int64).tobytes(),
            np.array([x[1] for x in strings.values()], np.uint64).tobytes(),
            np.array(list(classes.values()), np.uint32).tobytes(),
            np.array([[x[2] for x in items], which], np.uint32).tobytes(),
            np.array(list(map(len, strings)), np.uint32).tobytes(),
            *strings,
        ]
    )


class Strings:
    """Distinct strings of a bucket with their anchors, and where they occur."""

    def __init__(self, payloads: pa.ChunkedArray) -> None:
        names, reps, starts, which, owner = [], [], [], [], []
        seen: dict[bytes, int] = {}
        anchors: list[int] = []
        shift = 0
        for p in payloads:
            blob, at = p.as_py(), 24
            n_classes, n_items, n_strings = np.frombuffer(blob, np.int64, 3).tolist()

            def take(kind: object, n: int) -> np.ndarray:
                nonlocal at
                out = np.frombuffer(blob, kind, n, at)
                at += out.nbytes
                return out

            names.append(take("V16", n_classes))
            reps.append(take(np.int64, n_classes))
            own = take(np.uint64, n_strings).tolist()
            owner.append(np.repeat(np.arange(n_classes), take(np.uint32, n_classes)) + shift)
            starts.append(take(np.uint32, n_items).astype(np.int64))
            local = take(np.uint32, n_items)
            number = np.empty(n_strings, np.int64)
            for i, n in enumerate(take(np.uint32, n_strings).tolist()):
                text = blob[at : at + n]
                at += n
                k = number[i] = seen.setdefault(text, len(seen))
                if k == len(anchors):
                    anchors.append(own[i])
            which.append(number[local])
            shift += n_classes
        self.name, self.start = np.concatenate(names), np.concatenate(starts)
        self.owner, self.which = np.concatenate(owner), np.concatenate(which)
        self.rep = np.concatenate(reps)[self.owner]
        self.distinct, self.anchors = list(seen), np.array(anchors, np.uint64)


def strings_of(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, payload): strings with repeated anchors and their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, seen = Anchors(length), set()
        for b in slices(batches, 1000):
            out: dict[int, list] = {}
            for name, rep, x, lists in zip(b["cls"], b["rep"], b["data"], b["lists"], strict=True):
                data, name, rep = x.as_py(), name.as_py(), rep.as_py()
                # repeated rows are one class
                if name in seen:
                    continue
                seen.add(name)
                known = np.sort(np.concatenate([np.frombuffer(y, np.uint64) for y in lists.as_py()]))
                start, end, anchor = anchors.of(data)
                hit = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                bucket = (anchor[hit] & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
                for k, s, e, h in zip(bucket.tolist(), start[hit].tolist(), end[hit].tolist(), anchor[hit].tolist(), strict=True):
                    out.setdefault(k, []).append((name, rep, s, h, data[s : e + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([packed_strings(x) for x in out.values()], pa.binary())], ["bucket", "payload"])

    return texts.mapInArrow(cut, "bucket int, payload binary")


def earliest(s: Strings, length: int) -> np.ndarray:
    """Smallest document of every window of the distinct strings.

    Equal windows have equal anchors, so a string that has its anchor to itself is its own and only run; the others go
    through the index.
    """
    first = np.full(len(s.distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, s.which, s.rep)
    counts = np.fromiter(map(len, s.distinct), np.int64, len(s.distinct)) - length + 1
    out = np.repeat(first, counts)
    _, back, many = np.unique(s.anchors, return_inverse=True, return_counts=True)
    rivals = np.flatnonzero(many[back] > 1)
    rivals = rivals[np.argsort(back[rivals], kind="stable")]
    begin = np.cumsum(counts) - counts
    # small indexes are faster than a large one; the strings of an anchor stay together
    new = np.append(True, back[rivals][1:] != back[rivals][:-1]) if len(rivals) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    cuts = starts[np.append(True, np.diff(starts // INDEX_STRINGS) > 0)] if len(rivals) else starts
    for part in np.split(rivals, cuts[1:]):
        if len(part):
            texts = [s.distinct[i] for i in part.tolist()]
            n = counts[part]
            place = np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[place] = RunIndex(texts, first[part], length).windows(texts)
    return out


def repeated_windows(dealt: DataFrame, length: int) -> DataFrame:
    """(cls, spans): runs of windows that an earlier document holds, as packed pairs of first window and end."""

    def matched(key: tuple, group: pa.Table) -> pa.Table:
        s = Strings(group["payload"])
        least = earliest(s, length)
        counts = np.fromiter(map(len, s.distinct), np.int64, len(s.distinct)) - length + 1
        begin = np.cumsum(counts) - counts
        # windows of every occurrence
        n = counts[s.which]
        item = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        dup = least[begin[s.which][item] + offset] < s.rep[item]
        item, place = item[dup], s.start[item[dup]] + offset[dup]
        if not len(item):
            return pa.table({"cls": pa.array([], pa.binary()), "spans": pa.array([], pa.binary())})
        heads = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)))
        spans = np.stack([place[heads], place[np.append(heads[1:], len(place)) - 1] + 1], axis=1)
        names, owner = np.unique(s.name[s.owner[item[heads]]], return_inverse=True)
        parts = np.split(spans[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner))[:-1])
        return pa.table({"cls": pa.array([x.tobytes() for x in names], pa.binary()), "spans": pa.array([x.tobytes() for x in parts], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(matched, "cls binary, spans binary")


def covered(spans: np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes below windows."""
    order = np.argsort(spans[:, 0], kind="stable")
    a, b = spans[order, 0], np.maximum.accumulate(spans[order, 1] + length - 1)
    head = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[head].tolist(), b[np.append(head[1:], len(b)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and ``kept_text`` (binary) if asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    known = materialize(described(rows), "repeat-rows")
    classes = known.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    named = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("data") >= length))
    buckets = max(1, -(-2 * total // (length - GRAM + 2) // BUCKET_ANCHORS))
    lists = repeated_anchors(named, buckets, length).groupBy("cls").agg(F.collect_list("anchors").alias("lists"), F.sum(F.octet_length("anchors") / 8).alias("k"))
    lists = materialize(lists.join(classes.select("cls", "rep"), "cls"), "repeat-anchors")
    n_strings = lists.agg(F.sum("k")).first()[0] or 0
    texts = named.join(lists, named["doc_id"] == lists["rep"]).where(F.substring(F.sha2("data", 256), 1, 32) == F.lower(F.hex("cls")))
    dealt = strings_of(texts.select("cls", "rep", "data", "lists"), max(1, int(n_strings) // STRINGS_PER_BUCKET + 1), length)
    spans = materialize(repeated_windows(dealt, length).groupBy("cls").agg(F.collect_list("spans").alias("spans")), "repeat-spans")

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, lists in zip(b["data"], b["spans"], strict=True):
                data = x.as_py()
                runs = covered(np.concatenate([np.frombuffer(y, np.int64).reshape(-1, 2) for y in lists.as_py()]), len(data), length)
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out.append((len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [b["cls"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))] if out else [b["cls"], pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "r", "s", "h", "t"])

    marked = spans.join(classes.select("cls", "rep"), "cls")
    texts = named.join(marked, named["doc_id"] == marked["rep"]).where(F.substring(F.sha2("data", 256), 1, 32) == F.lower(F.hex("cls")))
    cut = texts.select("cls", "data", "spans").mapInArrow(trimmed, "cls binary, r long, s long, h string, t binary")
    cut = materialize(cut, "repeat-cut").dropDuplicates(["cls"])
    out = known.join(classes.select("cls", "rep"), "cls", "left").join(cut, "cls", "left")
    able = F.col("rep").isNotNull() & F.col("doc_id").isNotNull()
    copy, own = able & (F.col("doc_id") > F.col("rep")), able & (F.col("doc_id") == F.col("rep")) & F.col("r").isNotNull()
    columns = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.col("r")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(own, F.col("s")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, EMPTY).when(own, F.col("h")).otherwise(F.col("sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns += [F.when(copy, F.lit(b"")).when(own, F.col("t")).alias("kept_text")]
    return out.select(columns)
