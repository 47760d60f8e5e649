"""N-gram Jaccard join: all links of similarity ``percent`` or more, as components.

1. Every text becomes the set of its 5-word shingles as 64-bit hashes. Texts with one set form a class, named by a
   digest of the set; from here on only classes count, so copies cost nothing more.
2. Shingles are dealt to buckets by hash and counted over all classes. Those of one class alone cannot link anything and
   stay behind; the rest go back to their class. Shingles that a noticeable part of all documents holds are found in
   step 1 (``HOT_SHARE``); they rank last without being counted, so that none of them fills a bucket.
3. Each class orders its shingles rare first: unshared, then by frequency, then hash. Two classes can link only if they
   share one in the first part of this order (prefix filter), and if sizes (length filter) and places (positional filter)
   leave enough room. The pairs that remain must also pass a bound on the overlap by ranges of the hash (suffix filter).
   Each remaining pair is verified once, by the exact overlap.
4. Pairs inside a group of near copies would grow with its square, so each prefix shingle first pairs its classes with
   one hub only. Links join classes to components; after that, a shingle pairs only classes of different components,
   each outside its largest component with all others. No link between components can be missed.

A wrong overlap needs two different shingles of the same pair with equal 64-bit hashes.

Defined cases: a null text and one without words have the empty set, 0 shingles, and link with nothing; with fewer than
five words the whole sequence is one shingle. Null and repeated ids are passed through, one output row per input row; a
component's id is its smallest id that is not null. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..operators.graph import components as joined
from .common import join_hot, release, slices

WIDTH = 5
PERCENT = 80
BUCKET_TOKENS = 2_000_000
HOT_SHARE = 1 / 256
HOT_LEVEL = 255
RANGE_BITS = 6
RANGES = 1 << RANGE_BITS
CACHED_WORDS = 200_000
NAME = 10  # bytes of a class's digest, which travels with every bucket that the class has shingles in

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordIds(dict):
    """64-bit ids of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


def shingles(text: str | None, ids: WordIds, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        h = np.array([(w * MIX[: len(w)]).sum() + np.uint64(len(w))], np.uint64)
    else:
        h = w[: len(w) - width + 1] * MIX[0]
        for k in range(1, width):
            h = h + w[k : len(w) - width + 1 + k] * MIX[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=NAME).digest() if len(h) else None


def sets_of(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, print, n, cls); besides, rows with ``hot``: hashes and counts that are frequent in a batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches, 4000):
            sets = [shingles(t.as_py(), ids) for t in b["text"]]
            names = [class_of(h) for h in sets]
            hot = None
            distinct = list({c: h for c, h in zip(names, sets, strict=True) if c}.values())
            if distinct:
                value, n = np.unique(np.concatenate(distinct), return_counts=True)
                often = n >= max(4, HOT_SHARE * len(distinct))
                hot = value[often].tobytes() + n[often].astype(np.uint64).tobytes()
            columns = [b["doc_id"], b["print"], pa.array([len(h) for h in sets], pa.int64()), pa.array(names, pa.binary()), pa.nulls(len(b), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "cls", "hot"])
            if hot:
                columns = [pa.nulls(1, b["doc_id"].type), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([hot], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n", "cls", "hot"])

    return docs.mapInArrow(described, f"doc_id {kind}, print string, n long, cls binary, hot binary")


def hot_shingles(described: DataFrame, n_classes: int) -> np.ndarray:
    """Hashes held by many classes: at most (2 / HOT_SHARE) times the mean set size of them, whatever the corpus."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b["hot"]:
                value, n = np.frombuffer(blob.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["h", "n"])

    counted = described.where("hot is not null").select("hot").mapInArrow(opened, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(8.0, HOT_SHARE / 2 * n_classes)).select("h").toArrow()
    return np.sort(rows["h"].to_numpy().astype(np.int64).view(np.uint64))


def payload(names: list[bytes], parts: list[np.ndarray]) -> bytes:
    """Classes with their hashes, packed; ``unpacked`` reads it. A class with very many hashes stands there several times."""
    if max(map(len, parts)) > 0xFFFF:
        cut = [(n, p[i : i + 0xFFFF]) for n, p in zip(names, parts, strict=True) for i in range(0, len(p), 0xFFFF)]
        names, parts = [n for n, _ in cut], [p for _, p in cut]
    head = np.array([len(names)], np.int64).tobytes() + b"".join(names)
    return head + np.array([len(x) for x in parts], np.uint16).tobytes() + np.concatenate(parts).tobytes()


def home(names: np.ndarray, groups: int) -> np.ndarray:
    """The group that each class is dealt to, by its digest."""
    head = np.frombuffer(names.tobytes(), np.uint8).reshape(-1, NAME)[:, :8]
    return (np.ascontiguousarray(head).view(np.uint64).ravel() % np.uint64(groups)).astype(np.int64)


def dealt(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, payload): the shingles of each batch's classes, packed by bucket.

    A payload is the number of classes, then per class its digest and number of shingles here, then all these
    shingles; sizes stay behind. Hot shingles go to the bucket of their class, with a negative number.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches, 2000):
            out: dict[int, tuple[list, list]] = {}

            def add(bucket: int, name: bytes, h: np.ndarray) -> None:
                names, parts = out.setdefault(bucket, ([], []))
                names.append(name)
                parts.append(h)

            seen = set()
            for t in b["text"]:
                h = shingles(t.as_py(), ids)
                name = class_of(h)
                if name is None or name in seen:
                    continue
                seen.add(name)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    if often.any():
                        add(-1 - int.from_bytes(name[:4], "little") % buckets, name, h[often])
                        h = h[~often]
                # sorted hashes: equal buckets lie side by side
                at = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
                for part in np.split(h, cuts) if len(h) else ():
                    add(int((int(part[0]) >> 32) * buckets >> 32), name, part)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([payload(*x) for x in out.values()], pa.binary())], ["bucket", "payload"])

    return docs.select("text").mapInArrow(packed, "bucket int, payload binary")


def unpacked(payloads: pa.ChunkedArray, width: int = NAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct classes (digests); then the class number and hash of every entry."""
    names, counts, tokens = [], [], []
    for p in payloads:
        blob = p.as_buffer()
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        names.append(np.frombuffer(blob, f"V{width}", k, 8))
        counts.append(np.frombuffer(blob, np.uint16, k, 8 + width * k))
        tokens.append(np.frombuffer(blob, np.uint64, -1, 8 + (width + 2) * k))
    distinct, back = np.unique(np.concatenate(names), return_inverse=True)
    return distinct, np.repeat(back.astype(np.int32), np.concatenate(counts)), np.concatenate(tokens)


def met_again(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once; needs less memory than an order of all entries."""
    ordered = np.sort(values)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(repeated):
        return np.zeros(len(values), bool)
    return repeated[np.minimum(np.searchsorted(repeated, values), len(repeated) - 1)] == values


def shared_shingles(packed: DataFrame, groups: int) -> DataFrame:
    """(group, payload, levels): the shingles that several classes hold, with their frequency levels.

    Classes are dealt to ``groups`` by their digest; a bucket gives one row per group.
    """

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        release()
        names, owner, token = unpacked(group["payload"])
        if key[0].as_py() >= 0:
            again = met_again(token)
            owner, token = owner[again], token[again]
        order = np.lexsort((owner, token))
        owner, token = owner[order], token[order]
        if len(token):
            new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
            owner, token = owner[new], token[new]
        if key[0].as_py() < 0:
            level = np.full(len(token), HOT_LEVEL, np.uint8)
        else:
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
            df = np.diff(np.append(start, len(token)))
            level = np.repeat(np.minimum(8 * np.log2(df), HOT_LEVEL - 1).astype(np.uint8), df)
            many = np.repeat(df > 1, df)
            owner, token, level = owner[many], token[many], level[many]
        to = home(names, groups)
        order = np.lexsort((owner, to[owner]))
        owner, token, level = owner[order], token[order], level[order]
        rows = []
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(to[owner])) + 1) if len(owner) else ():
            held, many = np.unique(owner[part], return_counts=True)
            parts = np.split(token[part], np.cumsum(many)[:-1])
            rows.append((int(to[held[0]]), payload([names[i].tobytes() for i in held], parts), level[part].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["group", "payload", "levels"])

    return packed.groupBy("bucket").applyInArrow(counted, "group int, payload binary, levels binary")


def class_sizes(classes: DataFrame, groups: int) -> DataFrame:
    """(group, payload, levels): the sizes of classes, dealt as their shingles are; ``levels`` is null."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.frombuffer(b"".join(c.as_py() for c in b["cls"]), f"V{NAME}")
            size, to = b["n"].to_numpy().astype(np.uint32), home(names, groups)
            rows = [(int(g), names[to == g].tobytes() + size[to == g].tobytes()) for g in np.unique(to)]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "payload", "levels"])

    return classes.select("cls", "n").mapInArrow(packed, "group int, payload binary, levels binary")


def features(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cls, n, tokens rare first, sig): classes that share enough shingles to link at all."""

    def ordered(key: tuple, group: pa.Table) -> pa.Table:
        release()
        told = group["levels"].is_null()
        size_of = {}
        for p in group.filter(told)["payload"]:
            blob = p.as_buffer()
            k = len(blob) // (NAME + 4)
            size_of |= zip(map(bytes, np.frombuffer(blob, f"V{NAME}", k)), np.frombuffer(blob, np.uint32, k, NAME * k).tolist(), strict=True)
        group = group.filter(pc.invert(told))
        if not len(group):
            return pa.table({"cls": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "tokens": pa.array([], pa.list_(pa.int64())), "sig": pa.array([], pa.list_(pa.int32()))})
        names, owner, token = unpacked(group["payload"])
        sizes = np.array([size_of[n] for n in map(bytes, names)], np.int64)
        level = np.frombuffer(b"".join(x.as_py() for x in group["levels"]), np.uint8)
        able = 100 * np.bincount(owner, minlength=len(names)) >= percent * sizes
        keep = able[owner]
        owner, token, level = owner[keep], token[keep], level[keep]
        order = np.lexsort((token, level, owner))
        owner, token = owner[order], token[order]
        held = np.flatnonzero(able)
        many = np.bincount(owner, minlength=len(names))[held]
        row = np.searchsorted(held, owner)
        sig = np.bincount(row * RANGES + (token >> np.uint64(64 - RANGE_BITS)).astype(np.int64), minlength=RANGES * len(held))
        columns = [
            pa.array([names[i].tobytes() for i in held], pa.binary()),
            pa.array(sizes[held].astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(token.view(np.int64))),
            pa.ListArray.from_arrays(pa.array(np.arange(0, RANGES * len(held) + 1, RANGES), pa.int32()), pa.array(sig.astype(np.int32))),
        ]
        return pa.Table.from_arrays(columns, ["cls", "n", "tokens", "sig"])

    return parts.groupBy("group").applyInArrow(ordered, "cls binary, n long, tokens array<long>, sig array<int>")


def prefixes(feats: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, cls, n, own, pos, indexed): places of the prefix that are shared; ``indexed`` ones suffice for the smaller side."""
    rows = feats.select("cls", "n", "tokens", (F.col("n") - F.size("tokens")).alias("own"))
    prefix = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    index = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    taken = F.slice("tokens", 1, F.greatest(prefix - F.col("own"), F.lit(0)).cast("int"))
    opened = rows.select("cls", "n", "own", index.alias("index"), F.posexplode(taken).alias("at", "token"))
    pos = F.col("own") + F.col("at")
    return opened.select("token", "cls", "n", "own", pos.alias("pos"), (pos < F.col("index")).alias("indexed"))


def may_link(x: str, y: str, percent: int = PERCENT) -> str:
    """Length and positional filters for entries ``x`` and ``y`` of one token, the smaller of which must be indexed."""
    smaller = f"({x}.n < {y}.n or ({x}.n = {y}.n and {x}.cls < {y}.cls))"
    return (
        f"{x}.cls <> {y}.cls and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
        f" and if({smaller}, {x}.indexed, {y}.indexed) and least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need(f'{x}.n', f'{y}.n', percent)}"
    )


def need(n_x: str, n_y: str, percent: int = PERCENT) -> str:
    """Overlap that sets of these sizes must have."""
    return f"({percent} * ({n_x} + {n_y}) + {99 + percent}) div {100 + percent}"


def bound(sig_x: str, sig_y: str) -> str:
    """Suffix filter: the overlap is at most the sum over ranges of the hash of the smaller number of shingles."""
    return f"aggregate(zip_with({sig_x}, {sig_y}, (p, q) -> least(p, q)), 0, (s, v) -> s + v)"


def pair(x: str, y: str) -> list:
    smaller = F.col(f"{x}.cls") < F.col(f"{y}.cls")
    size = lambda a, b: F.when(smaller, F.col(f"{a}.n")).otherwise(F.col(f"{b}.n"))
    return [F.least(f"{x}.cls", f"{y}.cls").alias("a"), F.greatest(f"{x}.cls", f"{y}.cls").alias("b"), size(x, y).alias("n_a"), size(y, x).alias("n_b")]


def links(feats: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold; ``pairs`` has their sizes too."""
    side = lambda c: feats.select(F.col("cls").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return whole.withColumn("o", overlap).where(100 * F.col("o") >= percent * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of a link (a, b)."""
    return joined(links).withColumnRenamed("component", "label")


def class_components(feats: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label) of the classes that link with others."""
    entries = materialize(prefixes(feats, percent), "jaccard-entries")
    sigs = feats.select("cls", "sig")
    # what others were copied from has the fewest shingles of its own
    hub = F.min_by(F.struct("cls", "n", "pos", "indexed"), F.struct("own", F.xxhash64("cls")))
    hubs = entries.groupBy("token").agg(hub.alias("h"), F.count("*").alias("k")).where("k > 1").select("token", "h.*")
    first = entries.alias("x").join(hubs.alias("y"), "token").where(may_link("x", "y", percent)).select(*pair("x", "y")).distinct()
    side = lambda c: sigs.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}"))
    first = first.join(side("a"), "a").join(side("b"), "b").where(f"{bound('sig_a', 'sig_b')} >= {need('n_a', 'n_b', percent)}")
    first = materialize(first.select("a", "b", "n_a", "n_b"), "jaccard-hub-pairs")
    linked = materialize(links(feats, first, percent), "jaccard-links")
    label = components(linked)
    # a shingle now pairs only classes of different components
    entries = entries.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    groups = entries.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels"))
    mixed = entries.join(groups.where("labels > 1").select("token", "most"), "token")
    mixed = materialize(mixed.join(sigs, "cls"), "jaccard-mixed")
    few = mixed.where("label <> most")
    once = "x.label <> y.label and (y.label = y.most or x.cls < y.cls)"
    near = f"{bound('x.sig', 'y.sig')} >= {need('x.n', 'y.n', percent)}"
    rest = few.alias("x").join(mixed.alias("y"), "token").where(f"{once} and {may_link('x', 'y', percent)} and {near}").select(*pair("x", "y")).distinct()
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    return components(linked.union(links(feats, rest, percent)))


def labelled(rows: DataFrame, percent: int = PERCENT, bucket_tokens: int = BUCKET_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print, n, cls) of every row of (doc_id, text, print), and (cls, label, rep) of every class."""
    described = materialize(sets_of(rows), "jaccard-sets")
    sets = described.where("hot is null").select("doc_id", "print", "n", "cls")
    classes = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    total = classes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    hot = hot_shingles(described, total["k"])
    buckets = max(1, -(-(total["n"] or 0) // bucket_tokens))
    parts = shared_shingles(dealt(rows, buckets, hot), buckets).unionByName(class_sizes(classes, buckets))
    feats = materialize(features(parts, percent), "jaccard-features")
    label = class_components(feats, percent)
    named = classes.select("cls", "rep").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return sets, named


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("print"))
    sets, named = labelled(rows, percent, bucket_tokens)
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(ids, "label").select("cls", "component_id")
    out = sets.join(found, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which no other row of their component has a smaller id (or, with an equal id, a smaller digest).

    Of rows with one id and one text, one stays. Rows with a null id and rows without words stay.
    """
    key = F.md5(F.col("text").cast("string"))
    sets, named = labelled(docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("print")))
    rows = sets.where("cls is not null and doc_id is not null").join(named.select("cls", "label"), "cls")
    rows = materialize(rows.groupBy("label", "doc_id", "print").agg(F.count("*").alias("copies")), "jaccard-found")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.count("*").alias("members"))
    gone = join_hot(rows, first, "label", "members").where(F.struct("doc_id", "print") != F.col("first")).select("doc_id", "print")
    marked = docs.withColumn("_print", key)
    on = lambda df: [marked["doc_id"] == df["doc_id"], marked["_print"] == df["print"]]
    # texts move once to meet what goes, at any size, and are not sorted
    gone = materialize(gone.distinct(), "jaccard-gone").hint("shuffle_hash")
    kept = marked.join(gone, on(gone), "left_anti")
    again = rows.where("copies > 1").select(F.col("doc_id").alias("_id"), F.col("print").alias("_again"))
    if again.isEmpty():
        return kept.select(docs.columns)
    met = [kept["doc_id"] == again["_id"], kept["_print"] == again["_again"]]
    twice = kept.join(again, met, "left_semi")
    order = F.xxhash64(*(F.col(c) for c in docs.columns))
    whole = twice.groupBy("doc_id", "_print").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.join(again, met, "left_anti").select(docs.columns).union(whole)
