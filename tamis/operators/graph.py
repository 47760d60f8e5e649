"""Connected components and complete-linkage grouping of an edge table."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rank import numbered


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for an edge table ``(a, b)``; the label is the smallest node.

    Min-label propagation with pointer jumping, so long chains take a logarithmic number of rounds.
    """
    ends = materialize(
        edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select(F.col("e.a").alias("node"), F.col("e.b").alias("peer")),
        "ends",
    )
    labels = materialize(
        ends.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels",
    )
    while True:
        peers = (
            ends.join(labels.withColumnRenamed("node", "peer"), "peer")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(peers, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = materialize(
            step.join(hop, "component", "left").select(
                "node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels


# ---- complete linkage -----------------------------------------------------------------------------
#
# Edges come in two forms. Listed ones are rows. Those of a family are not listed: a family is a set of nodes on
# several boards, in which every two nodes of different boards are an edge. A listed edge inside a family across
# its boards only says that the pair ranks earlier.
#
# Work on listed edges is a table of edges between groups: a, b, sizes sa and sb, places in families ha and hb (family,
# board and number of nodes), cnt (listed edges that no family implies), and the number of the best edge between the two:
# twice its place in the order, plus one if it is late.

_HIST = "array<struct<fam: bigint, board: bigint, n: bigint>>"
_EARLY = "best % 2 = 0"


def _implied(ha: str, hb: str) -> Column:
    """How many edges the families imply between two groups."""
    return F.expr(f"aggregate({ha}, 0L, (s, x) -> s + x.n * aggregate(filter({hb}, y -> y.fam = x.fam and y.board <> x.board), 0L, (t, y) -> t + y.n))")


def _complete() -> Column:
    return F.col("cnt") + _implied("ha", "hb") == F.col("sa") * F.col("sb")


def _marked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges, written once, and ``(best)`` of those that are the best one left at both of their ends.

    An edge is told by its number, so what is grouped here are numbers of nodes and edges, never whole edges.
    """
    edges = materialize(edges, "edges")
    best = edges.select("best", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.min("best").alias("best"))
    top = best.groupBy("best").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("best")
    return edges, materialize(top, "top")


def _contract(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """The edges between the groups after ``moves`` (node, grp, size, hist).

    An edge between two groups lives on only while all of their cross pairs are edges; groups only grow, so a
    dead edge never comes back.
    """

    def relabel(df: DataFrame, end: str) -> DataFrame:
        m = moves.select(F.col("node").alias(end), F.col("grp").alias(f"g{end}"), F.col("size").alias("_s"), F.col("hist").alias("_h"))
        return df.join(m, end, "left").withColumns({f"s{end}": F.coalesce("_s", f"s{end}"), f"h{end}": F.coalesce("_h", f"h{end}")}).drop("_s", "_h")

    moved = relabel(relabel(edges, "a"), "b")
    # edges of two nodes that stay meet no other: they are kept as they are, and only the others move
    still = moved.filter("ga is null and gb is null").select(*edges.columns)
    moved = moved.filter("ga is not null or gb is not null").withColumns({"ga": F.coalesce("ga", "a"), "gb": F.coalesce("gb", "b")}).filter("ga <> gb")
    low_first = F.col("ga") < F.col("gb")
    pick = lambda x, y: F.when(low_first, F.col(x)).otherwise(F.col(y))
    left = (
        moved.select(
            F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b"),
            pick("sa", "sb").alias("sa"), pick("sb", "sa").alias("sb"),
            pick("ha", "hb").alias("ha"), pick("hb", "ha").alias("hb"), "cnt", "best",
        )
        .groupBy("a", "b")
        .agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.first("ha").alias("ha"), F.first("hb").alias("hb"), F.sum("cnt").alias("cnt"), F.min("best").alias("best"))
    )
    return still.unionByName(left.filter(_complete()))


def _rounds(edges: DataFrame, steps: list[DataFrame], early: bool = False, most: int | None = None) -> DataFrame:
    """Merge every edge that is the best one left at both of its ends, until none is left (``early``: none that is not late) or ``most`` times.

    The merges of a round do not touch each other, and nothing better can come before any of them, so the groups
    are those of one edge at a time.
    """
    taken = 0
    while most is None or taken < most:
        taken += 1
        edges, top = _marked(edges)
        if early:
            top = top.filter(_EARLY)
        if top.isEmpty():
            return edges
        chosen = edges.join(top, "best", "left_semi")
        moves = chosen.select((F.col("sa") + F.col("sb")).alias("size"), F.concat("ha", "hb").alias("hist"), F.least("a", "b").alias("grp"), F.explode(F.array("a", "b")).alias("node"))
        moves = materialize(moves, "moves")
        steps.append(moves.select("node", "grp"))
        edges = _contract(edges, moves)
    return edges


LOCAL = 1 << 19  # listed edges of a component that one task merges: some 200 MB

_WORK = f"a long, b long, sa long, sb long, ha {_HIST}, hb {_HIST}, cnt long, best long"
_HELD = pa.list_(pa.struct([("fam", pa.int64()), ("board", pa.int64()), ("n", pa.int64())]))


def _merged(early: bool):
    """Merge the edges of one component in their order, one at a time; ``early`` stops at the first that is late.

    Returns the edges that are left, and a row without ``best`` for each node that moved: ``a`` is the node and ``b`` its group.
    """

    def implied(x: dict, y: dict) -> int:
        return sum(sum(x[f].values()) * sum(y[f].values()) - sum(n * y[f].get(board, 0) for board, n in x[f].items()) for f in x.keys() & y.keys())

    def merge(group: pa.Table) -> pa.Table:
        a, b, best = (group[c].to_numpy() for c in ("a", "b", "best"))
        nodes, first = np.unique(np.concatenate([a, b]), return_index=True)
        states = zip(nodes.tolist(), *(pa.chunked_array([*group[f"{c}a"].chunks, *group[f"{c}b"].chunks]).take(pa.array(first)).to_pylist() for c in "sh"))
        size, held = {}, {}
        for node, s, hist in states:
            size[node], held[node] = s, {}
            for h in hist:
                boards = held[node].setdefault(h["fam"], {})
                boards[h["board"]] = boards.get(h["board"], 0) + h["n"]
        near: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        for x, y, k, c in zip(a.tolist(), b.tolist(), best.tolist(), group["cnt"].to_pylist()):
            near[x][y] = near[y][x] = (k, c)
        into: dict[int, int] = {}

        def at(node: int) -> int:
            while node in into:
                into[node] = node = into.get(into[node], into[node])
            return node

        for i in np.argsort(best).tolist():
            if early and best[i] % 2:
                break
            x, y = sorted((at(int(a[i])), at(int(b[i]))))
            if x == y or y not in near[x]:
                continue
            mine, theirs = near.pop(x), near.pop(y)
            into[y] = x
            size[x] += size.pop(y)
            for fam, boards in held.pop(y).items():
                both = held[x].setdefault(fam, {})
                for board, n in boards.items():
                    both[board] = both.get(board, 0) + n
            for node in (mine.keys() | theirs.keys()) - {x, y}:
                links = [links[node] for links in (mine, theirs) if node in links]
                near[node].pop(x, None)
                near[node].pop(y, None)
                k, c = min(k for k, _ in links), sum(c for _, c in links)
                if c + implied(held[x], held[node]) == size[x] * size[node]:
                    near[x][node] = near[node][x] = (k, c)
        told = {x: [{"fam": f, "board": board, "n": n} for f, boards in held[x].items() for board, n in boards.items()] for x in size}
        left = [(x, y, size[x], size[y], told[x], told[y], c, k) for x, links in near.items() for y, (k, c) in links.items() if x < y]
        left += [(node, at(node), None, None, None, None, None, None) for node in into]
        kinds = dict(zip("a b sa sb ha hb cnt best".split(), [pa.int64()] * 4 + [_HELD] * 2 + [pa.int64()] * 2))
        columns = list(zip(*left)) or [()] * len(kinds)
        return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(kinds.items(), columns)})

    return merge


def _by_component(edges: DataFrame, places: DataFrame, steps: list[DataFrame], early: bool = False) -> DataFrame:
    """:func:`_rounds`, but for components (``places``: node, component) of up to ``LOCAL`` edges, which are merged by a task each."""
    placed = materialize(edges.join(places.withColumnRenamed("node", "a"), "a"), "placed")
    large = materialize(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LOCAL).select("component"), "large")
    merged = placed.join(large, "component", "left_anti").groupBy("component").applyInArrow(_merged(early), _WORK)
    merged = materialize(merged, "merged")
    steps.append(merged.filter("best is null").select(F.col("a").alias("node"), F.col("b").alias("grp")))
    left = merged.filter("best is not null")
    if large.isEmpty():
        return left
    return left.unionByName(_rounds(placed.join(large, "component", "left_semi").select(*edges.columns), steps, early))


def _cliques(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, grp)`` of nodes whose neighbours, themselves included, are the same set for all of this set.

    Such a set merges to one group in whatever order. Sets are compared by size and two sums of 64-bit hashes; what a family
    implies is added up per family and board, and listed edges that it implies are not counted again.
    """
    names = {f"s{i}": F.xxhash64(F.lit(i), "node").cast("decimal(38,0)") for i in (1, 2)} | {"k": F.lit(1).cast("decimal(38,0)")}
    total = lambda prefix="": [F.sum(c).alias(f"{prefix}{c}") for c in names]
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("node"), "cnt"), F.struct(F.col("b").alias("at"), F.col("a").alias("node"), "cnt"))).alias("e")).select("e.*")
    listed = both.filter("cnt = 1").select(F.col("at").alias("of"), *[v.alias(c) for c, v in names.items()])
    hashed = members.select("node", "fam", "board", *[v.alias(c) for c, v in names.items()])
    boards = hashed.groupBy("fam", "board").agg(*total("b_"))
    families = boards.groupBy("fam").agg(*[F.sum(f"b_{c}").alias(f"f_{c}") for c in names])
    implied = hashed.select("node", "fam", "board").join(boards, ["fam", "board"]).join(families, "fam")
    implied = implied.select(F.col("node").alias("of"), *[(F.col(f"f_{c}") - F.col(f"b_{c}")).alias(c) for c in names])
    nodes = both.select(F.col("at").alias("node")).unionByName(members.select("node")).distinct()
    own = nodes.select(F.col("node").alias("of"), *[v.alias(c) for c, v in names.items()])
    around = own.unionByName(listed).unionByName(implied).groupBy("of").agg(*total())
    sets = around.groupBy(*names).agg(F.min("of").alias("grp"), F.count(F.lit(1)).alias("n")).filter("n = k and n > 1").select(*names, "grp")
    return materialize(around.join(sets, list(names)).select(F.col("of").alias("node"), "grp"), "cliques")


def _first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Place each item of a family, in order, into the first slot that has none of its boards.

    Only the open slots of one family are held, as numbers. Nodes that share a key are edges even on one board, so an item
    whose nodes on a board all share a key also fits a slot whose nodes on that board share the same one.
    """
    fam, full, slots = None, 0, 0
    open_: dict[int, list[int]] = defaultdict(list)  # boards taken -> slots
    taken: dict[int, int] = {}  # slot -> boards
    keys: dict[int, dict[int, int | None]] = {}  # slot -> board -> the key that all nodes there share
    holding: dict[int, list[int]] = defaultdict(list)  # key -> slots

    for pdf in batches:
        out = []
        for f, boards, all_boards, shared in zip(pdf["fam"].tolist(), pdf["mask"].tolist(), pdf["full"].tolist(), pdf["shared"].tolist()):
            if f != fam:
                fam, full, slots = f, all_boards, 0
                open_, taken, keys, holding = defaultdict(list), {}, {}, defaultdict(list)
            mine = {int(s["board"]): (None if s["key"] is None else int(s["key"])) for s in shared}
            best = None
            for mask in [m for m, q in open_.items() if q and not m & boards]:
                if best is None or open_[mask][0] < best:
                    best = open_[mask][0]
            for key in set(mine.values()) - {None}:
                for slot in holding[key]:
                    both = taken[slot] & boards
                    theirs = keys[slot]
                    if both and (best is None or slot < best) and all(
                        mine.get(b) is not None and mine.get(b) == theirs.get(b) for b in range(both.bit_length()) if both >> b & 1
                    ):
                        best = slot
            if best is None:
                slots += 1
                best, before = slots, 0
            else:
                before = taken[best]
                if before != full:
                    heappop(open_[before]) if open_[before][0] == best else open_[before].remove(best)
            taken[best] = before | boards
            if taken[best] != full:
                heappush(open_[taken[best]], best)
            place = keys.setdefault(best, {})
            for b in range(boards.bit_length()):
                if boards >> b & 1:
                    place[b] = mine.get(b) if not before >> b & 1 or place.get(b) == mine.get(b) else None
            for key in set(mine.values()) - {None}:
                if best not in holding[key]:
                    holding[key].append(best)
            out.append(best)
        yield pd.DataFrame({"grp": pdf["grp"], "fam": pdf["fam"], "slot": out})


def _line_up(members: DataFrame, place: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Merges of all edges that only families imply, as ``moves``.

    Groups that lie wholly in a family merge in the order of their first nodes: each takes the first place in a row of slots
    that holds none of its boards. Where every group has one board (or all of them), the k-th group of each board takes the
    k-th free slot, so places are plain numbers, found without a task that holds a family. Only a family in which some
    groups have several boards but not all, or in which nodes of one board share a key, is walked through in order.
    """
    at = _follow(members.select("node").unionByName(place).distinct(), steps)
    sizes = at.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    tagged = members.join(at, "node")
    per_board = tagged.groupBy("grp", "fam", "board", "bit", "full").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("neg", "node")).alias("first"),
        F.count("key").alias("keyed"), F.min("key").alias("low"), F.max("key").alias("high"),
    )
    one_key = F.when((F.col("keyed") == F.col("n")) & (F.col("low") == F.col("high")), F.col("low"))
    items = (
        per_board.groupBy("grp")
        .agg(
            F.min("fam").alias("fam"), F.max("fam").alias("_f"), F.max("full").alias("full"), F.sum("n").alias("n"), F.min("first").alias("first"),
            F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"),
            F.collect_list(F.struct(F.col("bit").alias("board"), one_key.alias("key"))).alias("shared"),
            F.collect_list(F.struct("fam", "board", "n")).alias("hist"),
        )
        .join(sizes, "grp")
        .filter("fam = _f and n = size")
        .drop("_f", "n")
    )
    items = materialize(items, "items")
    # families with nodes of one board that share a key, or with groups of several boards but not all
    twice = tagged.filter("key is not null").groupBy("fam", "board", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fam")
    partly = items.filter("mask <> full and bit_count(mask) > 1").select("fam")
    uneven = materialize(twice.union(partly).distinct(), "uneven")
    single = items.filter("bit_count(mask) = 1").join(uneven, "fam", "left_anti")
    single = numbered(single.select("grp", "fam", "mask", F.col("first.neg").alias("neg"), F.col("first.node").alias("node")), ["fam", "mask"], ["neg", "node"], "slot")
    walked = items.join(uneven, "fam", "left_semi")
    walked = walked.repartition("fam").sortWithinPartitions("fam", "first").select("grp", "fam", "mask", "full", "shared")
    slots = single.select("grp", "fam", "slot").unionByName(walked.mapInPandas(_first_fit, "grp long, fam long, slot long"))
    slots = slots.join(items.select("grp", "size", "hist", "first"), "grp")
    merged = slots.groupBy("fam", "slot").agg(
        F.min("grp").alias("to"), F.sum("size").alias("size"), F.flatten(F.collect_list("hist")).alias("hist"), F.collect_list("grp").alias("from")
    )
    moves = merged.filter(F.size("from") > 1).select(F.col("to").alias("grp"), "size", "hist", F.explode("from").alias("node"))
    return materialize(moves, "moves")


def complete_linkage(edges: DataFrame, members: DataFrame | None = None, later: str = "best.o = 0") -> DataFrame:
    """``(node, grp)``: groups of nodes in which every pair is an edge, merged best edge first.

    ``edges`` holds ``a, b`` (longs) and ``best``, a struct that orders all edges strictly. ``members`` holds
    the nodes of families: ``node, fam, board`` (longs), ``bit`` (number of the board in its family), ``full`` (the bits of all
    boards), ``neg`` (rank, with the node) and ``key`` (NULL, or a value that makes nodes of a board edges). Edges
    that only a family implies come after the listed ones that are not ``later``, before all others of their nodes, and in
    the order of the lower and the higher rank. Nodes without an edge do not appear.

    One round over tables merges every edge that is the best at both ends. What is left of listed edges and families falls into
    components, whose order does not touch others: those of up to ``LOCAL`` listed edges are merged
    by one task each. In larger ones all work is done on tables, in rounds of merges that are the best at both ends; a round costs a
    few joins on what is left of the edges. Families are numbered as tables, between the edges that come before and after theirs.
    """
    if members is None:
        members = edges.sparkSession.createDataFrame([], "node long, fam long, board long, bit int, full long, neg double, key long")
    held = members.select("node", "fam", "board")
    # the order is asked for in every round: edges are numbered once, and only numbers go on
    work = numbered(edges.select("a", "b", F.expr(later).alias("late"), "best"), [], ["best"])
    work = work.select("a", "b", (F.col("place") * 2 + F.col("late").cast("long")).alias("best"))
    for end in "ab":
        side = held.select(F.col("node").alias(end), F.col("fam").alias(f"f{end}"), F.col("board").alias(f"b{end}"))
        work = work.join(side, end, "left")
    one, none = F.lit(1).cast("long"), F.array().cast(_HIST)
    hist = lambda e: F.when(F.col(f"f{e}").isNotNull(), F.array(F.struct(F.col(f"f{e}").alias("fam"), F.col(f"b{e}").alias("board"), one.alias("n")))).otherwise(none)
    implied = F.coalesce((F.col("fa") == F.col("fb")) & (F.col("ba") != F.col("bb")), F.lit(False))
    work = materialize(
        work.select("a", "b", one.alias("sa"), one.alias("sb"), hist("a").alias("ha"), hist("b").alias("hb"), F.when(implied, 0).otherwise(1).cast("long").alias("cnt"), "best"),
        "listed",
    )
    listed = work.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = _cliques(work, members)
    steps: list[DataFrame] = [whole]
    # a whole set has no edge to others
    work = materialize(work.join(whole.select(F.col("node").alias("a")), "a", "left_anti"), "listed")
    joined = work.select("a", "b").unionByName(members.filter("node <> fam").select(F.col("node").alias("a"), F.col("fam").alias("b")))
    places = components(joined)
    # the first round merges the most by far; those that follow are longer and longer chains
    work = _by_component(_rounds(work, steps, early=True, most=1), places, steps, early=True)
    moves = _line_up(members.join(whole.select("node"), "node", "left_anti"), listed, steps)
    if not moves.isEmpty():
        steps.append(moves.select("node", "grp"))
        work = _contract(work, moves)
    _by_component(work, places, steps)
    return _follow(listed.unionByName(members.select("node")).distinct(), steps)


def _follow(nodes: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Compose the successive relabellings into one map from node to final group."""
    out = nodes.withColumn("grp", F.col("node"))
    for i, step in enumerate(steps):
        s = step.select(F.col("node").alias("grp"), F.col("grp").alias("_to"))
        out = out.join(s, "grp", "left").select("node", F.coalesce("_to", "grp").alias("grp"))
        if i % 4 == 3:
            out = materialize(out, "groups")
    return out
