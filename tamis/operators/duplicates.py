"""Which postings are the same vacancy: features, candidate pairs by exact blocking, groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import keys as K
from ..session import materialize
from .graph import complete_linkage


@dataclass(frozen=True)
class Thresholds:
    # --- fixed values: shares of shared text that decide, and what counts as boilerplate ----------
    cross_text: float = 0.1
    text_only: float = 0.5
    same_board_text: float = 0.3
    max_shingle_df: int = 5
    min_shingles: int = 20


# ---- features -----------------------------------------------------------------------------------


def shingle_frequency(texts: DataFrame) -> DataFrame:
    """``(shingle, n)``: in how many rows of ``(id, shingles)`` each shingle occurs.

    Most shingles are rare, so they are dealt out before they are counted: counting on both sides would hold, and spill, nearly
    all of them twice. A row holds a shingle once, so the most frequent one brings no more rows than the table has.
    """
    found = texts.select(F.explode("shingles").alias("shingle"))
    return found.repartition("shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


RUN = 1 << 18  # rows that one step of :func:`_mates` looks at


def _mates(max_df: int):
    """For rows ``(h, g, id, company)`` in the order of their shingles: ``(a, b)`` of rows with one shingle, and ``(a, NULL)`` for each.

    Shingles of more than ``max_df`` rows give none; ``a`` and ``b`` are of related companies, the smaller id first. Rows stream by
    in steps; a shingle that goes on beyond a step is carried over by its first ``max_df + 1`` rows, so frequent ones are never held.
    """

    def related(names: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As :func:`keys.same_company`, asked once per pair of names."""
        pairs, at = np.unique(x.astype(np.int64) * len(names) + y, return_inverse=True)
        sides = [(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()]
        return np.array([bool(c and d and (c.startswith(d) or d.startswith(c))) for c, d in sides], bool)[at]

    def found(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        h, g = rows["h"].to_numpy(), rows["g"].to_numpy()
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        start = np.flatnonzero(new)
        end = len(h) if last else start[-1]  # the last shingle may go on
        rest = rows.slice(end, max_df + 1)
        run = np.cumsum(new) - 1
        size = np.diff(np.append(start, len(h)))[run]
        kept = (size <= max_df) & (np.arange(len(h)) < end)
        ids = rows["id"].to_numpy()
        company = rows["company"].combine_chunks().dictionary_encode()
        company = company.combine_chunks() if isinstance(company, pa.ChunkedArray) else company
        names, codes = company.dictionary.to_pylist(), company.indices.fill_null(0).to_numpy(zero_copy_only=False)
        known = ~rows["company"].is_null().to_numpy()
        own = ids[kept]
        out = [pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.nulls(len(own), pa.int64())], ["a", "b"])]
        for step in range(1, max_df):
            x = np.flatnonzero(kept[:-step] & (run[:-step] == run[step:]) & known[:-step] & known[step:])
            x = x[related(names, codes[x], codes[x + step])] if len(x) else x
            a, b = ids[x], ids[x + step]
            out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"]))
        return out, rest

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= RUN:
                out, rest = found(pa.Table.from_batches(held), False)
                yield from out
                held, n = rest.to_batches(), len(rest)
        if n:
            yield from found(pa.Table.from_batches(held), True)[0]

    return mates


def shared_shingles(texts: DataFrame, max_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """Kept shingles per row and shared shingles per pair of rows with related companies.

    ``texts`` holds ``id, company, shingles``, the shingles best as hashes ``(h, g)``. Shingles found in more than ``max_df`` rows are
    dropped as boilerplate. Returns ``(id, n_kept)`` of the rows that keep any, and ``(a, b, shared)``, ``a < b``. Every shingle
    moves once, and is met with the few next to it as sorted rows stream by. What leaves that step are counts, and as a kept
    shingle lives in at most ``max_df`` rows, they grow linearly with the text.
    """
    found = texts.select(F.col("id").cast("long").alias("id"), "company", F.explode("shingles").alias("s"))
    hashed = isinstance(found.schema["s"].dataType, StructType)
    found = found.select(*(["s.h", "s.g"] if hashed else [F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), "s").alias("g")]), "id", "company")
    seen = found.repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(_mates(max_df), "a long, b long")
    counts = materialize(seen.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), "shared")
    kept = counts.filter("b is null").select(F.col("a").alias("id"), F.col("shared").alias("n_kept"))
    return kept, counts.filter("b is not null")


def company_prefixes(companies: DataFrame) -> DataFrame:
    """``(company, prefix)``: the keys that a key starts with, itself included.

    Every key is cut into its prefixes and joined on equality; no key is compared with all others, and a key
    has at most as many rows as letters.
    """
    names = companies.select("company").filter("company <> ''").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("company")), lambda n: F.left(F.col("company"), n))
    heads = names.select("company", F.explode(cut).alias("prefix"))
    return heads.join(names.withColumnRenamed("company", "prefix"), "prefix", "left_semi").select("company", "prefix")


def company_links(companies: DataFrame) -> DataFrame:
    """``(company, other)`` for keys where one starts with the other, in both directions, itself included."""
    up = company_prefixes(companies)
    down = up.filter("company <> prefix").select(F.col("prefix").alias("company"), F.col("company").alias("prefix"))
    return up.unionByName(down).withColumnRenamed("prefix", "other")


def posting_features(df: DataFrame, t: Thresholds) -> tuple[DataFrame, DataFrame]:
    """One narrow row per posting, and the shared-shingle counts of pairs.

    ``id`` is the ingest sequence. ``(-score, id)`` is the completeness rank, and ``lead_*`` the best
    rank inside the company, both carried as values so that nothing is numbered globally.
    """
    base = materialize(
        df.select(
            F.col("ingest_seq").alias("id"),
            (-K.completeness(F.col("salary_min"), F.col("salary_max"), F.col("description"), F.col("skills"))).cast("double").alias("neg"),
            "url",
            K.url_key("url").alias("url_key"),
            "source",
            K.company_key("company").alias("company"),
            K.title_words("title").alias("words"),
            K.title_head("title").alias("head"),
        ),
        "base",
    )
    texts = df.select(F.col("ingest_seq").alias("id"), K.company_key("company").alias("company"), K.shingle_hashes("description").alias("shingles"))
    kept, shared = shared_shingles(texts, t.max_shingle_df)
    lead = base.groupBy("company").agg(F.min(F.struct("neg", "id")).alias("lead"))
    narrow = materialize(
        base.join(kept, "id", "left")
        .withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
        .join(lead, "company")
        .withColumn("has_text", F.col("n_kept") >= t.min_shingles)
        .withColumns({"lead_neg": F.col("lead.neg"), "lead_id": F.col("lead.id")})
        .drop("lead"),
        "narrow",
    )
    return materialize(_fold_twins(narrow), "features"), shared


def _fold_twins(rows: DataFrame) -> DataFrame:
    """Let one row stand for all that no rule can tell apart: ``node`` is its id.

    Without text of its own a posting is judged by company, board and title alone (unless its url key
    is shared), so equal ones are duplicates of each other and of exactly the same others, and nothing
    is more similar to them. Merging them first changes no group. Mass copies end up here, since text
    that many rows share is boilerplate.
    """
    with_key = rows.groupBy("url_key").agg(F.count(F.lit(1)).alias("_n"))
    shared_key = with_key.filter((F.col("_n") > 1) & F.col("url_key").isNotNull()).select("url_key", F.lit(True).alias("_shared"))
    marked = rows.join(shared_key, "url_key", "left")
    plain = (~F.col("has_text")) & F.col("_shared").isNull() & (F.size("words") > 0) & (F.col("company") != "")
    marked = marked.withColumn("plain", plain)
    # one text key per class; rows that stay alone get none and match nothing
    marked = marked.withColumn("_class", F.when(F.col("plain"), F.to_json(F.struct("company", "source", "words"))))
    heads = (
        marked.filter("plain").groupBy("_class").agg(F.min(F.struct("neg", "id")).getField("id").alias("_node"))
    )
    return marked.join(heads, "_class", "left").select(
        *rows.columns,
        F.coalesce("_node", "id").alias("node"),
        F.col("_shared").isNotNull().alias("key_shared"),
    )


# ---- candidate pairs ------------------------------------------------------------------------------


def _rarest_word(titles: DataFrame) -> DataFrame:
    """``(id, word)``: the title word that the fewest rows of the table have."""
    words = titles.select("id", F.explode("words").alias("word"))
    freq = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(freq.hint("merge"), "word").groupBy("id").agg(F.min(F.struct("n", "word")).getField("word").alias("word"))


def related(left: DataFrame, right: DataFrame, prefixes: DataFrame, key: str) -> DataFrame:
    """``(l, r)``: rows of both tables, as structs, with an equal ``key`` and related companies.

    The row with the longer company is repeated under the prefixes of its company, never the other way round,
    so a short name met by many others is not multiplied by them. Tables here come out of explodes, which the
    optimizer takes to be as small as what goes in; the hint keeps them from being broadcast.
    """

    def sided(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("company", key, F.struct(*[c for c in rows.columns if c != key]).alias(name))

    def under_prefixes(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(links, "company").drop("company").withColumnRenamed("prefix", "company")

    l_side, r_side = sided(left, "l"), sided(right, "r")
    met = under_prefixes(l_side, prefixes).join(r_side.hint("merge"), ["company", key])
    longer = under_prefixes(r_side, prefixes.filter("company <> prefix"))
    return met.unionByName(l_side.join(longer.hint("merge"), ["company", key])).select("l", "r")


def _pair(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _meet(left: DataFrame, right: DataFrame, prefixes: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Pairs of rows of related companies with an equal ``key``, as ``(a, b)`` with ``a < b``; only narrow rows move."""
    narrow = lambda rows: rows.select("id", "company", "source", key)
    met = related(narrow(left), narrow(right), prefixes, key).filter("l.id <> r.id")
    if keep is not None:
        met = met.filter(keep)
    return met.select(*_pair("l.id", "r.id"))


def _cross_board() -> Column:
    return ~F.col("l.source").eqNullSafe(F.col("r.source"))


def nested_titles(titled: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(a, b)``: rows of two boards, one of them without text, of which one title may hold all words of the other and more.

    Titles meet as classes (company, title, with text or without) on the rarest word of the smaller one. A class carries its
    words as 64 bits; bits that the larger title lacks rule a pair out before anything is moved. What is left is opened
    into rows, and the rule compares the words.
    """
    part = ["company", "title_key", "has_text"]
    bit = lambda bits, word: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int")))
    classes = titled.groupBy(*part).agg(F.min("id").alias("id"), F.first("words").alias("words"))
    classes = classes.withColumns({"size": F.size("words"), "bits": F.aggregate("words", F.lit(0).cast("long"), bit)})
    classes = materialize(classes, "title-classes")
    named = ["id", "company", "size", "bits", "word"]
    rarest = classes.join(_rarest_word(classes).hint("merge"), "id")
    spelled = classes.withColumn("word", F.explode("words"))
    may_hold = (F.col("l.size") < F.col("r.size")) & (F.col("l.bits").bitwiseAND(F.bitwise_not("r.bits")) == 0)
    met = [
        related(rarest.filter(small).select(*named), spelled.filter(large).select(*named), prefixes, "word").filter(may_hold)
        for small, large in (("not has_text", "true"), ("has_text", "not has_text"))
    ]
    found = materialize(met[0].unionByName(met[1]).select(F.col("l.id").alias("_l"), F.col("r.id").alias("_r")), "nested")
    rows = titled.join(classes.select(*part, F.col("id").alias("cls")), part).select("id", "source", "cls")
    for side in "lr":
        found = found.join(rows.select(F.struct("id", "source").alias(side), F.col("cls").alias(f"_{side}")).hint("merge"), f"_{side}")
    return found.filter(_cross_board()).select(*_pair("l.id", "r.id"))


def telling_text(shared: DataFrame, nodes: DataFrame, t: Thresholds) -> DataFrame:
    """The pairs of ``shared`` whose text the rule or the order of edges can ask for.

    Both rows have text enough, and they share the least of what any part of the rule asks for, or their titles or url keys are
    equal. Most pairs share a run of words or two and nothing else; they go here, on numbers alone.
    """
    side = lambda e: nodes.filter("has_text").select(
        F.col("id").alias(e), F.col("n_kept").alias(f"n{e}"), F.xxhash64("title_key").alias(f"t{e}"), F.when(F.col("key_shared"), F.xxhash64("url_key")).alias(f"k{e}")
    )
    least = min(t.cross_text, t.text_only, t.same_board_text)
    alike = (F.col("ta") == F.col("tb")) | F.coalesce(F.col("ka") == F.col("kb"), F.lit(False))
    both = shared.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.filter((F.col("shared") / F.least("na", "nb") >= least) | alike).select("a", "b", "shared")


def title_families(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Postings with text, of one company, with the same title words and on several boards, as members of families.

    Across boards any two of them are duplicates, whatever their texts, so grouping takes them as whole classes (company,
    board, title) and their pairs are never listed. Columns as in :func:`graph.complete_linkage`. A title that a
    related company also has stays with the listed pairs, as does one on more than 62 boards.
    """
    titled = nodes.filter(F.col("has_text") & (F.size("words") > 0)).withColumn("board_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    classes = titled.groupBy("company", "title_key", "board_key").agg(F.min("id").alias("board"))
    titles = classes.groupBy("company", "title_key").agg(F.min("board").alias("fam"), F.sort_array(F.collect_list("board_key")).alias("boards"))
    under = titles.select("company", "title_key").join(prefixes.filter("company <> prefix"), "company")
    pairs = under.join(titles.select(F.col("company").alias("prefix"), "title_key"), ["prefix", "title_key"])
    related = pairs.select(F.explode(F.array("company", "prefix")).alias("company"), "title_key").distinct()
    alone = titles.filter((F.size("boards") > 1) & (F.size("boards") <= 62)).join(related, ["company", "title_key"], "left_anti")
    placed = alone.select("company", "title_key", "fam", F.posexplode("boards").alias("bit", "board_key"), F.expr("shiftleft(1L, size(boards)) - 1").alias("full"))
    known = placed.join(classes, ["company", "title_key", "board_key"])
    key = F.when(F.col("key_shared"), F.xxhash64("url_key"))
    return titled.join(known, ["company", "title_key", "board_key"]).select(F.col("id").alias("node"), "fam", "board", "bit", "full", "neg", key.alias("key"))


def duplicate_candidates(nodes: DataFrame, shared: DataFrame, prefixes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``(a, b, shared)``: every pair the duplicate rule can accept, and few others.

    The rule accepts a pair only for an equal url key, for equal or nested titles where text cannot
    decide, or for shared text; each becomes an equality join. Rows of one family (``fam``, if not NULL) meet
    only by text or url key; as no related company has their title, no other row with text has it.
    """
    by_key = nodes.filter("key_shared")
    same_key = _meet(by_key, by_key, prefixes, "url_key")

    titled = nodes.filter(F.size("words") > 0)
    bare, loose = titled.filter("not has_text"), titled.filter("has_text and fam is null")
    same_words = _meet(bare, titled, prefixes, "title_key").unionByName(_meet(loose, loose, prefixes, "title_key", _cross_board()))

    blocks = same_key.unionByName(same_words).unionByName(nested_titles(titled, prefixes))
    return (
        blocks.withColumn("shared", F.lit(0).cast("long"))
        .unionByName(telling_text(shared, nodes, t))
        .groupBy("a", "b")
        .agg(F.max("shared").alias("shared"))
    )


def attach_pair(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Features of both sides of ``(a, b, shared)`` as structs ``x`` and ``y``."""
    side = features.select("id", F.struct(*[c for c in features.columns]).alias("f"))
    return pairs.join(side.select(F.col("id").alias("a"), F.col("f").alias("x")).hint("merge"), "a").join(
        side.select(F.col("id").alias("b"), F.col("f").alias("y")).hint("merge"), "b"
    )


def compare_titles(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """``pairs`` with ``equal_words``, ``fits``, ``equal_head`` and ``jaccard`` of the titles ``x.title`` and ``y.title``.

    ``titles`` holds ``title, words, head``. Words are attached and compared once per pair of titles, not per pair of rows.
    """
    named = pairs.withColumns({"tx": F.least("x.title", "y.title"), "ty": F.greatest("x.title", "y.title")})
    side = titles.select("title", F.struct("words", "head").alias("f"))
    both = named.select("tx", "ty").distinct()
    for name, key in (("x", "tx"), ("y", "ty")):
        both = both.join(side.select(F.col("title").alias(key), F.col("f").alias(name)).hint("merge"), key)
    x, y = F.col("x"), F.col("y")
    both = both.select(
        "tx", "ty",
        ((F.size(x["words"]) > 0) & (x["words"] == y["words"])).alias("equal_words"),
        K.titles_compatible(x["words"], y["words"]).alias("fits"),
        ((F.size(x["head"]) > 0) & (x["head"] == y["head"])).alias("equal_head"),
        jaccard().alias("jaccard"),
    )
    return named.join(both.hint("merge"), ["tx", "ty"]).drop("tx", "ty")


def overlap(t: Thresholds) -> Column:
    """Share of the shorter text found in the longer one; NULL when either is too short to tell."""
    shorter = F.least("x.n_kept", "y.n_kept")
    return F.when(shorter >= t.min_shingles, F.col("shared") / shorter)


def jaccard() -> Column:
    both = F.size(F.array_union("x.words", "y.words"))
    return F.size(F.array_intersect("x.words", "y.words")) / F.greatest(both, F.lit(1))


def is_duplicate(t: Thresholds) -> Column:
    """The duplicate rule over ``x``, ``y``, ``overlap`` and what :func:`compare_titles` says."""
    x, y, ov = F.col("x"), F.col("y"), F.col("overlap")
    equal_words, fits, equal_head = F.col("equal_words"), F.col("fits"), F.col("equal_head")
    across = F.when(equal_words, True).when(ov.isNull(), fits).otherwise(
        ((fits | equal_head) & (ov >= t.cross_text)) | (ov >= t.text_only)
    )
    within = F.when(ov.isNull(), equal_words).otherwise(fits & (ov >= t.same_board_text))
    return (
        F.when(F.coalesce(x["url_key"] == y["url_key"], F.lit(False)), True)
        .when(x["source"].eqNullSafe(y["source"]), within)
        .otherwise(across)
    )


def _nodes(features: DataFrame) -> DataFrame:
    return features.filter("id = node and company <> ''").withColumn("title_key", F.md5(F.array_join("words", " ")))


def duplicate_edges(features: DataFrame, shared: DataFrame, t: Thresholds = Thresholds(), families: DataFrame | None = None) -> DataFrame:
    """``(a, b, overlap, jaccard, best)`` between nodes; ``best`` orders edges as they are merged.

    Most shared text first, then the most similar titles; ties by company lead rank and then by the
    completeness ranks of the two rows, the row of the earlier company first. Pairs that ``families`` imply
    are listed only if they share text.
    """
    nodes = _nodes(features)
    prefixes = company_prefixes(nodes)
    if families is None:
        nodes = nodes.withColumn("fam", F.lit(None).cast("long"))
    else:
        nodes = nodes.join(families.select(F.col("node").alias("id"), "fam"), "id", "left")
    spelled = nodes.withColumn("_title", F.md5(F.to_json(F.struct("words", "head"))))
    titles = spelled.groupBy("_title").agg(F.min("id").alias("title"), F.first("words").alias("words"), F.first("head").alias("head"))
    titles = materialize(titles, "titles")
    key = F.when(F.col("key_shared"), F.col("url_key")).alias("url_key")  # others meet no equal one
    sides = spelled.join(titles.select("_title", "title"), "_title").select("id", "company", "source", key, "n_kept", "neg", "lead_neg", "lead_id", "title")
    met = attach_pair(duplicate_candidates(nodes, shared, prefixes, t), materialize(sides, "sides")).filter(K.same_company(F.col("x.company"), F.col("y.company")))
    met = materialize(met.withColumn("overlap", overlap(t)), "met")
    judged = compare_titles(met, titles).filter(is_duplicate(t))
    lead = {s: F.struct(F.col(f"{s}.lead_neg").alias("neg"), F.col(f"{s}.lead_id").alias("id")) for s in "xy"}
    rank = {s: F.struct(F.col(f"{s}.neg").alias("neg"), F.col(f"{s}.id").alias("id")) for s in "xy"}
    x_first = (lead["x"] < lead["y"]) | ((lead["x"] == lead["y"]) & (rank["x"] < rank["y"]))
    ov = F.coalesce("overlap", F.lit(0.0))
    return judged.select(
        "a",
        "b",
        ov.alias("overlap"),
        "jaccard",
        F.struct(
            (-ov).alias("o"),
            (-F.col("jaccard")).alias("j"),
            F.least(lead["x"], lead["y"]).alias("p"),
            F.greatest(lead["x"], lead["y"]).alias("q"),
            F.when(x_first, rank["x"]).otherwise(rank["y"]).alias("r"),
            F.when(x_first, rank["y"]).otherwise(rank["x"]).alias("s"),
        ).alias("best"),
    )


# ---- groups ---------------------------------------------------------------------------------------


def duplicate_members(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``(ingest_seq, url, neg, kept_seq, kept_url)`` for every posting with a url of its own.

    The long form of the duplicate groups: one row per posting, so that a group may be of any size.
    """
    # the first row per url is picked on two narrow columns; wide rows move once, by their unique number
    firsts = df.groupBy("url").agg(F.min("ingest_seq").alias("ingest_seq")).select("ingest_seq")
    unique = df.join(firsts, "ingest_seq", "left_semi")
    features, shared = posting_features(unique, t)
    nodes = _nodes(features)
    families = materialize(title_families(nodes, company_prefixes(nodes)), "families")
    groups = complete_linkage(duplicate_edges(features, shared, t, families), families)
    grouped = features.join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn(
        "grp", F.coalesce("grp", "node")
    )
    kept = grouped.groupBy("grp").agg(F.min(F.struct("neg", "id", "url")).alias("k"))
    return grouped.join(kept, "grp").select(
        F.col("id").alias("ingest_seq"), "url", "neg", F.col("k.id").alias("kept_seq"), F.col("k.url").alias("kept_url")
    )


def deduplicate(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Kept postings with ``duplicate_urls``, the dropped urls from the most to the least complete.

    The list is as long as the group; where a group may hold millions use :func:`duplicate_members`.
    """
    members = materialize(duplicate_members(df, t), "members")
    dropped = (
        members.filter("ingest_seq <> kept_seq")
        .groupBy("kept_seq")
        .agg(F.array_sort(F.collect_list(F.struct("neg", "ingest_seq", "url"))).getField("url").alias("duplicate_urls"))
    )
    kept = members.filter("ingest_seq = kept_seq").select("ingest_seq")
    return (
        df.join(kept, "ingest_seq", "left_semi")
        .join(dropped.withColumnRenamed("kept_seq", "ingest_seq"), "ingest_seq", "left")
        .withColumn("duplicate_urls", F.coalesce("duplicate_urls", F.array().cast("array<string>")))
    )


def cluster_of_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Append ``pred``: both urls of a labelled pair ended up in one group; unknown urls stand alone."""
    m = members.select("url", "kept_url")
    out = pairs
    for side in "ab":
        out = out.join(
            m.select(F.col("url").alias(f"url_{side}"), F.col("kept_url").alias(f"_k{side}")), f"url_{side}", "left"
        )
    return out.withColumn(
        "pred", F.coalesce("_ka", "url_a") == F.coalesce("_kb", "url_b")
    ).drop("_ka", "_kb")
