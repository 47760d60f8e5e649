"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are always reported. A fourth kind, ``opaque``, is any long run of key characters that mixes letters and
digits, outside base spans. Its candidates are hashed, and the whole corpus counts in how many repositories and by how many owners each value
occurs: a value that many hold is a published example, one that few hold and that looks random is a live credential.
Only the latter become spans. The frequencies of base values only label them (``n_examples``).

Repository and owner are columns of the caller; of the table ``documents`` the source is the owner, and the pair of source
and language is the repository. Counting is done on distinct (value, repository) rows, which are combined before the
shuffle, so a value copied into a third of all rows is a few rows per task.

Defined cases: a null text is empty and has no spans. Null repositories and owners count as one each. Ids may be null or
repeated: rows are numbered when the candidates are written, and every input row gives one output row. Spans of
different kinds may overlap. Input columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# The base kinds in their order. The letters of the names match in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"  # greedy: 18 characters and more
HEX = "[0-9a-f]{16,}"
OPAQUE = "[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN_LENGTH = 12

# A value held by more owners or more repositories than these is an example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
# Distinct characters and digits that a live-looking value has at least.
LIVE_CHARACTERS = 10
LIVE_DIGITS = 4

ROW = "_secret_row"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, start, value) of all matches: pieces between matches and matches alternate."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    begun = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:int,start:int,value:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), (a["at"] + x["g"]).alias("start"), x["m"].alias("value")))).alias("out"),
        ),
    )["out"]
    none = F.array().cast("array<struct<kind:int,start:int,value:string>>")
    return F.when(text.rlike(pattern), begun).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by kind; the secret itself is the value."""
    secret = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    assign = F.filter(matches(text, ASSIGN, 0), lambda m: F.length(secret(m)) >= ASSIGN_LENGTH)
    digits = lambda m: F.length(m["value"]) - F.length(F.translate(m["value"], "0123456789", ""))
    varied = lambda m: F.size(F.array_distinct(F.split(m["value"], ""))) >= LIVE_CHARACTERS
    opaque = F.filter(matches(text, OPAQUE, 3), lambda m: (digits(m) >= LIVE_DIGITS) & (digits(m) < F.length(m["value"])) & varied(m))
    base = F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))
    end = lambda m: m["start"] + F.length(m["value"])
    alone = F.filter(opaque, lambda m: ~F.exists(base, lambda s: (s["start"] < end(m)) & (m["start"] < end(s))))
    every = F.when(text.rlike(OPAQUE), F.concat(base, alone)).otherwise(base)
    held = lambda m: F.when(m["kind"] == 0, secret(m)).otherwise(m["value"])
    return F.transform(
        every,
        lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), F.sha2(held(m), 256).alias("value")),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories) over the whole corpus, from rows (value, owner, repository)."""
    held = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    return held.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repositories"))


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, keep: tuple[str, ...] = ("doc_id",), max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The ``keep`` columns of every row and ``found``: its spans (start, kind, end) in order, with ``example``."""
    owner = F.col("source") if owner is None else owner
    repository = F.to_json(F.struct(F.col("source"), F.col("lang"))) if repository is None else repository
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(c).alias(c) for c in keep)).alias("kept"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        candidates(text).alias("spans"),
    )
    rows = materialize(rows.withColumn(ROW, F.monotonically_increasing_id()), "secret-candidates")
    each = rows.where(F.size("spans") > 0).select(ROW, "owner", "repository", F.explode("spans").alias("s")).select(ROW, "owner", "repository", "s.*")
    counted = ownership(each)
    example = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = each.join(counted, "value").withColumn("example", example).where((F.col("kind") < KINDS.index("opaque")) | ~F.col("example"))
    found = judged.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "example"))).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")
    return rows.select(ROW, "kept").join(found, ROW, "left").select("kept.*", F.coalesce("found", none).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, and how many base values are examples."""
    base = F.filter("found", lambda s: s["kind"] < 3)
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: (s["kind"] < 3) & s["example"])).cast("long").alias("n_examples"),
    )


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are replaced once."""
    # cut points run left to right: each span gives the text since the last end, and one mask per run of overlapping spans
    state = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] >= a["at"]), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.when(F.size(found) == 0, text).otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """The same columns; secrets are masked in ``text``, and ``n_chars`` follows the new text."""
    columns = docs.columns
    out = scan(docs, keep=tuple(columns)).withColumn("text", masked(F.col("text"), F.col("found")))
    return out.withColumn("n_chars", F.when(F.size("found") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(columns)
