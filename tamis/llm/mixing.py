"""Mixing sources to target weights.

The weight of a source is its share of all tokens, raised to an exponent and normalised. Exponent 1 leaves the natural
shares, exponent 0 makes all sources equal. The exponent is bisected: it is the largest one at which the entropy of the
weights reaches ``entropy`` (as a part of the logarithm of the number of sources), but not so small that a source would
be repeated more than ``max_repeats`` times. Every round of the search evaluates a grid of exponents in one aggregate over
the table of sources, so that no list of sources comes to the driver.

A weight times the token budget is realised as blocks: each block is one permutation of the source's documents, and a
document takes part in as many whole blocks as the budget holds, and in the last one if its place in that permutation
lies within the rest of the budget. The place is found in two steps, sums per hash range first and then a window
inside the one range where the budget ends, so a source of any size is never in one task.

Defined cases: rows with a null source form a source of their own; rows without tokens never decide a budget, and a
source without any tokens is used once. Rows that share an id but differ have places of their own; rows that are equal in every
column go in or stay out together. An empty table gives no rows. Input columns are kept; ``n_tokens`` and ``n_uses`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ENTROPY = 0.98
MAX_REPEATS = 4.0
GRID = 32
ROUNDS = 7
RANGE_ROWS = 10_000
# Columns of our own beside those of the input.
KEY, PLACE, TOKENS, BLOCKS, REST, UNTIL = (f"_mix_{x}" for x in ("source", "place", "tokens", "blocks", "rest", "until"))


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """Bisected exponent for ``sources`` (tokens > 0): each round narrows the bracket of both conditions ``GRID`` times."""
    both = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    whole = sources.agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return 1.0
    shares = sources.select("tokens", (F.col("tokens") / F.lit(float(whole["all"]))).alias("share"))
    for _ in range(ROUNDS):
        grid = sorted({lo + (hi - lo) * k / GRID for lo, hi in both.values() for k in range(GRID + 1)})
        raised = shares.select("*", F.explode(F.array(*map(F.lit, grid))).alias("a")).withColumn("raised", F.pow("share", "a"))
        # with z = sum of raised shares and w = raised / z, the entropy is ln z - sum(raised * ln raised) / z
        at = raised.groupBy("a").agg(
            F.sum("raised").alias("z"),
            F.sum(F.col("raised") * F.log("raised")).alias("rl"),
            F.max(F.col("raised") / F.col("tokens")).alias("most"),
        )
        rows = {r["a"]: r for r in at.select("a", (F.log("z") - F.col("rl") / F.col("z")).alias("h"), (F.col("most") / F.col("z") * budget).alias("most")).collect()}
        goal = entropy * math.log(whole["n"]) - 1e-12
        enough = [a for a in grid if rows[a]["h"] >= goal]
        lo = max(enough, default=0.0)
        both["entropy"] = (lo, min((a for a in grid if a > lo), default=lo))
        within = [a for a in grid if rows[a]["most"] <= max_repeats]
        hi = min(within, default=1.0)
        both["repeats"] = (max((a for a in grid if a < hi), default=hi), hi)
    return max(both["entropy"][0], both["repeats"][1])


def place(seed: int, *cols: Column) -> Column:
    """Place in the permutation: 63 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def mix(docs: DataFrame, tokens: Column, id_col: str = "doc_id", source_col: str = "source", budget: float | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = 11) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``n_uses``, how many times the mixture uses the row (0: not at all).

    ``budget`` is the number of tokens of the mixture; all tokens of the input if not given.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    # the whole row goes into its place, so that rows that only share an id have places of their own
    whole = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marked = docs.withColumns({KEY: key, PLACE: place(seed, F.col(id_col), *whole), TOKENS: tokens.cast("long")})
    narrow = materialize(marked.select(KEY, PLACE, F.col(TOKENS).alias("tokens")), "mix-rows")
    sources = materialize(narrow.groupBy(KEY).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).coalesce(1), "mix-sources")
    total = sources.agg(F.sum("tokens").alias("t"), F.max("rows").alias("rows")).first()
    budget = float(total["t"] or 0) if budget is None else float(budget)
    filled = sources.where("tokens > 0")
    a = exponent(filled, budget, entropy, max_repeats)
    raised = filled.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(total["t"] or 1)), F.lit(a)))
    z = raised.agg(F.sum("raised")).first()[0] or 1.0
    want = F.least(F.col("raised") / F.lit(z) * F.lit(budget), F.lit(float(max_repeats)) * F.col("tokens"))
    plan = raised.withColumn("want", F.floor(want + 1e-6).cast("long")).select(
        KEY, F.expr("want div tokens").alias("blocks"), F.expr("want % tokens").alias("rest")
    )
    # ranges of the permutation, so narrow that one holds about RANGE_ROWS rows of the largest source
    bits = min(40, max(0, (int(total["rows"] or 0) // RANGE_ROWS).bit_length()))
    span = F.shiftright(F.col(PLACE), 63 - bits)
    # equal rows have one place; they are added up before their range is put in order
    places = narrow.groupBy(KEY, span.alias("span"), PLACE).agg(F.sum("tokens").alias("tokens"))
    ranges = places.groupBy(KEY, "span").agg(F.sum("tokens").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(KEY).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).join(plan, KEY)
    edge = ranges.where("before <= rest and before + tokens > rest").select(KEY, "span", (F.col("rest") - F.col("before")).alias("room"))
    inside = places.join(edge, [KEY, "span"])
    running = F.sum("tokens").over(Window.partitionBy(KEY, "span").orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0))
    first_out = inside.withColumn("running", running).where("running > room").groupBy(KEY).agg(F.min(PLACE).alias("until"))
    plan = plan.join(first_out, KEY, "left").select(KEY, F.col("blocks").alias(BLOCKS), F.col("rest").alias(REST), F.coalesce("until", F.lit(0)).alias(UNTIL))
    plan = materialize(plan.coalesce(1), "mix-plan")
    joined = marked.drop("n_tokens", "n_uses").join(plan, KEY, "left")
    uses = F.col(BLOCKS) + F.when((F.col(REST) > 0) & (F.col(PLACE) < F.col(UNTIL)), 1).otherwise(0)
    used = joined.withColumns({"n_tokens": F.col(TOKENS), "n_uses": F.coalesce(uses, F.lit(1)).cast("long")})
    return used.drop(KEY, PLACE, TOKENS, BLOCKS, REST, UNTIL)


def repeated(mixed: DataFrame) -> DataFrame:
    """One row per use."""
    return mixed.where("n_uses > 0").withColumn("_use", F.explode(F.expr("sequence(1L, n_uses)"))).drop("_use")
