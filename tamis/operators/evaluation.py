"""Measuring rules against hand labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, text_array

REPLICATES = 1000
SEED = 42


def _rates(tp: Column, n_pred: Column, n_true: Column) -> list[Column]:
    return [
        F.try_divide(tp.cast("double"), n_pred).alias("precision"),
        F.try_divide(tp.cast("double"), n_true).alias("recall"),
        F.try_divide(2.0 * tp, n_pred + n_true).alias("f1"),
    ]


def prf(df: DataFrame, truth: Column | str, pred: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and precision, recall, F1, in total or per group; an empty denominator gives NULL."""
    t, p = col(truth), col(pred)
    counts = [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    ]
    out = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(*by, "tp", "fp", "fn", "tn", *_rates(tp, tp + fp, tp + fn))


def prf_slices(df: DataFrame, truth: str, pred: str, flag: str) -> DataFrame:
    """Metrics of all rows and of both values of ``flag``, from one pass. ``slice``: all, yes, no."""
    t, p = F.col(truth), F.col(pred)
    grouped = df.rollup(flag).agg(
        F.grouping(flag).alias("_all"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    name = F.when(F.col("_all") == 1, "all").when(F.col(flag), "yes").otherwise("no")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return grouped.select(name.alias("slice"), "tp", "fp", "fn", "tn", *_rates(tp, tp + fp, tp + fn))


def key_metrics(df: DataFrame, truth: str, pred: str, keys: Sequence[str]) -> DataFrame:
    """One-against-rest metrics per key of two array columns, and their micro total.

    Keys with neither label nor prediction get no row of their own but count in the total.
    """
    each = df.select(F.explode(text_array(keys)).alias("key"), truth, pred).select(
        "key",
        F.coalesce(F.array_contains(truth, F.col("key")), F.lit(False)).alias("t"),
        F.coalesce(F.array_contains(pred, F.col("key")), F.lit(False)).alias("p"),
    )
    t, p = F.col("t"), F.col("p")
    out = each.rollup("key").agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.filter("key is null or tp + fp + fn > 0").select(
        F.coalesce("key", F.lit("micro")).alias("key"), "tp", "fp", "fn", "tn", *_rates(tp, tp + fp, tp + fn)
    )


# ---- bootstrap ---------------------------------------------------------------------------------------------


def _interval(replicates: DataFrame, names: Sequence[str]) -> DataFrame:
    low, high = F.lit(0.025), F.lit(0.975)
    rows = replicates.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(n).alias("name"), F.lit(m).alias("metric"), F.col(f"{n}_{m}").alias("x"))
                for n in names for m in ("precision", "recall", "f1")
            ])
        ).alias("e")
    ).select("e.*")
    return rows.groupBy("name", "metric").agg(F.percentile("x", low).alias("low"), F.percentile("x", high).alias("high"))


def _cells(df: DataFrame, truth: str, preds: Sequence[str]) -> list[tuple]:
    """Row counts per combination of label and predictions, in order: at most ``2^(k+1)`` rows."""
    keys = [F.col(truth).alias("t"), *[F.col(p) for p in preds]]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(tuple(r) for r in counts)


def bootstrap(df: DataFrame, truth: str, preds: Sequence[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """95 % percentile intervals ``(name, metric, low, high)``; all predictions share the resamples.

    Every draw picks a row by a hash of replicate and draw number. Metrics depend only on the cell
    (label, predictions) of the row drawn, so rows are thought of as sorted by cell and a draw is looked
    up among the cell borders; the table itself is read once, to count the cells. The work is
    ``replicates`` x rows draws, spread by range; see :func:`bootstrap_cells` for very large tables.
    """
    spark = df.sparkSession
    cells = _cells(df, truth, preds)
    total = sum(c[-1] for c in cells)
    size = replicates * total
    parts = max(spark.sparkContext.defaultParallelism, size // 2_000_000)
    draws = spark.range(0, size, 1, parts).select(
        F.expr(f"id div {max(total, 1)}").alias("replicate"), F.expr(f"id % {max(total, 1)}").alias("draw")
    )
    text = F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string"))
    index = F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") % total
    cell, upto = F.lit(len(cells) - 1), total
    for i in reversed(range(len(cells))):
        upto -= cells[i][-1]
        cell = F.when(F.col("at") < upto + cells[i][-1], i).otherwise(cell)
    placed = draws.withColumn("at", index).select("replicate", cell.alias("c"))

    def drawn(wanted) -> Column:
        return F.count_if(F.col("c").isin([i for i, c in enumerate(cells) if wanted(c)]))

    counted = placed.groupBy("replicate").agg(
        *[
            drawn(wanted).alias(f"{p}_{n}")
            for k, p in enumerate(preds, 1)
            for n, wanted in (
                ("tp", lambda c, k=k: c[0] and c[k]),
                ("np", lambda c, k=k: c[k]),
                ("nt", lambda c: c[0]),
            )
        ]
    )
    return _interval(_replicate_rates(counted, preds), preds)


def _replicate_rates(counted: DataFrame, preds: Sequence[str]) -> DataFrame:
    out = []
    for p in preds:
        rates = _rates(F.col(f"{p}_tp"), F.col(f"{p}_np"), F.col(f"{p}_nt"))
        out += [r.alias(f"{p}_{m}") for r, m in zip(rates, ("precision", "recall", "f1"), strict=True)]
    return counted.select(*out)


def bootstrap_cells(df: DataFrame, truth: str, preds: Sequence[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The same intervals from resampled cell counts: the work does not grow with the table.

    The number of rows drawn from each cell is multinomial, so a replicate is one such draw.
    """
    cells = _cells(df, truth, preds)
    total = sum(c[-1] for c in cells)
    names = list(preds)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares = np.array([c[-1] for c in cells]) / max(total, 1)
        truths = np.array([bool(c[0]) for c in cells])
        marks = {p: np.array([bool(c[1 + i]) for c in cells]) for i, p in enumerate(names)}
        for pdf in batches:
            counts = np.stack([np.random.default_rng([seed, r]).multinomial(total, shares) for r in pdf["id"].tolist()])
            yield pd.DataFrame({
                f"{p}_{n}": counts[:, mask].sum(axis=1)
                for p in names
                for n, mask in (("tp", truths & marks[p]), ("np", marks[p]), ("nt", truths))
            })

    schema = ", ".join(f"{p}_{n} long" for p in names for n in ("tp", "np", "nt"))
    return _interval(_replicate_rates(df.sparkSession.range(replicates).mapInPandas(draw, schema), names), names)


# ---- agreement ----------------------------------------------------------------------------------------------


def _kappa_parts(x: Column, y: Column) -> list[Column]:
    a, b = x.cast("double"), y.cast("double")
    return [
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("_a"), F.avg(b).alias("_b"), F.avg((x == y).cast("double")).alias("agreement"),
    ]


def _kappa() -> Column:
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa")


def kappa(df: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    """``(n, agreement, kappa)`` of two boolean ratings; constant raters give NULL."""
    return df.agg(*_kappa_parts(col(a), col(b))).select("n", "agreement", _kappa())


def label_agreement(dev: DataFrame, again: DataFrame) -> DataFrame:
    """Self-agreement on rows both sure about: role with kappa, and key sets where both found a role."""
    pair = dev.alias("d").join(again.alias("r"), "url").filter("not d.unsure and not r.unsure")
    a, b = F.col("d.ds_role"), F.col("r.ds_role")
    both = a & b

    def same(name: str) -> Column:
        equal = F.array_sort(f"d.{name}") == F.array_sort(f"r.{name}")
        return F.avg(F.when(both, equal.cast("double"))).alias(f"same_{name}")

    return pair.agg(*_kappa_parts(a, b), F.count_if(both).alias("n_both"), same("roles"), same("industries")).select(
        "n", "agreement", _kappa(), "n_both", "same_roles", "same_industries"
    )


def pair_agreement(dev: DataFrame, again: DataFrame) -> DataFrame:
    pair = dev.alias("d").join(again.alias("r"), ["url_a", "url_b"]).filter("not d.unsure and not r.unsure")
    return kappa(pair, F.col("d.is_dup"), F.col("r.is_dup"))


# ---- errors ---------------------------------------------------------------------------------------------------


def label_error() -> Column:
    """Kind of a classification error, NULL when there is none; a wrong role outweighs a wrong industry."""
    return (
        F.when(F.col("ds_role") & ~F.col("role_pred"), "fn_role")
        .when(~F.col("ds_role") & F.col("role_pred"), "fp_role")
        .when(F.col("is_target") != F.col("target_pred"), "industry")
    )


def pair_error() -> Column:
    return F.when(F.col("is_dup") & ~F.col("pred"), "fn").when(~F.col("is_dup") & F.col("pred"), "fp")


def error_table(df: DataFrame, error: Column, order: str = "company") -> DataFrame:
    return df.withColumn("error", error).filter("error is not null").orderBy("error", order, "url" if "url" in df.columns else "url_a")


def value_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def control_recall(pairs: DataFrame) -> DataFrame:
    """Duplicates among the control pairs, and how many of them the rules missed."""
    control = pairs.filter((F.coalesce("sample", F.lit("candidate")) == "control") & ~F.col("unsure"))
    return control.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_dup").alias("n_dup"), F.count_if(F.col("is_dup") & ~F.col("pred")).alias("missed")
    )


def sample_counts(pairs: DataFrame) -> DataFrame:
    """Pairs, duplicates and unsure labels per sample."""
    return pairs.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_dup").alias("n_dup"), F.count_if("unsure").alias("n_unsure")
    )
