"""Sheets for hand labelling and evaluation of rule versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import company_key
from ..functions.text import blanks_to_null
from ..operators import checks, pairs, sampling, store
from ..operators import duplicates as D
from ..operators.classify import normalize_postings, predict
from ..operators.evaluation import bootstrap, prf
from ..operators.exact import first_per_key
from ..rules import RuleSet
from ..session import materialize
from ..sources import labels


def week_sheet(raw: DataFrame, dev_snapshot: DataFrame, dev_gold: DataFrame, n_recheck: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(test rows, sheet): new rows free of dev overlap plus dev rows to label again, half per class."""
    test = sampling.select_test(raw, dev_snapshot, "ingest_seq")
    sure = dev_gold.filter("not unsure")
    picked = sampling.sample_per_class(sure, n_recheck // 2, "ds_role", "url", seed)
    again = dev_snapshot.join(picked.select("url"), "url", "left_semi")
    both = test.unionByName(again, allowMissingColumns=True)
    sheet = labels.label_sheet(both, labels.SHEET_COLUMNS, labels.LABEL_COLUMNS, sampling.seeded("url", seed))
    return test, sheet


def pairs_sheet(
    raw: DataFrame, dev_pairs: DataFrame, dev_snapshot: DataFrame, n_recheck: int = 30, n_control: int = 100, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(pairs with their hidden sample, sheet): candidates, control pairs and dev pairs to label again."""
    df = first_per_key(normalize_postings(blanks_to_null(raw)), "url", "ingest_seq")
    df = materialize(df, "normal")
    features, shared = D.posting_features(df, D.Thresholds())
    short = pairs.candidates(features, shared)
    found = short.pairs()
    control = pairs.control_pairs(features, short, n_control, seed)
    urls = features.select("id", "url")
    numbered = found.withColumn("sample", F.lit("candidate")).unionByName(control.withColumn("sample", F.lit("control")))
    test = (
        numbered.join(urls.select(F.col("id").alias("a"), F.col("url").alias("url_a")), "a")
        .join(urls.select(F.col("id").alias("b"), F.col("url").alias("url_b")), "b")
        .select("url_a", "url_b", "sample")
    )
    sure = dev_pairs.filter(~F.col("unsure") & (company_key("company") != ""))
    pair_id = F.concat_ws("|", "url_a", "url_b")
    again = sampling.sample_per_class(sure, n_recheck // 2, "is_dup", pair_id, seed).select("url_a", "url_b", F.lit("recheck").alias("sample"))
    # only the pairs are written here; the sheet takes the texts of both sides when it is read
    test, again = materialize(test, "test-pairs"), materialize(again, "dev-pairs")
    rows = pairs.pair_sheet(test, df, "ingest_seq").unionByName(
        pairs.pair_sheet(again, normalize_postings(dev_snapshot), "ingest_seq")
    )
    sheet = labels.label_sheet(rows, labels.PAIR_COLUMNS, labels.PAIR_LABELS, sampling.seeded(pair_id, seed))
    return test.unionByName(again), sheet


def pair_counts(raw: DataFrame, t: D.Thresholds = D.Thresholds()) -> DataFrame:
    """One row: postings, those without a company (they are in no pair), pairs of related companies, candidates among them."""
    df = materialize(first_per_key(normalize_postings(blanks_to_null(raw)), "url", "ingest_seq"), "normal")
    features, shared = D.posting_features(df, t)
    rows = features.agg(F.count(F.lit(1)).alias("n_postings"), F.count_if(F.col("company") == "").alias("n_without_company"))
    all_pairs = pairs.link_weights(features).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    found = pairs.candidates(features, shared, t).count().withColumnRenamed("n", "n_candidates")
    return rows.join(all_pairs, F.lit(True)).join(found, F.lit(True))  # three tables of one row


def score_versions(gold: DataFrame, snapshot: DataFrame, versions: dict[str, RuleSet]) -> DataFrame:
    """Labels joined to the predictions of every rule version, one row per posting and version."""
    parts = [
        predict(snapshot, rules).select("url", F.lit(name).alias("version"), "role_pred", "naive_pred", "target_pred", "ind_pred")
        for name, rules in versions.items()
    ]
    scored = reduce(DataFrame.unionByName, parts)
    return gold.join(scored, "url").filter("not unsure")


def compare_versions(gold: DataFrame, snapshot: DataFrame, versions: dict[str, RuleSet], intervals: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Role metrics per version, and bootstrap intervals from draws that all versions share."""
    scored = materialize(score_versions(gold, snapshot, versions), "scored")
    points = prf(scored, "ds_role", "role_pred", ["version"])
    if not intervals:
        return points, None
    wide = scored.groupBy("url").agg(
        F.first("ds_role").alias("ds_role"),
        *[F.max(F.when(F.col("version") == v, F.col("role_pred"))).alias(v) for v in versions],
    )
    return points, bootstrap(wide, "ds_role", list(versions))


def freeze_pairs_snapshot(raw: DataFrame, gold: DataFrame, path: str) -> None:
    """Store the snapshot that pair labels refer to, after checking that it holds every labelled url."""
    both = gold.select(F.explode(F.array("url_a", "url_b")).alias("url"))
    checks.require_references(both, "url", raw, "url")
    store.freeze(raw, path)
