"""The stages of the corpus pipeline against plain versions on a small fixture, and their defined cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [name for name, _ in corpus_pipeline.STAGES]
SYLLABLES = {"xx": "ka ro mi te lu sa no".split(), "yy": "schu wen bra ott gig fjo ul".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, lang, rng.randint(40, 120)), lang, rng.choice(["a", "a", "a", "b", None]), 0) for i in range(80) for lang in [rng.choice(["xx", "yy"])]]
    near = out[3][1].rsplit(" ", 1)[0] + " other"
    out += [(100, out[3][1], "xx", "b", 0), (101, near, "xx", "a", 0), (102, f"{out[7][1]} password = hunter2hunter2hunter2", "xx", "a", 0)]
    out += [(110 + i, prose(rng, "xx", i), "xx", "a", 0) for i in range(1, 6)]  # clean and very short
    out += [(120, None, "xx", "a", 0), (121, "", "xx", "a", 0), (122, " 12 34 ", "xx", "b", 0), (None, prose(rng, "yy", 60), "yy", "a", 0)]
    out += [out[9], out[9], (9, prose(rng, "yy", 70), "yy", "a", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def stage(name, spark, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


def plain(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages_come_in_order():
    assert NAMES == ["language", "near_duplicates", "secrets", "mixture", "sequences"] and corpus_pipeline.ORACLE_SQL is None


def test_language_keeps_clean_documents_of_any_length(spark, docs, rows):
    kept = stage("language", spark, docs)
    assert kept.columns == docs.columns
    gone = Counter((r[0], r[1], r[3]) for r in rows) - plain(kept)
    assert set(gone) == {(120, None, "a"), (121, "", "a"), (122, " 12 34 ", "b")}
    assert all(r["lang"] == ("yy" if any(s in r["text"] for s in ("schu", "wen", "bra", "ott", "gig", "fjo")) else "xx") for r in kept.collect() if len(r["text"]) > 100)
    noise = [(500, "".join(random.Random(1).choices("qzxjwvpyh ", k=900)), None, "a", 0)]
    assert stage("language", spark, docs.union(spark.createDataFrame(noise, DOCS))).where("doc_id = 500").count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark, docs, rows):
    kept = plain(stage("near_duplicates", spark, docs))
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[r[0], r[1]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    like = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    for r in rows:
        smaller = [i for (i, _), s in sets.items() if i is not None and r[0] is not None and i < r[0] and like(s, sets[r[0], r[1]])]
        held = sum(n for (i, t, _), n in kept.items() if (i, t) == (r[0], r[1]))
        assert held == (0 if smaller else 1)


def test_secrets_masks_and_drops_nothing(spark, docs, rows):
    masked = stage("secrets", spark, docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    told = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert "hunter2hunter2hunter2" not in told[102] and told[120] is None and told[5] == rows[5][1]


def test_mixture_uses_rows_as_often_as_it_says(spark, docs, rows):
    from tamis.llm.common import n_words
    from tamis.llm.mixing import mix

    once = Counter({(r["doc_id"], r["text"], r["source"]): 0 for r in docs.collect()})
    for r in mix(docs, n_words(F.col("text"))).collect():
        once[r["doc_id"], r["text"], r["source"]] += r["n_uses"]
    assert plain(stage("mixture", spark, docs)) == +once


def test_sequences_hold_every_word_once(spark, docs, rows):
    found = stage("sequences", spark, docs).collect()
    assert sum(r["length"] for r in found) == sum(len((r[1] or "").split()) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_stages_of_empty_tables_and_clashing_columns(spark, docs, name):
    assert stage(name, spark, docs.where("doc_id < -1")).collect() == []
    clashes = {c: F.lit("x") for c in ("n", "cls", "label", "rest", "blocks", "until", "print", "_found", "score", "shard", "start", "id", "kind")}
    got, want = stage(name, spark, docs.withColumns(clashes)), stage(name, spark, docs)
    n, m = got.select(want.columns).count(), want.count()
    assert n == m if name != "mixture" else abs(n - m) < 0.1 * m  # other columns draw another permutation


def test_run_chains_the_stages(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and {"doc_id", "piece", "start", "length", "bin_capacity", "offset", "bin_id"} == set(found[0].asDict())
    assert not {120, 121, 122} & {r["doc_id"] for r in found} and 101 not in {r["doc_id"] for r in found}
