import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamis.operators import duplicates as D
from tamis.operators import graph as G

SCHEMA = (
    "url string, source string, company string, title string, description string, salary_min double, "
    "salary_max double, skills array<string>, ingest_seq long"
)
# four texts on different subjects, each long enough to be told apart by its word runs
HARBOR = (
    "на причале с рассвета грузят ящики с рыбой кран скрипит над баржей чайки кричат а старый лоцман записывает "
    "в тетрадь глубину фарватера и ждёт пока туман отойдёт от маяка чтобы вывести караван в открытое море"
)
GARDEN = (
    "весной садовник обрезает яблони белит стволы рыхлит землю у смородины ставит парник под огурцы и учит внука "
    "прививать груши сорта лесная красавица на дикий подвой потому что такие деревья живут дольше прочих"
)
TRAIN = (
    "ночной поезд идёт через степь проводница разносит чай в подстаканниках пассажиры играют в шахматы за окном "
    "мелькают станции с резными крышами и никто не знает во сколько состав придёт на узловую"
)
WINTER = (
    "зимой река встаёт дети катаются на санках с крутого берега рыбаки сверлят лунки бригада чистит дорогу "
    "до переправы и каждый вечер в клубе показывают старое кино про полярников и капитанов"
)


def table(spark, rows):
    base = {"title": "data scientist", "company": "acme", "source": None, "description": None, "skills": []}
    full = [{"salary_min": None, "salary_max": None, **base, **r, "ingest_seq": i} for i, r in enumerate(rows)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA), full


def dedupe(spark, rows):
    df, _ = table(spark, rows)
    return {r.url: r.duplicate_urls for r in D.deduplicate(df).select("url", "duplicate_urls").collect()}


def test_exact_copies_and_unknown_employers(spark):
    rows = [
        dict(url="short", description="мало"),
        dict(url="long", description="гораздо больше слов", salary_min=90_000.0),
        dict(url="short", description="мало"),
        dict(url="elsewhere", company="initech"),
        dict(url="hidden1", company=None),
        dict(url="hidden2", company=None),
    ]
    assert dedupe(spark, rows) == {"long": ["short"], "elsewhere": [], "hidden1": [], "hidden2": []}


def test_related_companies_and_rewritten_texts_across_boards(spark):
    rows = [
        # one company key continues the other
        dict(url="p1", source="g", company="рога", title="data analyst", description="подробнее"),
        dict(url="p2", source="h", company="ооо рога и копыта", title="data analyst"),
        dict(url="p3", company=None, title="data analyst"),
        dict(url="p4", company="копыта", title="data analyst"),
        # a detail added to the title, no text to compare
        dict(url="q1", source="g", company="лютик банк", description="подробнее"),
        dict(url="q2", source="h", company="лютик-банк", title="data scientist (ai)"),
        # same title, text told in other words
        dict(url="r1", source="g", company="василёк", title="python разработчик (middle)", description=TRAIN),
        dict(url="r2", source="h", company="василек", title="python разработчик (middle)", description=WINTER),
    ]
    got = dedupe(spark, rows)
    assert got == {"p1": ["p2"], "p3": [], "p4": [], "q1": ["q2"], "r1": ["r2"]}


def test_one_board_needs_shared_text(spark):
    rows = [
        dict(url=f"team{i}", source="g", company="ромашка", title="middle support engineer", description=t)
        for i, t in enumerate([TRAIN, HARBOR, GARDEN])
    ] + [dict(url=u, source="h", company="незабудка", title="senior go developer", description=f"{WINTER} {TRAIN}") for u in "ab"]
    assert dedupe(spark, rows) == {"team0": [], "team1": [], "team2": [], "a": ["b"]}


def test_bare_title_joins_the_version_with_its_text(spark):
    rows = [
        dict(url="risk", source="h", company="лютик", salary_min=1.0, title="senior data scientist (риски)"),
        dict(url="bare", source="d", company="лютик", description=GARDEN),
        dict(url="ai", source="h", company="лютик", title="data scientist (ai)", description=" ".join(GARDEN.split()[:28])),
        # one posting whose slug changed, and one text under two titles
        dict(url="https://b.example/vacancies/77-old-name", source="g", company="ромашка", title="руководитель склада", description="подробно"),
        dict(url="https://b.example/vacancies/77", source="g", company="ромашка", title="начальник отдела"),
        dict(url="s1", source="k", company="клевер", title="менеджер по продажам", description=f"{HARBOR} {WINTER}"),
        dict(url="s2", source="h", company="клевер", title="sales-менеджер", description=HARBOR),
    ]
    got = dedupe(spark, rows)
    assert got == {"risk": [], "bare": ["ai"], "https://b.example/vacancies/77-old-name": ["https://b.example/vacancies/77"], "s1": ["s2"]}


def random_rows(seed, n=90, hot=False):
    rng = random.Random(seed)
    companies = ["сбер", "сбербанк", "сбертех", "пао сбер", "ozon", "ozon tech", None, "nda", "яндекс"]
    titles = ["data scientist", "senior data scientist", "data scientist (nlp)", "data scientist (cv)", "data analyst",
              "data", "старший data analyst", "", None, "ml engineer в команду поиска"]
    vocab = [f"w{i}" for i in range(400)]
    bodies = [" ".join(rng.choices(vocab, k=60)) for _ in range(12)] + ["коротко", None]
    rows = []
    for i in range(n):
        body = rng.choice(bodies)
        if body and rng.random() < 0.5:
            body = " ".join(body.split()[: rng.randint(10, 60)] + rng.choices(vocab, k=rng.randint(0, 40)))
        url = f"/vacancies/{rng.randint(1, n)}-{rng.randint(0, 3)}" if rng.random() < 0.3 else f"u{rng.randint(0, 3 * n)}"
        rows.append(dict(
            url=url, source=rng.choice(["g", "h", "k"]), company="сбер" if hot else rng.choice(companies),
            title="data scientist" if hot and rng.random() < 0.6 else rng.choice(titles), description=body,
            salary_min=rng.choice([None, 1.0]), skills=["x"] * rng.randint(0, 2),
        ))
    return rows


def one_edge_at_a_time(ranked):
    """Groups by the plain procedure: best edge first, merged when all cross pairs are edges."""
    pairs = {frozenset(p) for p in ranked}
    group = {n: [n] for p in ranked for n in p}
    for a, b in ranked:
        x, y = group[a], group[b]
        if x is not y and all(frozenset((m, k)) in pairs for m in x for k in y):
            x += y
            group.update(dict.fromkeys(y, x))
    return {frozenset(g) for g in group.values()}


def linked(spark, df, steps=None):
    """Groups of more than one posting, by classes and by the plain procedure over all listed pairs."""
    firsts = df.groupBy("url").agg(F.min("ingest_seq").alias("ingest_seq")).select("ingest_seq")
    features, shared = D.posting_features(df.join(firsts, "ingest_seq", "left_semi"), D.Thresholds())
    nodes = D._nodes(features)
    families = D.title_families(nodes, D.company_prefixes(nodes)).cache()
    got = {}
    for r in G.complete_linkage(D.duplicate_edges(features, shared, families=families), families).collect():
        got.setdefault(r.grp, set()).add(r.node)
    ranked = D.duplicate_edges(features, shared).orderBy("best").select("a", "b").collect()
    want = one_edge_at_a_time([tuple(r) for r in ranked])
    return {frozenset(g) for g in got.values() if len(g) > 1}, {g for g in want if len(g) > 1}, families.count()


@pytest.mark.parametrize(("seed", "hot"), [(1, False), (2, True), (3, True), (4, False)])
def test_groups_are_those_of_one_edge_at_a_time(spark, seed, hot):
    df, _ = table(spark, random_rows(seed, hot=hot))
    got, want, _ = linked(spark, df)
    assert got == want


def family_rows(seed, n=70, boards="ghk", related=False):
    """One title of one company on several boards: own texts, reposted texts, changed slugs, rows without text."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    bodies = [" ".join(rng.choices(vocab, k=40)) for _ in range(n)]
    rows = []
    for i in range(n):
        body = rng.choice(bodies) if rng.random() < 0.4 else bodies[i]
        if rng.random() < 0.3:
            body = " ".join(body.split()[: rng.randint(10, 40)] + rng.choices(vocab, k=12))
        if rng.random() < 0.1:
            body = "коротко"
        url = f"/vacancies/{rng.randint(1, n)}-{i}" if rng.random() < 0.3 else f"u{i}"
        company = rng.choice(["клевер", "клевер плюс"]) if related else "клевер"
        title = "data scientist" if rng.random() < 0.85 else "data scientist nlp"
        rows.append(dict(url=url, source=rng.choice(boards) if rng.random() < 0.95 else None, company=company, title=title, description=body, salary_min=rng.choice([None, 1.0])))
    return rows


@pytest.mark.parametrize(("seed", "boards", "related"), [(1, "gh", False), (2, "ghk", False), (3, "ghkm", False), (4, "ghk", True)])
def test_repeated_titles_merge_as_classes(spark, seed, boards, related):
    df, _ = table(spark, family_rows(seed, boards=boards, related=related))
    got, want, members = linked(spark, df)
    assert got == want and (members > 40 or related)


def test_repeated_titles_take_no_more_rounds_when_there_are_more(spark, monkeypatch):
    calls = []
    rounds = G._marked
    monkeypatch.setattr(G, "_marked", lambda edges: calls.append(1) or rounds(edges))
    taken = []
    for n in (200, 400):
        vocab = [f"x{i}" for i in range(30 * n)]
        rows = [dict(url=f"{b}{i}", source=b, title="курьер", company="клевер", description=" ".join(random.Random(f"{b}{i}").sample(vocab, 30))) for i in range(n) for b in "gh"]
        df, _ = table(spark, rows)
        calls.clear()
        kept = D.duplicate_members(df).groupBy("kept_seq").count().collect()
        assert len(kept) == n and {r["count"] for r in kept} == {2}
        taken.append(len(calls))
    assert taken[0] == taken[1]


def test_mass_copies_are_one_group(spark):
    rows = [dict(url=f"c{i}", source=f"s{i % 3}", company="клевер", title="курьер", description=HARBOR) for i in range(40)]
    rows += [dict(url=None, company="клевер", title="повар")] * 5
    df, _ = table(spark, rows)
    got = {r.url: r.kept_url for r in D.duplicate_members(df).collect()}
    assert got == {**{f"c{i}": "c0" for i in range(40)}, None: None}


def test_scratch_tables_go_to_the_named_folder(spark):
    from tamis.session import scratch_path

    assert scratch_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(100, 101)], "a long, b long")
    )
    got = {r.node: r.component for r in G.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_shared_shingles_move_once(spark, tmp_path):
    """Kept and shared shingles against plain sets; texts are shuffled once and no table of shingles is written."""
    rng = random.Random(3)
    rows = [(i, ["acme", "acme east", "zeta", ""][i % 4], sorted(rng.sample(range(60), rng.randint(0, 12)))) for i in range(40)]
    texts = spark.createDataFrame(rows, "id long, company string, shingles array<long>")
    kept, shared = D.shared_shingles(texts, 5)
    n = {s: sum(s in r[2] for r in rows) for s in range(60)}
    keeps = {i: {s for s in words if n[s] <= 5} for i, _, words in rows}
    assert {r.id: r.n_kept for r in kept.collect()} == {i: len(k) for i, k in keeps.items() if k}
    related = lambda c, d: c != "" and d != "" and (c.startswith(d) or d.startswith(c))
    want = {(a, b): len(keeps[a] & keeps[b]) for a, c, _ in rows for b, d, _ in rows if a < b and related(c, d) and keeps[a] & keeps[b]}
    assert {(r.a, r.b): r.shared for r in shared.collect()} == want
    assert "shingle" not in " ".join(shared.columns + kept.columns)
    assert shared._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    plan = D.shingle_frequency(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange"):]


def test_titles_are_compared_once_per_pair_of_titles(spark):
    titles = spark.createDataFrame([("s", ["a"], ["a"]), ("t", ["a", "b"], ["a"]), ("u", [], [])], "title string, words array<string>, head array<string>")
    rows = [(i, i + 50, (x,), (y,)) for i, (x, y) in enumerate([("s", "t"), ("t", "s"), ("s", "s"), ("u", "u"), ("u", "t")] * 5)]
    pairs = spark.createDataFrame(rows, "a long, b long, x struct<title: string>, y struct<title: string>")
    got = {(r.x.title, r.y.title, r.equal_words, r.fits, r.equal_head, r.jaccard) for r in D.compare_titles(pairs, titles).collect()}
    assert got == {("s", "t", False, True, True, 0.5), ("t", "s", False, True, True, 0.5), ("s", "s", True, True, True, 1.0), ("u", "u", False, False, False, 0.0), ("u", "t", False, False, False, 0.0)}
    assert D.compare_titles(pairs, titles).count() == len(rows)


def test_only_telling_pairs_are_candidates(spark):
    """Rows that share a run of words but too few of them, or a rare title word but not the whole title, never meet."""
    some = " ".join(f"w{i}" for i in range(60))
    texts = [f"{some} {' '.join(f'{c}{i}' for i in range(n))}" for c, n in (("a", 9), ("b", 9))] + [f"w1 w2 w3 {' '.join(f'{c}{i}' for i in range(70))}" for c in "cd"]
    rows = [dict(url=f"t{i}", source="gh"[i % 2], title=f"title{i}", description=d) for i, d in enumerate(texts)]
    rows += [dict(url="s", source="g", title="alpha beta"), dict(url="l", source="h", title="alpha gamma delta"), dict(url="n", source="k", title="omega beta alpha")]
    rows += [dict(url=f"x{i}", source="g", title=f"beta other{i}", company="zeta") for i in range(3)]
    df, _ = table(spark, rows)
    features, shared = D.posting_features(df, D.Thresholds())
    nodes = D._nodes(features).withColumn("fam", F.lit(None).cast("long"))
    got = {(r.a, r.b) for r in D.duplicate_candidates(nodes, shared, D.company_prefixes(nodes)).collect()}
    assert shared.count() > 1 and got == {(0, 1), (4, 6)}


def test_rounds_carry_numbers_for_the_order_and_keep_edges_of_resting_nodes(spark, monkeypatch):
    seen = []
    marked = G._marked
    monkeypatch.setattr(G, "_marked", lambda edges: seen.append(dict(edges.dtypes)["best"]) or marked(edges))
    rows = [(1, 2, 0.1), (2, 3, 0.2), (1, 3, 0.3), (4, 5, 0.5), (5, 6, 0.4), (7, 8, 0.6), (8, 9, 0.05), (7, 9, 0.7)]
    edges = spark.createDataFrame([(a, b, (-o, a, b)) for a, b, o in rows], "a long, b long, best struct<o: double, p: long, q: long>")
    groups = {}
    for r in G.complete_linkage(edges).collect():
        groups.setdefault(r.grp, set()).add(r.node)
    assert set(map(frozenset, groups.values())) == {frozenset({1, 2, 3}), frozenset({4, 5}), frozenset({6}), frozenset({7, 8, 9})}
    assert set(seen) == {"bigint"}


def test_rows_of_a_shingle_meet_as_they_stream_by(monkeypatch):
    rng = random.Random(4)
    names = ["acme", "acmeshop", "other", None]
    company = [rng.choice(names) for _ in range(60)]
    rows = sorted({(s, s % 3, i) for i in range(60) for s in (1, 2, *rng.choices(range(3, 70), k=4)) if s > 1 or i % 2})
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array([company[r[2]] for r in rows], pa.string())], ["h", "g", "id", "company"]
    )
    holders = {}
    for h, _, i in rows:
        holders.setdefault(h, []).append(i)
    kept = [ids for ids in holders.values() if len(ids) <= 5]
    related = lambda x, y: bool(company[x] and company[y]) and (company[x].startswith(company[y]) or company[y].startswith(company[x]))
    want = sorted([(i, -1) for ids in kept for i in ids] + [(x, y) for ids in kept for x in ids for y in ids if x < y and related(x, y)])
    for size in (3, 50, 1000):  # frequent shingles go on over many steps
        monkeypatch.setattr(D, "RUN", size)
        out = pa.Table.from_batches(D._mates(5)(iter(batch.slice(at, 7) for at in range(0, len(batch), 7))))
        assert sorted((a, -1 if b is None else b) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())) == want


def test_a_component_is_merged_without_rounds_over_tables(spark, monkeypatch):
    """A chain of ever better edges took a round over tables for each of its merges."""
    rounds = []
    marked = G._marked
    monkeypatch.setattr(G, "_marked", lambda edges: rounds.append(1) or marked(edges))
    edges = spark.createDataFrame([(i, i + 1, -i / 8, -i) for i in range(1, 6)], "a long, b long, o double, i long").select("a", "b", F.struct("o", "i").alias("best"))
    groups = G.complete_linkage(edges).collect()
    assert {r.node: r.grp for r in groups} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert len(rounds) == 1
