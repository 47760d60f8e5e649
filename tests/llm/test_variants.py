"""Fingerprint groups, spelling variants and whitening against brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamis.llm import simhash, spelling, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("n", "fp", "first", "component", "word", "run", "prefix", "x", "value", "place", "mask", "part")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéüßÀ", k=r.randint(1, 8))) for _ in range(120)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(40)]
    for _ in range(60):
        base = r.choice(out[:40]).split(" ")
        if r.random() < 0.7:
            base[r.randrange(len(base))] = r.choice(vocabulary)
        out.append(r.choice([" ", "  ", "\n", "\t"]).join(base))
    out += [None, "", "  \n", "One two", "one TWO", "\x1c \xa0", "a b c d", "A B C D", out[3].upper(), "x" * 70_000, "lang " * 9_000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(out)]
    return rows + [rows[4], rows[4], (None, out[5], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return texts(5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHES})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(ids, prints, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{p:016x}", min(least[find(i)], default=None)) for i, (d, p) in enumerate(zip(ids, prints))), key=str)


def test_simhash_components(docs, rows):
    want = groups([r[0] for r in rows], [fingerprint(r[1]) for r in rows])
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == want
    assert simhash.simhash_components(docs.where("doc_id < -1")).collect() == []


def test_simhash_links_of_dense_and_chunked_keys(spark):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(6)]
    for _ in range(250):
        prints.append(r.choice(prints) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    prints += [0, (1 << 64) - 1, 1 << 63, 15, 255]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    nodes = spark.createDataFrame(signed, "fp long")
    want = {d: c for d, _, c in groups([s for (s,) in signed], [s % (1 << 64) for (s,) in signed])}
    for chunk in (2, 7, 1 << 14):
        links = simhash.block_links(nodes, chunk=chunk).collect()
        assert len(links) <= 35 * len(signed) or chunk < 10
        parent = {s: s for (s,) in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert {s: find(s) for (s,) in signed} == want


def test_forest_spans_what_all_pairs_join():
    r = np.random.default_rng(1)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    nodes = np.unique(centre ^ np.array([np.uint64(1) << np.uint64(a) | np.uint64(1) << np.uint64(b) for a in range(40) for b in range(a)], np.uint64))
    root, end = simhash.forest(nodes, 4)
    assert len(end) == len(nodes) - 1 == len(set(end.tolist())) and set(root.tolist()) == {nodes[0]}
    assert len(simhash.forest(np.array([0, (1 << 64) - 1], np.uint64), 4)[0]) == 0


def variants(rows, rate=97):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    met = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in met.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(met[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def test_spelling_variants(docs, rows, spark):
    assert {tuple(r) for r in spelling.variants(docs).collect()} == variants(rows)
    # dense words: repeated letters, ties, chains of forms, letters outside a-z
    r = random.Random(8)
    dense = []
    for i in range(60):
        pool = ["".join(r.choices("aabÿ×", k=r.randint(4, 7))) for _ in range(12)]
        dense.append((i, " ".join(r.choices(pool, k=150)), None, None, 0))
    dense += [(1000 + i, " ".join(["aaaaa"] * 40 + ["aaaab"] * 20 + ["aaabb"] * 10 + ["AAAAAA"] * 5), None, None, 0) for i in range(3)]
    for rate in (97, 3):
        got = {tuple(r) for r in spelling.variants(spark.createDataFrame(dense, DOCS), rate=rate).collect()}
        assert got == variants(dense, rate) and any(r[1] not in (None, r[2]) for r in got)
    assert spelling.variants(docs.where("doc_id < -1")).collect() == []


def test_whitening(spark):
    r = np.random.default_rng(4)
    clean = (r.standard_normal((300, 12)) * np.linspace(1, 0.2, 12)).tolist()
    clean += [clean[0], clean[0], [0.0] * 12]
    nan, inf = float("nan"), float("inf")
    broken = [None, [], [1.0, None] + [0.0] * 10, [nan] + [0.0] * 11, [inf] + [0.0] * 11, [0.5] * 7, [1e300] * 12]
    rows = [(i, v, 0) for i, v in enumerate(clean)] + [(0, clean[5], 0), (None, clean[6], 0)] + [(900 + i, v, 0) for i, v in enumerate(broken)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)
    got = whitening.whiten(frame).collect()
    kept = [(i, v) for i, v, _ in rows if v in clean]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], object)
    n, total = len(x), x.sum(axis=0)
    centred = (x - total / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = np.abs(centred @ axes / np.sqrt(values))
    deviation = ((n * x - total) ** 2).sum(axis=1)
    expected = sorted((str(i), c + 1, round(want[k, c], 8), int(deviation[k])) for k, (i, _) in enumerate(kept) for c in range(8))
    assert sorted((str(g.vec_id), g.component, round(abs(g.whitened), 8), g.deviation) for g in got) == expected
    assert all(g.n == n and g.identity_error < 1e-9 and g.deviation_exact == str(g.deviation) for g in got)
    share = values / np.trace(centred.T @ centred / n)
    assert all(abs(g.explained / share[g.component - 1] - 1) < 1e-9 for g in got)


def test_whitening_of_few_dimensions_and_rows(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()
    assert make([]) == [] and make([None, []]) == [] and make([[1.0, 2.0]]) == [] and make([[1.0, 2.0]] * 5) == []
    line = make([[float(i), 2.0 * i, 5.0] for i in range(10)])
    assert {g.component for g in line} == {1} and all(g.identity_error < 1e-9 and abs(g.explained - 1) < 1e-12 for g in line)


def test_leading_vectors_of_hard_spectra():
    r = np.random.default_rng(0)
    cases = [r.standard_normal((400, 64)), r.standard_normal((500, 150)), r.standard_normal((200, 64)) * 0.8 ** np.arange(64)]
    cases += [np.repeat(r.standard_normal((3, 20)), 4, axis=0), np.repeat(np.eye(16), 3, axis=0), r.standard_normal((30, 3))]
    for x in cases:
        x = x - x.mean(axis=0)
        v = x.T @ x / len(x)
        values, axes = whitening.leading(lambda c: x.T @ (x @ c) / len(x), x.shape[1], min(8, x.shape[1]))  # noqa: B023
        want = np.linalg.eigvalsh(v)[::-1][: len(values)]
        assert np.abs(values - want).max() < 1e-12 * want[0]
        assert np.abs(v @ axes - axes * values).max() < 1e-12 * want[0]
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12


def test_squares_of_large_numbers():
    d = np.array([[2**62, -(2**61) + 7, 3], [0, 0, 0], [-(2**40) + 1, 2**21, -5]], np.int64)
    assert whitening.squared_sums(d) == [sum(int(v) ** 2 for v in row) for row in d]
