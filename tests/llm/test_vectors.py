"""Whitening, exact top-k, perfect hashes and source divergence against plain computations on small tables."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringframe.llm import divergence, phash, topk, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vector double, query int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)

    def of(rows):
        return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "k", 0.5, 7) for i, v in rows], SCHEMA)

    base = rng.normal(size=(120, 5)) * [9, 3, 1, 0.5, 0.2]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(200, None), (201, [1, None, 0, 0, 0]), (202, [float("nan"), 0, 0, 0, 0]), (203, [float("inf"), 0, 0, 0, 0]), (204, [1, 2]), (205, []), (None, base[3]), (20, base[5]), (220, base[5]), (221, base[5]), (222, base[5])]
    return of, rows


def usable(rows):
    return [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and len(v) == 5 and None not in v and np.isfinite(np.array(v, float)).all()]


def whole(rows):
    x = np.array([v for _, v in usable(rows)], object) + 1_000_000
    n = len(x)
    sums = x.sum(0)
    return x, n, sums, (n * x - sums)


def test_whitening(vectors):
    of, rows = vectors
    x, n, sums, moved = whole(rows)
    got = whitening.whiten(of(rows)).collect()
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    y = moved.astype(float) / n
    values = np.sort(np.linalg.eigvalsh(y.T @ y / n))[::-1]
    assert {r.component: r.explained for r in got} == pytest.approx({k + 1: v / values.sum() for k, v in enumerate(values)}, rel=1e-9)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({key: 5 * m for key, m in Counter((i, int(d)) for (i, _), d in zip(usable(rows), (moved**2).sum(1), strict=True)).items()})
    wide = {}
    for r in got:
        wide.setdefault(r.component, []).append(r.whitened)
    w = np.array([wide[k] for k in range(1, 6)])
    assert np.abs(w @ w.T / n - np.eye(5)).max() < 1e-9 and got[0].identity_error < 1e-9
    assert np.abs(w.mean(1)).max() < 1e-9


def test_whitening_of_dependent_and_narrow_columns(vectors):
    of, _ = vectors
    rng = np.random.default_rng(5)
    a = rng.integers(-50_000, 50_000, (300, 3)) / 64
    rows = list(enumerate(np.column_stack([a, a[:, 0] + a[:, 1], np.full(300, 2.5)])))
    got = whitening.whiten(of(rows)).groupBy("component").agg(F.max("explained").alias("e"), F.max("identity_error").alias("d")).collect()
    assert sorted(r.component for r in got) == [1, 2, 3] and max(r.d for r in got) < 1e-9
    # one direction a millionth as wide as the others
    narrow = [(i, [v[0], v[1], v[0] + v[1] + (i % 2) / 64, 0, 0]) for i, v in enumerate(a)]
    x, n, _, moved = whole(narrow)
    y = [[Fraction(int(v), n) for v in row[:3]] for row in moved]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    cov = [[sum(r[i] * r[j] for r in y) / n for j in range(3)] for i in range(3)]
    got = {r.component: r for r in whitening.whiten(of(narrow)).dropDuplicates(["component"]).collect()}
    trace = sum(cov[i][i] for i in range(3))
    product = np.prod([got[k].explained for k in (1, 2, 3)])
    assert product == pytest.approx(float(det(cov) / trace**3), rel=1e-6) and got[3].identity_error < 1e-4


def test_whitening_cases(vectors):
    of, rows = vectors
    assert whitening.whiten(of([])).count() == 0
    assert whitening.whiten(of([(1, None)])).count() == 0
    assert whitening.whiten(of([(1, [1, 2, 3])])).count() == 0
    assert whitening.whiten(of([(1, [])])).count() == 0
    assert whitening.whiten(of([(i, [1, 2, 3]) for i in range(4)])).count() == 0
    huge = whitening.whiten(of([(1, [3e38, 1]), (2, [-3e38, 2])])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 2
    assert whitening.whiten(of(rows), most=2).groupBy("component").count().count() == 2


def brute_top(rows, k, every):
    found = usable(rows)
    out = []
    for a, (i, v) in enumerate(found):
        if i is None or i % every:
            continue
        scores = sorted((-int(v @ w), j is None, j or 0) for b, (j, w) in enumerate(found) if b != a)[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return Counter(out)


@pytest.mark.parametrize("k,every,size,lot", [(20, 20, 512, 10**9), (3, 7, 8, 10**9), (5, 2, 4, 400), (500, 20, 16, 10**9)])
def test_top_k(vectors, monkeypatch, k, every, size, lot):
    of, rows = vectors
    monkeypatch.setattr(topk, "BLOCK", size)
    monkeypatch.setattr(topk, "WINDOW", 4)
    monkeypatch.setattr(topk, "RANGE", size)
    got = topk.top_inner_products(of(rows), k, every, query_bytes=lot).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, k, every)


def test_top_k_of_copies_and_large_entries(vectors, monkeypatch):
    of, _ = vectors
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "RANGE", 32)
    rng = np.random.default_rng(8)
    rows = [(i, [1, 2, 3, 4, 5]) for i in range(150)] + [(i, rng.normal(size=5) * 1e4) for i in range(150, 200)]
    got = topk.top_inner_products(of(rows)).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 20, 20)
    assert topk.top_inner_products(of([])).count() == 0
    assert topk.top_inner_products(of([(0, [1])])).count() == 0
    assert topk.top_inner_products(of([(0, []), (1, [])])).count() == 0
    assert topk.top_inner_products(of([(1, [1.0]), (2, [2.0])])).count() == 0
    most = topk.top_inner_products(of([(0, [3e38, -3e38]), (1, [3e38, -3e38])])).collect()
    assert most[0].score == 2 * topk.limit(2) ** 2


def test_blocks_below_the_bound_are_not_scored(vectors, spark):
    """Bounds hold for every vector of a block, and a cluster far away is left out."""
    rng = np.random.default_rng(1)
    q, docs = rng.integers(-9, 9, (20, 5)), rng.integers(-9, 9, (50, 5))
    assert (bound := topk.bounds(q, docs.max(0)[None], docs.min(0)[None])[:, 0]).shape == (20,) and (q @ docs.T <= bound[:, None]).all()
    seen = []

    class Counting(topk.Best):
        def add(self, at, scores, keys, rows, own):
            seen.append(len(at))
            super().add(at, scores, keys, rows, own)

    best = Counting(1, 2, np.array([topk.LOW]), np.array([topk.NO_KEY]))
    best.add(np.array([0]), np.array([[5, 9, 9, 1]]), np.array([4, 3, 2, 1]), np.arange(4), np.array([3]))
    assert best.score.tolist() == [9, 9] and best.key.tolist() == [2, 3] and best.floor[0] == 9 and best.floor_key[0] == 3


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    keys = [f"key{i}".encode() for i in range(n)]
    sizes, bits, stored = phash.build(keys)
    hashed = phash.PerfectHash(sizes, bits, phash.binary(stored))
    asked = keys + [f"other{i}".encode() for i in range(n)]
    slots = hashed.slots(phash.binary(asked), phash.digests(asked))
    assert sorted(slots[:n]) == list(range(n)) and (slots[n:] == -1).all()
    assert [stored[s] for s in slots[:n]] == keys
    empty = phash.PerfectHash(*(lambda b: (b[0], b[1], phash.binary(b[2])))(phash.build([])))
    assert (empty.slots(phash.binary(asked), phash.digests(asked)) == -1).all()


def brute_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    df, counts = Counter(), Counter()
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for (own, t), n in df.items() if own == lang and n >= least]
        sources = {d[1] for d in docs if d[0] == lang}
        p = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            total = sum(n.values()) + 5 * len(kept)
            p[s] = {t: (1 + 10**9 * (n[t] + 5) // total, n[t]) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t][0] - p[o][t][0]) for t in kept), o.encode(), o) for o in sources if o != s)
            tops = sorted((p[None][t][0] - p[s][t][0], t.encode(), t) for t in kept if p[s][t][1] and p[s][t][0] > p[None][t][0])
            out |= {(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(tops[:ranks])}
    return out


def divergence_rows():
    random.seed(4)
    words = ["Alpha", "beta", "GAMMA", "dé", "ÉLAN", "x", "straße", "日本", "to_be", "a1b", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(i, " ".join(random.choices(words, weights=range(1, len(words) + 1), k=random.randrange(40))), random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "S3", None, "é"])) for i in range(300)]
    return rows + [(900, None, "en", "alone"), (901, "", "xx", "s1"), (902, "...", "xx", "s2"), (903, "one", "yy", None), (904, "long" * 200, "en", "s1"), (905, "long" * 200, "en", "s2"), (905, "long" * 200, "en", "s2")]


@pytest.mark.parametrize("least,ranks,most,keys", [(30, 50, 48_000_000, 4096), (3, 5, 200, 4), (1, 2, 1, 2)])
def test_divergence(spark, monkeypatch, least, ranks, most, keys):
    monkeypatch.setattr(divergence, "SHARD_KEYS", keys)
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 2 if keys < 4096 else 64)
    monkeypatch.setattr(divergence, "MOST_COUNTS", 10 if keys < 4096 else 300_000)
    monkeypatch.setattr(divergence, "MOST_SLOTS", 10 if keys < 4096 else 8_000_000)
    monkeypatch.setattr(divergence, "MOST_PARTS", 2 if keys < 4096 else 1000)
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, "c", 1, "t") for r in rows], "doc_id long, text string, lang string, source string, term string, total int, item string")
    got = divergence.source_divergence(docs, least, ranks, most).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows, least, ranks)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).count() == 0
    one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.source_divergence(one).count() == 0


def test_chances_are_exact():
    counts = np.array([0, 1, 2**40], np.int64)
    total = 2**40 + 1
    assert divergence.chances(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 15) for c in counts]
