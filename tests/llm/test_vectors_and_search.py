"""Vector codes, vector links and ranked search against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from factspring.llm import queries, ranked_search, vector_codes, vector_dedup
from oracle import connect, rows_of, rows_of_sql

VECTORS = "vec_id long, embedding array<float>, label int, node string, kind string, weight string, list string, code string, own string, `a.b` string"
SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, *["x"] * 7) for i, v, l in rows], VECTORS)


def f32(values):
    return [None if x is None else float(np.float32(x)) for x in values]


def cloud(seed, n, size, spread=0.1, groups=6):
    """Groups of near copies, exact copies, scaled copies, ties; nulls, zeros and odd numbers among them."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, size))
    rows = [(i, f32(centres[i % groups] + spread * rnd.normal(size=size)), int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(5)] + [(n + 5, f32(np.array(rows[0][1]) * 2), 0), (n + 6, rows[0][1], 1)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * size, 0), (n + 12, [None, *rows[0][1][1:]], 0), (n + 13, [float("nan"), *rows[0][1][1:]], 0), (n + 14, [float("inf"), *rows[0][1][1:]], 0), (n + 15, [-float("inf"), *rows[0][1][1:]], None)]
    rows += [(n + 16, rows[0][1], None), (n + 17, rows[1][1], None), (n + 18, [], 0)]
    return rows


def plain_codes(rows, rounds=6):
    kept = sorted(((i, [math.floor(4096 * x) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    wide = len(kept[0][1]) // 8
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[near(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else c for j, c in enumerate(book)]
    final = [(i, l, [near(part(v, p), books[p]) for p in range(8)]) for i, v, l in kept]
    by_label = collections.Counter()
    for _, l, m in final:
        by_label[l] += sum(d for d, _ in m)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, "".join(f"{j:02x}" for _, j in m), sum(d for d, _ in m), by_label[l], digest) for i, l, m in final)


@pytest.mark.parametrize("rows", [cloud(1, 150, 16), cloud(2, 9, 8), [(i, [float(i % 3)] * 8, None) for i in range(40)], [(i, [(-1.0) ** i * 2**-12 * (i % 5)] * 16, i % 2) for i in range(60)]])
def test_vector_codes(spark, rows):
    out = vector_codes.encode_vectors(vectors(spark, rows + rows[:2]).repartition(3)).collect()
    assert sorted(tuple(r) for r in out) == plain_codes(rows + rows[:2])


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.encode_vectors(vectors(spark, [])).count() == 0
    assert vector_codes.encode_vectors(vectors(spark, [(1, [1.0] * 7, 0), (2, [1.0] * 8, 0)])).count() == 0  # 8 doesn't divide the first
    out = vector_codes.encode_vectors(vectors(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 16, 0), (3, [1e30] * 8, 0), (None, [2.0] * 8, 0)])).collect()
    assert {(r.vec_id, r.error) for r in out} == {(1, 0), (None, 0)}


def test_bounds_save_scans_and_never_change_a_choice():
    rnd = np.random.default_rng(5)
    points = rnd.integers(-40, 40, (4000, 4))
    points[:2000] = points[:20].repeat(100, 0)
    entries = points[:16].copy()
    group = vector_codes.grouped(entries)
    state = vector_codes.Bounds.unknown(len(points), int(group.max()) + 1)
    for n in range(8):
        state.assign(points, entries, group)
        assert (state.own == vector_codes.squared(points, entries).argmin(1)).all()
        exact = np.sqrt(vector_codes.squared(points, entries))
        assert (state.upper >= exact[np.arange(len(points)), state.own]).all()
        exact[np.arange(len(points)), state.own] = np.inf
        assert all((state.lower[:, g] <= exact[:, group == g].min(1)).all() for g in range(state.lower.shape[1]))
        new = np.array([points[state.own == j].sum(0) // max(1, (state.own == j).sum()) if (state.own == j).any() else entries[j] for j in range(16)])
        state.drift(entries, new, group)
        entries = new
    assert state.scanned < 0.9 * 8 * 16 * len(points)  # entries still move in every round here


def plain_links(rows, cosine=0.93):
    fine = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, seen = collections.Counter(), {i: i for i, _, _ in rows}

    def root(x):
        while seen[x] != x:
            x = seen[x]
        return x

    for a, (i, v, l) in enumerate(fine):
        for j, w, m in fine[:a]:
            if l == m and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((root(i), root(j)))
                    seen[q] = p
    return sorted((i, links[i], root(i), root(i) == i) for i, _, _ in rows)


@pytest.mark.parametrize("rows", [cloud(1, 400, 24, 0.05), cloud(2, 300, 24, 0.2), cloud(3, 300, 16, 0.3, 40), cloud(4, 200, 3, 0.5), cloud(5, 60, 1), [(i, [1.0, 0.0], 1) for i in range(50)], [(i, [math.cos(i / 9), math.sin(i / 9)], 1) for i in range(300)]])
def test_vector_links(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MEMBERS", 40)  # so that lists and their queries are dealt out
    monkeypatch.setattr(vector_dedup, "QUERIES", 50)
    out = vector_dedup.link_vectors(vectors(spark, rows).repartition(4)).collect()
    assert sorted(tuple(r) for r in out) == plain_links(rows)


def test_vector_links_of_odd_tables(spark):
    assert vector_dedup.link_vectors(vectors(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [3e38, 0.0], 1), (5, [1e-38, 0.0], 1), (6, None, None)]
    out = sorted((tuple(r) for r in vector_dedup.link_vectors(vectors(spark, rows)).collect()), key=repr)
    assert out == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 0, None, True), (3, 0, 3, True), (4, 3, 1, False), (5, 3, 1, False), (6, 0, 6, True)], key=repr)
    assert all(r.kept and r.n_links == 0 for r in vector_dedup.link_vectors(vectors(spark, [(1, None, 1), (2, [1.0], None)])).collect())


def plain_search(docs, items, k):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, w) for d, t in docs if (w := words(t))]
    many, length = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    out = []
    for item in {i for i, _ in items if i is not None}:
        terms = {w for i, t in items if i == item for w in words(t)}
        scores = []
        for d, w in held:
            counts, m = collections.Counter(w), 50 + 50 * len(w) * many // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 20 * m)) for t in terms if counts[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, n, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def library(seed, n):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(400)] + ["É", "İx", "über", "ſs"]
    docs = [(i, rnd.choice(["", ". ", "\n"]).join(rnd.choice(words) + rnd.choice([" ", "-", "\x00"]) for _ in range(rnd.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "- _"), (n + 43, docs[0][1].upper()), (docs[1]), (None, docs[2][1]), (n + 44, "w1 " * 20000), (n + 45, "w2" * 9000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(25)] + [(30, None), (31, ""), (None, "w1"), (32, "nowhere"), (33, "W1 w1 w2"), (3, "É w9"), (34, docs[4][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "n", "quotas"), [(1, 600, (4, 64)), (2, 900, (1, 4)), (3, 900, (1, 2)), (4, 20, (1, 4))])
def test_ranked_search(spark, monkeypatch, seed, n, quotas):
    monkeypatch.setattr(ranked_search, "QUOTAS", quotas)
    docs, items = library(seed, n)
    extra = "doc_id long, text string, term string, tier string, score string, items string, `a.b` string"
    given = spark.createDataFrame([(d, t, *["x"] * 5) for d, t in docs], extra).repartition(5)
    out = ranked_search.search(given, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(tuple(r) for r in out.drop("tier").collect()) == plain_search(docs, items, 10)
    levels = {r.tier for r in out.select("tier").distinct().collect()}
    assert quotas != (1, 2) or len(levels) > 1  # some items are proven high, others fall through


def test_items_answered_in_sets_and_empty_tables(spark, monkeypatch):
    docs, items = library(7, 200)
    given, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "VOCABULARY", 60)
    assert sorted(tuple(r) for r in ranked_search.search(given, asked, 5).drop("tier").collect()) == plain_search(docs, items, 5)
    assert ranked_search.search(given.limit(0), asked).count() == 0 and ranked_search.search(given, asked.limit(0)).count() == 0


def test_strongest_steps_make_the_tiers():
    steps = np.zeros((3, ranked_search.STEPS), np.int64)
    steps[0, [10, 20, 30]] = 5, 3, 2
    steps[1, 40] = 100
    steps[2, [0, 255]] = 1, 1
    a, b = ranked_search.tiers(steps, np.array([2, 3, 4]), [6, 10])
    at = lambda s: -(-s * ranked_search.TOP // ranked_search.STEPS)
    assert a.cut[0] in range(at(10) + 1, at(20) + 1) and a.cut[1] == at(40) and a.cut[2] == 0
    assert b.cut[0] == 0 and b.rest[0] == 0 and a.rest[1] == 3 * (at(40) - 1)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_vector_dedup", "op13_ranked_search"])
def test_queries_match_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), queries.ORACLES[name])
