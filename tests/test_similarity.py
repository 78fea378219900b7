"""Similarity join, components and mismatch search against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from plumbline.operators import similarity as s
from plumbline.operators.components import components
from plumbline.operators.duplicates import name_email_mismatch, near_names


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=25)) for _ in range(30)]
    out = list(base)
    for t in base[:12]:  # near copies
        parts = t.split()
        parts[rng.randrange(25)] = rng.choice(words)
        out.append(" ".join(parts))
    out += [base[0]] * 15 + ["", "the of and"]  # a hot copy and empty documents
    return out


def cosines(docs):
    bags = [Counter(w for w in d.split() if len(w) > 1 and w not in s.STOP_WORDS) for d in docs]
    df = Counter(w for b in bags for w in b)
    n = len(docs)
    vec = []
    for b in bags:
        v = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vec.append({w: x / norm for w, x in v.items()})
    return {(i, j): sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) for i, j in combinations(range(n), 2)}


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(params=["1500", "4"])
def chunked(request, spark):
    spark.conf.set("spark.plumbline.postingChunk", request.param)
    yield
    spark.conf.unset("spark.plumbline.postingChunk")


def test_groups_and_pairs(spark, chunked):
    docs = texts()
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    sims = {p: v for p, v in cosines(docs).items() if v > 0.85}
    rep = roots(len(docs), sims)
    pairs = {(r["key_a"], r["key_b"]): r["sim"] for r in s.fuzzy_pairs(df, "id", ["text"]).collect()}
    assert all(abs(sims[p] - v) < 1e-9 for p, v in pairs.items())
    assert roots(len(docs), pairs) == rep  # copies are linked as a star, the groups are the same
    groups = {r["group_id"]: (r["size"], r["mean_sim"]) for r in s.duplicate_groups(df, "id", ["text"]).collect()}
    everything = cosines(docs)
    for g in {r for i, r in enumerate(rep) if rep.count(r) > 1}:
        rows = [i for i, r in enumerate(rep) if r == g]
        assert groups[g][0] == len(rows)
        assert abs(groups[g][1] - sum(everything[p] for p in combinations(rows, 2)) / math.comb(len(rows), 2)) < 1e-9
    kept = {r["id"] for r in s.smart_dedup(df, "id", ["text"]).collect()}
    assert kept == {i for i, r in enumerate(rep) if r == i}


def test_components_on_chains_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "key_a long, key_b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in (100, 101, 102))
    assert all(got[200 + i] == 200 for i in range(40)) and len(got) == 31 + 3 + 40


def test_near_names(spark):
    rows = [(1, "x", "smith"), (2, "x", "smyth"), (3, "x", "smit"), (4, "y", "smith"), (5, "x", "jones"), (6, "x", "smith")]
    got = {(r["name_a"], r["name_b"]) for r in near_names(spark.createDataFrame(rows, "k long, b string, n string"), ["b"], "n", "k").collect()}
    assert got == {("smit", "smith"), ("smith", "smyth")}


def test_mismatch_candidates_with_a_hot_name(spark):
    rows = [(i, "Ann Stone", f"ann.stone{i}@x.com") for i in range(50)] + [(99, "Ann Stone", "bob@x.com"), (100, "Bob Rivers", "zz9@x.com"), (101, "Kim Lee", "qqq@x.com")]
    got = {r["key"]: r["candidates"] for r in name_email_mismatch(spark.createDataFrame(rows, "id long, name string, email string"), "id", "name", "email").collect()}
    assert got == {99: [0, 1], 100: [99]}


def test_outlines_bound_every_similarity(spark):
    """The product of two outlines of any length is no smaller than the similarity, and rules most unrelated pairs out."""
    rng = random.Random(9)
    docs = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 30, 200, 700]))) for _ in range(40)]
    docs += [d + " w1" for d in docs[:10]]
    vectors = s.tfidf(s.bags(spark.createDataFrame(list(enumerate(docs)), "id long, text string"), "id", ["text"])[1]).cache()
    shapes = s.outlines(vectors).cache()
    weights = {r["doc"]: dict(zip(r["terms"], r["weights"])) for r in vectors.collect()}
    sims = {(a, b): sum(x * weights[b].get(t, 0) for t, x in weights[a].items()) for a, b in combinations(sorted(weights), 2)}
    pairs = spark.createDataFrame(list(sims), "doc_a long, doc_b long")
    for threshold in (0.05, 0.3, 0.85):
        left = {(r["doc_a"], r["doc_b"]) for r in s._likely(pairs, shapes, threshold).collect()}
        assert {p for p, v in sims.items() if v >= threshold} <= left
    assert len(left) < len(sims) / 2


@pytest.mark.parametrize("cell", [1 << 26, 2000])
def test_vectors_move_once_a_cell(spark, monkeypatch, cell):
    """A document that meets many others moves once a cell of pairs, with string keys too, and similarities stay exact."""
    rng = random.Random(4)
    docs = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 60, 150]))) for _ in range(30)]
    docs += [d + " w1 w2" for d in docs]
    vectors = s.tfidf(s.bags(spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(docs)], "id string, text string"), "id", ["text"])[1]).cache()
    weights = {r["doc"]: dict(zip(r["terms"], r["weights"])) for r in vectors.collect()}
    sims = {(a, b): sum(x * weights[b].get(t, 0) for t, x in weights[a].items()) for a, b in combinations(sorted(weights), 2)}
    moved, by_cells = [], s._by_cells
    monkeypatch.setattr(s, "CELL", cell)
    monkeypatch.setattr(s, "_by_cells", lambda pairs, rows, parts, *rest: moved.append((rows.count(), parts)) or by_cells(pairs, rows, parts, *rest))
    pairs = spark.createDataFrame(list(sims), "doc_a string, doc_b string")
    got = {(r["doc_a"], r["doc_b"]): r["sim"] for r in s._verified(pairs, vectors, 0.2, s.outlines(vectors).cache()).collect()}
    want = {p: v for p, v in sims.items() if v > 0.2}
    assert got.keys() == want.keys() and all(abs(got[p] - v) < 1e-12 for p, v in want.items())
    assert len(moved) == 2 and all(n <= len(weights) * parts for n, parts in moved)
    assert min(parts for _, parts in moved) > (10 if cell == 2000 else 1)
