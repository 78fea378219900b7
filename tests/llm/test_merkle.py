"""Manifest and witnesses against trees built level by level."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def witness_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 16 * 16
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])))
        i //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 255, 256])
def test_appender(n):
    nodes = [h(str(k)) for k in range(n)]
    levels = levels_of(nodes)
    grown = merkle.Appender(merkle.height(n))
    for k, v in enumerate(nodes):
        grown.append(v)
        assert [x.digest for x in grown.leaves] == nodes[: k + 1]
    assert grown.finish() == levels[-1][0]
    for k, leaf in enumerate(grown.leaves):
        assert grown.witness(leaf) == witness_of(levels, k)
        assert merkle.fold(nodes[k], grown.witness(leaf)) == levels[-1][0]


def test_partial_witness_grows():
    grown = merkle.Appender(2)
    for k in range(18):
        grown.append(h(str(k)))
    first = grown.leaves[0]
    assert "".join(first.right) == "".join(h(str(k)) for k in range(1, 16)) and first.parent.right == []
    grown.finish()
    assert "".join(first.parent.right) == h(h("16") + h("17"))


def brute(rows, fields, changed):
    """rows: dicts; gives (id, leaf, subroot, root, proof, folded, verified)."""

    def leaf(r):
        return h("".join("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in fields))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, placed = {}, {}
    for s in order:
        placed[s] = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = levels_of([leaf(r) for r in placed[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, r in enumerate(placed[s]):
            path = witness_of(trees[s], i) + witness_of(top, k)
            folded = leaf(changed(r))
            for a, b in path:
                folded = h(a + folded + b)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def changed(r):
    return r | {"text": r["text"].lower()} if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 3 == 0 else r


def proofs(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["text"], 1, "x") for r in rows], "doc_id bigint, source string, text string, idx int, tree string")
    m = merkle.build(df, ["doc_id", "source", "text"], changed={"text": F.lower("text")}, where=F.col("doc_id") % 3 == 0)
    return m, sorted((tuple(r) for r in m.proofs().collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(merkle, "sized_broadcast", lambda df: df)
    rng = random.Random(1)
    rows = [{"doc_id": k, "source": "hot" if k % 3 else rng.choice([None, "", "é", "z", "Z", f"s{k % 40}"]), "text": rng.choice(["Ab", "low", None, "", "é A"])} for k in range(900)]
    rows += [rows[5], rows[5], {"doc_id": None, "source": None, "text": "A"}, {"doc_id": 7, "source": "hot", "text": "other"}]
    rng.shuffle(rows)
    manifest, got = proofs(spark, rows)
    assert got == brute(rows, ["doc_id", "source", "text"], changed)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    if small:
        for r in manifest.witnesses().take(50):
            assert merkle.fold(r["leaf"], [x.split(":") for x in r["witness"].split("/")]) == manifest.root


@pytest.mark.parametrize("n", [1, 16, 257, 4200])
def test_one_source(spark, n):
    rows = [{"doc_id": k, "source": "s", "text": "T" * (k % 5)} for k in range(n)]
    assert proofs(spark, rows)[1] == brute(rows, ["doc_id", "source", "text"], changed)


def test_empty(spark):
    manifest, got = proofs(spark, [])
    assert got == [] and manifest.root is None and manifest.witnesses().count() == 0


def test_every_leaf_is_folded_up(spark):
    rows = [(k, "ab"[k % 2], f"text {k}") for k in range(40)]
    made = merkle.build(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), ["doc_id", "source", "text"])
    root, made.root = made.root, "0" * 64  # a root that no leaf gives
    assert {(r["folded_root"], r["verified"]) for r in made.proofs().collect()} == {(root, False)}
