"""Steps whose cost grew faster than the table: dirt, blocks over gaps, sums of gate queries, perceptrons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import gates as g
from plumbline.operators import inject, neighbors, perceptron
from plumbline.operators.stack import stack


def test_dirt_cuts_come_from_one_histogram(large, monkeypatch):
    """All rules' rows are the lowest draws of their eligible rows, and no rule joins the table."""

    def joined(*args, **kwargs):
        raise AssertionError("a rule reads the table on its own")

    monkeypatch.setattr(inject, "lowest_cut", joined)
    monkeypatch.setattr(inject, "hash_cuts", joined)
    monkeypatch.setattr(inject, "ONE_TASK", 0.0)  # the near rows count as small, the table as large
    monkeypatch.setattr(inject, "is_small", lambda df, growth=1.0: "_d0" in df.columns)
    rows = [(k, float(k) if k % 3 else None, f"t{k}") for k in range(2000)]
    df = large.createDataFrame(rows, "id long, x double, t string")
    rules = [inject.Dirt("spikes", "x", "x * 10", 120, "x > 0"), inject.Dirt("words", "t", "upper(t)", 50), inject.Dirt("all", "x", "x + 1", 9999, "id < 7")]
    got = {r["id"]: (r["x"], r["t"]) for r in inject.inject_dirt(df, "id", rules).collect()}
    draws = {r["id"]: r for r in df.select("id", *[inject.draw(42, r.name, "id").alias(r.name) for r in rules]).collect()}
    lowest = lambda name, ids, n: set(sorted(ids, key=lambda k: draws[k][name])[:n])
    spikes = lowest("spikes", [k for k, x, _ in rows if x is not None and x > 0], 120)
    words = lowest("words", [k for k, _, _ in rows], 50)
    for k, x, t in rows:
        value = x * 10 if k in spikes else x
        assert got[k] == (value + 1 if k < 7 and value is not None else value, t.upper() if k in words else t)


def test_gate_rows_are_added_up_before_they_are_dealt(spark):
    truth = spark.createDataFrame([(k, float(k), f"g{k % 3}") for k in range(60)], "k long, v double, w string")
    dirty = truth.withColumn("score", F.when(F.col("k") % 7 == 0, 0.9).otherwise(0.1)).withColumn("v", F.when(F.col("k") % 14 == 0, F.col("v") * 50).otherwise(F.col("v")))
    dirty = dirty.unionByName(spark.createDataFrame([(100, 5.0, "g9", 0.8)], "k long, v double, w string, score double"))
    t = g.GateTables(truth, dirty, g.provenance(dirty, truth, "k", "score", 0.5), "k", "score", 0.5)
    queries = [g.GateQuery("a", "d", "s", ("v",), "total", "sum", ("v",)), g.GateQuery("b", "d", "s", ("v",), "n", "count", where="v > 20"), g.GateQuery("c", "d", "s", ("w", "v"), "m", "avg", ("v",), by="w"), g.GateQuery("e", "d", "s", ("w",), "n", "distinct", ("w",))]
    plan = g._added(list(enumerate(queries[:2])), t)._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert plan.rfind("Aggregate") > plan.rfind("Generate")
    long = g.conditioned(t, [q.columns for q in queries])
    for k, q in enumerate(queries):
        used = long.filter(f"(condition <> 'coupled' OR _u{k})" + (f" AND {q.where}" if q.where else ""))
        by = q.by or ("w" if q.measure == "distinct" else None)
        want = used.groupBy("condition", *([by] if by else [])).agg(F.sum("v").alias("x"), F.count(F.lit(1)).alias("n")).collect()
        got = g._added([(k, q)], t).collect()
        sums = lambda rows, name: sorted((r["condition"], r[name] if by else None, r["n"], round(r["x"], 6) if q.measure in ("sum", "avg") else None) for r in rows)  # noqa: E731, B023
        assert sums(got, "text") == sums(want, by)


def test_blocks_follow_the_columns_that_bound(spark):
    """No cuts in a column that no query has; points with other gaps lie apart; the neighbours are those of all pairs."""
    rng = np.random.default_rng(3)
    table = rng.integers(0, 60, (900, 4)).astype(float) * [1000, 1, 1, 1]
    rows = [(k, *[None if (j == 0 and k % 9 == 4) or (j == 1 and k % 14 == 5) else float(x) for j, x in enumerate(r)]) for k, r in enumerate(table)]
    df = spark.createDataFrame(rows, "pid long, a double, b double, c double, d double").withColumn("mult", F.lit(1).cast("long"))
    asking, donors = df.filter("a IS NULL"), df.filter("a IS NOT NULL")
    assert neighbors._cut_columns(asking, donors, ["a", "b", "c", "d"]) == (["b", "c", "d"], ["b"], 0)
    block = neighbors.BLOCK
    try:
        neighbors.BLOCK = 40
        got = {}
        for r in neighbors.nearest(asking, donors, ["a", "b", "c", "d"], 3).collect():
            got.setdefault(r["pid"], []).append((r["dist"], r["nid"]))
    finally:
        neighbors.BLOCK = block
    points = {r[0]: np.array([np.nan if x is None else x for x in r[1:]]) for r in rows}
    given = np.array([k for k, p in points.items() if not np.isnan(p[0])])
    assert len(got) == asking.count()
    for k, found in got.items():
        want = neighbors._distances(points[k][None, :], np.stack([points[i] for i in given]))[0]
        order = np.lexsort((given, want))[:3]
        assert [i for _, i in sorted(found)] == given[order].tolist()


def test_perceptron_folds_share_their_passes(spark, monkeypatch):
    """The gradient is that of the loss; models of all folds are fitted in common passes, learn what no line separates, and rerun alike."""
    layers = [3, 5, 4, 2]
    rng = np.random.default_rng(1)
    w, x, y = perceptron.start(layers, 1), rng.random((3, 40)), (rng.random(40) < 0.4).astype(float)
    gradient = perceptron.loss(w, layers, x, y)[1]
    near = [(perceptron.loss(w + 1e-6 * d, layers, x, y)[0] - perceptron.loss(w - 1e-6 * d, layers, x, y)[0]) / 2e-6 for d in np.eye(len(w))]
    assert np.abs(gradient - near).max() < 1e-5
    passes = []
    sums = perceptron._sums
    monkeypatch.setattr(perceptron, "_sums", lambda *a: passes.append(len(a[2])) or sums(*a))
    table = rng.random((400, 2))
    rows = [(k, int((a > 0.5) != (b > 0.5)), float(a), float(b)) for k, (a, b) in enumerate(table)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    out = stack(df, "k", "y", ["a", "b"], "perceptron", folds=2, name="p").collect()
    assert len(out) == 400 and len(passes) < 200 and passes[0] == 2
    assert sum((r["p"] > 0.5) == (r["y"] == 1) for r in out) > 340


def test_perceptron_reads_chunks_from_small_files(spark, monkeypatch):
    """A task holds a few chunks, not its partition: files are bounded by bytes, and a step's sums are those of all rows at once."""
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), float(x), float(z), int(k % 3)) for k, (x, z) in enumerate(rng.normal(size=(2400, 2)))]
    df = spark.createDataFrame(rows, "y int, a double, b double, _fold int").repartition(24)
    monkeypatch.setattr(perceptron, "HELD", 4000)
    seen, sums = [], perceptron._sums
    monkeypatch.setattr(perceptron, "_sums", lambda packed, *rest: seen.append(packed) or sums(packed, *rest))
    perceptron.fit(df, "y", ["a", "b"], [3], 2, 1)
    assert len(seen[0].inputFiles()) > 2400 * 40 // 4000 / 2
    w = perceptron.start([2, 3, 2], 1)
    got = sums(seen[0], [2, 3, 2], {0: w, 7: w})
    table = np.array(rows)
    for m in (0, 7):
        use = table[table[:, 3] != m]
        value, gradient = perceptron.loss(w, [2, 3, 2], use[:, 1:3].T, use[:, 0])
        assert abs(got[m][0] - value / len(use)) < 1e-12 and np.allclose(got[m][1], gradient / len(use), atol=1e-12)


@pytest.mark.parametrize("gaps", [False, True])
def test_queries_of_many_features_move_once_a_part(spark, monkeypatch, gaps):
    """With many features a query goes to parts of many blocks, once each, and finds the same neighbours as by blocks and by brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 10)).round(2)
    rows = [(k, *[None if gaps and (k + j) % 40 == 0 else float(v) for j, v in enumerate(r)]) for k, r in enumerate(x)]
    fs = [f"c{j}" for j in range(10)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in fs)).repartition(3)
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    moved, join = [], neighbors.bounded_join
    monkeypatch.setattr(neighbors, "bounded_join", lambda big, side, on, **kw: (moved.append(big.count()) if "bound" in big.columns else None) or join(big, side, on, **kw))
    found = []
    for wide in (8, 99):
        monkeypatch.setattr(neighbors, "WIDE", wide)
        found.append({r["key"]: r["knn"] for r in neighbors.knn_distance(df, "id", fs, 3).collect()})
    assert moved[1] < moved[3] / 3 and moved[1] <= 600 * 6
    points = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    for k in range(0, 600, 7):
        d = neighbors._distances(points[k : k + 1], points)[0]
        d[k] = np.inf
        want = np.sort(d)[2]
        assert abs(found[0][k] - want) < 1e-9 and abs(found[1][k] - want) < 1e-9
    assert found[0].keys() == found[1].keys() == set(range(600))
