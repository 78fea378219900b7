"""The gate suite in one aggregate against each query run alone, and injection against draws in order."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import gates as g
from plumbline.operators.inject import Family, inject
from plumbline.operators.sampling import assign_folds, stratified_sample

QUERIES = [
    g.GateQuery("S1", "d", "x", ("v",), "s", "sum", ("v",), 2),
    g.GateQuery("S2", "d", "x", ("v", "w"), "r", "ratio", ("v", "w"), 4, where="v > 1"),
    g.GateQuery("S3", "d", "x", ("k",), "n", "distinct", ("k",)),
    g.GateQuery("S4", "d", "x", ("v",), "p", "percentile", ("v",), 3, share=0.9),
    g.GateQuery("S5", "d", "x", ("v",), "n", "count", where="v > 1000000"),
    g.GateQuery("T1", "d", "x", ("k", "v"), "a", "avg", ("v",), 2, by="k"),
    g.GateQuery("T2", "d", "x", ("k", "w"), "a", "sum", ("w",), by="k", top=2, ranked=True),
    g.GateQuery("T3", "d", "x", ("c",), "n", "count", by="c", top=3),
    g.GateQuery("T4", "d", "x", ("k", "v"), "a", "avg", ("v",), 1, where="k LIKE 'A%'", by="k", top=3),
]


def alone(spark, t):
    """Every query and condition as its own SQL."""
    cols = t.truth.columns
    views = {
        "true": lambda q: t.truth, "dirty": lambda q: t.dirty.select(*cols), "clean": lambda q: g.quarantine(t.dirty, t.score, t.tau).select(*cols),
        "repaired": lambda q: g.repair(t.dirty, t.truth, t.key, t.score, t.tau),
        "coupled": lambda q: g.coupled(t.dirty, t.prov, t.key, t.score, t.tau, q.columns).select(*cols),
    }
    out = []
    for q in QUERIES:
        for c, view in views.items():
            for r in spark.sql(q.sql, table=view(q)).collect():
                out.append((q.id, c, *["NULL" if v is None else v.strip().lower() if isinstance(v, str) else f"{round(float(v), 4) + 0.0:.4f}" for v in r]))
    return sorted(out)


def together(spark, t):
    out = []
    for r in g.run_gate(spark, QUERIES, {"d": t}).collect():
        cells = r["row"].split("|")
        shown = lambda x: x if x == "NULL" or not any(ch.isdigit() for ch in x) else f"{float(x):.4f}"
        out.append((r["query_id"], r["condition"], *[shown(x) for x in cells]))
    return sorted(out)


@pytest.fixture
def tables(spark):
    rows = [(i, [None, " Aa", "Ab", "B", "c"][i % 5], None if i % 11 == 0 else i % 4, None if i % 7 == 0 else float(i % 13), float(i % 3) - 1) for i in range(200)]
    truth = spark.createDataFrame(rows, "id bigint, k string, c bigint, v double, w double")
    dirty = truth.withColumn("v", F.when(F.col("id") % 9 == 0, F.col("v") * 1000).otherwise(F.col("v")))
    dirty = dirty.unionByName(truth.filter("id % 20 = 3").withColumn("id", F.col("id") + 1000))
    dirty = dirty.withColumn("score", F.when((F.col("id") % 9 == 0) | (F.col("id") > 900), 0.9).otherwise(0.1))
    return g.GateTables(truth, dirty, g.provenance(dirty, truth, "id", "score", 0.5), "id", "score", 0.5)


def test_suite_equals_single_queries(spark, tables):
    assert together(spark, tables) == alone(spark, tables)


def test_suite_on_an_empty_table(spark, tables):
    none = g.GateTables(tables.truth.limit(0), tables.dirty.limit(0), tables.prov.limit(0), "id", "score", 0.5)
    assert together(spark, none) == alone(spark, none)


def test_two_scans_a_dataset(spark, tables):
    stored = {n: spark.read.parquet(p) for n, p in ((n, _written(getattr(tables, n))) for n in ("truth", "dirty", "prov"))}
    t = g.GateTables(stored["truth"], stored["dirty"], stored["prov"], "id", "score", 0.5)
    plan = g.conditioned(t, [("v",)])._jdf.queryExecution().optimizedPlan().toString()
    paths = [line for line in plan.splitlines() if "Relation" in line]
    assert len(paths) <= 4  # truth, dirty, the keys of held rows and their provenance


def _written(df):
    from plumbline.session import scratch_path

    path = scratch_path(df.sparkSession, "t")
    df.write.parquet(path)
    return path


FAMILIES = [
    Family("a", "x", {"x": "-x"}, "x >= 0"), Family("b", "y", {"y": "y * 2"}, "y IS NOT NULL"), Family("c", "id", {}, "x > 1", copy=True), Family("d", "x", {"x": "x + 1"}, rate=0.2),
]


@pytest.mark.parametrize("seeds", [42, [1, 2, 3]])
@pytest.mark.parametrize("plan", ["small", "large"])
def test_injection_draws_in_order(spark, plan, seeds):
    rows = [(i, float(i % 5), None if i % 3 == 0 else i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, y bigint")
    if plan == "large":
        spark.conf.set("spark.plumbline.smallBytes", "0")
    try:
        got = sorted((r["injection_rng_seed"], r["anomaly_type"], r["row_id"]) for r in inject(df, "id", FAMILIES, 0.1, seeds)[1].collect())
    finally:
        spark.conf.unset("spark.plumbline.smallBytes")
    want, offset = [], 300
    for seed in [seeds] if isinstance(seeds, int) else seeds:
        used = set()
        draw = lambda f, i: hashlib.md5(f"{seed}|{f}|{i}".encode()).hexdigest()  # noqa: B023, E731
        ok = {"a": lambda r: r[1] >= 0, "b": lambda r: r[2] is not None, "c": lambda r: r[1] > 1, "d": lambda r: True}
        same = {"a": lambda r: r[1] == 0, "b": lambda r: r[2] == 0, "c": lambda r: False, "d": lambda r: False}
        for f in FAMILIES:
            free = sorted((r for r in rows if r[0] not in used and ok[f.name](r)), key=lambda r: draw(f.name, r[0]))
            for r in free[: math.ceil(300 * (f.rate or 0.1))]:
                if f.copy:
                    want.append((seed, f.name, r[0] + offset))
                elif not same[f.name](r):
                    used.add(r[0])
                    want.append((seed, f.name, r[0]))
    assert got == sorted(want)


@pytest.mark.parametrize("plan", ["small", "large"])
def test_null_class_and_stratum_get_their_share(spark, plan):
    df = spark.createDataFrame([(i, None if i < 20 else i % 2) for i in range(100)], "id bigint, y int")
    if plan == "large":
        spark.conf.set("spark.plumbline.smallBytes", "0")
    try:
        folds = {(r["y"], r["fold"]): r["count"] for r in assign_folds(df, 5, "id", label="y").groupBy("y", "fold").count().collect()}
        taken = {r["y"]: r["count"] for r in stratified_sample(df, "y", 50, "id").groupBy("y").count().collect()}
    finally:
        spark.conf.unset("spark.plumbline.smallBytes")
    assert all(folds[y, f] == n for y, n in ((None, 4), (0, 8), (1, 8)) for f in range(5))
    assert taken == {None: 10, 0: 20, 1: 20}
