"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.order_stats import bounded_join
from plumbline.session import cut_lineage, is_small


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        bounded_join(both, low, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = bounded_join(down, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of a small table of links (u, v)."""
    kind = edges.schema["u"].dataType.simpleString()

    def join(table: pa.Table) -> pa.Table:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        types = table.schema.field("u").type
        return pa.table({"node": pa.array(nodes, types), "component": pa.array([root(x) for x in nodes], types)})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(join, f"node {kind}, component {kind}")


def components(edges: DataFrame, a: str = "key_a", b: str = "key_b", one_task: bool = False) -> DataFrame:
    """(node, component): the component is named by its smallest node. Nodes without edges are absent.

    Minima combine before the shuffle, so a node with very many neighbours stays cheap. Each round
    is checkpointed, which bounds the plan and survives lost executors. With ``one_task`` a written table of
    links that is small is joined in one task instead; the result is the same.
    """
    if one_task and is_small(edges, 8.0):
        return _in_one_task(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"))
    work = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    while True:
        work = cut_lineage(_small_star(_large_star(work)))
        ends = work.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
            work.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root"))
        )
        # done when every node has one link and no root is linked further: disjoint stars
        loose = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR (up = 1 AND root = 1)")
        if loose.isEmpty():
            break
    roots = work.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
