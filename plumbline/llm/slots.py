"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map sends slots to shards.

A record's slot depends on its id and text only and never changes. Bytes are added up per slot, so what reaches the driver
is one row a slot whatever the table's size. The map starts as slot modulo shards and is edited: overfull shards
give up slots, which go to the emptiest shards, until the sizes are near equal. Every edit makes a new version.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import hidden, need, quoted, whole_text
from plumbline.session import cut_lineage

SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 8


@dataclass
class SlotMap:
    """Which shard holds each slot; ``moved`` lists the slots that the last edit moved."""

    version: int
    shards: list[int]
    n_shards: int
    moved: list[int] = field(default_factory=list)

    @classmethod
    def first(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(0, [s % n_shards for s in range(slots)], n_shards)

    def rebalanced(self, sizes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version: near equal bytes a shard, moving slots of overfull shards only."""
        count = n_shards or self.n_shards
        homes: list[list[int]] = [[] for _ in range(count)]
        pool = []
        for slot, shard in enumerate(self.shards):
            (homes[shard] if shard < count else pool).append(slot)
        load = [sum(sizes.get(s, 0) for s in home) for home in homes]
        mean = sum(sizes.values()) / count
        for shard, home in enumerate(homes):
            home.sort(key=lambda s: (sizes.get(s, 0), s))
            while load[shard] > mean and len(home) > 1:
                slot = home.pop()
                load[shard] -= sizes.get(slot, 0)
                pool.append(slot)
        heap = [(load[k], k) for k in range(count)]
        heapq.heapify(heap)
        for slot in sorted(pool, key=lambda s: (-sizes.get(s, 0), s)):
            size, shard = heapq.heappop(heap)
            homes[shard].append(slot)
            load[shard] = size + sizes.get(slot, 0)
            heapq.heappush(heap, (load[shard], shard))
        for _ in range(4 * count):  # even out the fullest against the emptiest
            high, low = max(range(count), key=lambda k: (load[k], k)), min(range(count), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            fitting = [s for s in homes[high] if 0 < sizes.get(s, 0) < gap]
            if not fitting:
                break
            slot = min(fitting, key=lambda s: (abs(gap - 2 * sizes[s]), s))
            homes[high].remove(slot)
            homes[low].append(slot)
            load[high] -= sizes[slot]
            load[low] += sizes[slot]
        shards = list(self.shards)
        for shard, home in enumerate(homes):
            for slot in home:
                shards[slot] = shard
        moved = [s for s, (a, b) in enumerate(zip(self.shards, shards)) if a != b]
        return SlotMap(self.version + 1, shards, count, moved)

    def frame(self, spark) -> DataFrame:
        """The map as a table (version, slot, shard), one row a slot."""
        return spark.createDataFrame([(self.version, s, k) for s, k in enumerate(self.shards)], "version int, slot int, shard int")

    def store(self, spark, path: str) -> None:
        """Append this version to the map table."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.parquet(path)
        chosen = version if version is not None else table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == chosen).orderBy("slot").collect()  # one row a slot
        return cls(chosen, [r["shard"] for r in rows], max(r["shard"] for r in rows) + 1)


def slot_of(id_col: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col, text), F.lit(slots)).cast("int")


def byte_size(text: Column) -> Column:
    return (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint")


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, int]:
    """Bytes per slot: one row a slot."""
    text = whole_text(text_col)
    sums = docs.groupBy(slot_of(quoted(id_col), text, slots).alias("slot")).agg(F.sum(byte_size(text)).alias("bytes"))
    return {r["slot"]: r["bytes"] for r in sums.collect()}


def shard(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, current: SlotMap | None = None,
    store: str | None = None, prefix: str = "shard_",
) -> tuple[DataFrame, SlotMap]:
    """All rows with ``shard_size``, ``shard_slot`` and ``shard_no``, and the map that places them.

    ``current`` is edited, or the first map of ``n_shards``; ``store`` keeps the new version in a map table. A null text is an
    empty one; null ids hash like any value; repeated rows share a slot; empty tables keep an even map. Columns of the input
    stay, and a prefix that clashes is an error. A single slot is never split, so a record larger than a shard's share
    leaves its shard larger.
    """
    need(docs, id_col, text_col)
    names = [prefix + n for n in ("size", "slot", "no")]
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"prefix {prefix!r} clashes with a column of the table")
    spark = docs.sparkSession
    base = current or SlotMap.first(n_shards, slots)
    new = base.rebalanced(slot_bytes(docs, id_col, text_col, len(base.shards)), n_shards)
    if store:
        new.store(spark, store)
    text = whole_text(text_col)
    (key,) = hidden(docs, "slot_key")
    table = new.frame(spark).select(F.col("slot").alias(key), F.col("shard").alias(names[2]))
    rows = docs.withColumn(names[0], byte_size(text)).withColumn(names[1], slot_of(quoted(id_col), text, len(base.shards)))
    placed = rows.join(F.broadcast(table), F.col(names[1]) == F.col(key))  # one row a slot
    return placed.select(*[quoted(c) for c in docs.columns], *[F.col(n) for n in names]), new


def positions(rows: DataFrame, shard_col: str, slot_col: str, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their gapless place in their shard: slots in order, rows in order inside a slot.

    Only a slot's rows are sorted together; the places before a slot come from one count a slot.
    """
    rows = cut_lineage(rows)
    counts = rows.groupBy(quoted(shard_col).alias("c_shard"), quoted(slot_col).alias("c_slot")).agg(F.count(F.lit(1)).alias("c_n"))
    before = F.coalesce(F.sum("c_n").over(W.partitionBy("c_shard").orderBy("c_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("c_slot", before.alias("c_start"))
    inside = F.row_number().over(W.partitionBy(quoted(slot_col)).orderBy(*[quoted(c) for c in order])) - 1
    return (
        rows.withColumn("c_row", inside).join(F.broadcast(starts), quoted(slot_col) == F.col("c_slot"))  # one row a slot
        .withColumn(name, (F.col("c_start") + F.col("c_row")).cast("bigint")).drop("c_row", "c_slot", "c_start")
    )
