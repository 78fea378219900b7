"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document of a source with target ``T`` and size ``S`` is expected ``T / S`` times: the
whole part of that is allocated for certain, the fraction is its inclusion probability ``p``. Documents are ranked by
random odds divided by inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and each source takes them in that order up to
its fixed size, the words still missing. The cut is found by histograms of the rank, each 4096 times finer than the last, so
that no source is sorted in one task. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.draws import draw, draw_int
from plumbline.llm.common import SPACES, global_positions, hidden, need, quoted, whole_text
from plumbline.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE, MOST_COPIES = 1.5, 2.0
#: Buckets of a histogram level, and the number of levels before the exact ranking of what is left.
LEVEL, LEVELS = 4096, 2


def word_count(text: Column) -> Column:
    """Words parted by white space, without building them: the places where a word begins."""
    blank = F.translate(text, SPACES, " " * len(SPACES))
    return (F.length(F.regexp_replace(F.concat(F.lit(" "), blank), " [^ ]", " ##")) - F.length(blank) - F.lit(1)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, place, source_size, weight, target) from (source, source_size), a row a source.

    Sources by code point, null last, take the weights in turn. A target is ``min(most * source_size, level * weight)``;
    the level rises until the targets make ``share`` of all words or every source is at its most.
    """
    ranked = sizes.withColumn("_none", F.col("source").isNull())
    placed = global_positions(ranked, ["_none", "source"], "place").drop("_none")
    table = F.array(*[F.lit(float(w)) for w in weights])
    stats = cut_lineage(placed.withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int"))))
    total = stats.agg(F.sum("source_size")).first()[0] or 0
    capped_words, capped_weight, level = 0, 0.0, 0.0
    while True:  # each turn caps more sources; one row of sums a turn
        open_weight = (stats.agg(F.sum("weight")).first()[0] or 0.0) - capped_weight
        level = (share * total - most * capped_words) / open_weight if open_weight > 0 else float("inf")
        over = stats.filter(F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight"))
        row = over.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
        if (row["s"] or 0, row["w"] or 0.0) == (capped_words, capped_weight):
            break
        capped_words, capped_weight = row["s"] or 0, row["w"] or 0.0
    top = F.lit(most) * F.col("source_size")
    return stats.withColumn("target", F.when(top <= F.lit(level) * F.col("weight"), top).otherwise(F.lit(level) * F.col("weight")))


def _rank(unit: Column, chance: Column) -> Column:
    """Pareto rank mapped to (0, 1): odds ratio q becomes q / (1 + q)."""
    q = (unit / (F.lit(1.0) - unit)) / (chance / (F.lit(1.0) - chance))
    return q / (F.lit(1.0) + q)


def _unit(id_col: Column, text: Column, seed: int) -> Column:
    """Uniform draw in (0, 1) that depends on the seed, the id and the text only."""
    key = F.concat_ws("|", F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(text))
    return (draw_int(draw(seed, "mix", key), 1, 13).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Per source: source_size, target, whole copies, chance and the rank up to which one copy more is taken.

    ``sized`` has (source, size, unit), a row a document.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("_ratio", ratio).withColumn("whole", F.floor("_ratio").cast("bigint"))
    plan = plan.withColumn("chance", F.col("_ratio") - F.col("whole")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut_lineage(plan.drop("_ratio"))
    open_ = plan.filter("chance > 0").select(F.col("source").alias("s_"), "chance", "left")
    work = sized.filter("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s_"))).withColumn("rank", _rank(F.col("unit"), F.col("chance")))
    work = work.select("source", "size", "rank", "left")
    scale = 1.0
    for _ in range(LEVELS):  # keep only the documents of the bucket in which a source's cut lies
        scale *= LEVEL
        bucket = F.floor(F.col("rank") * F.lit(scale))
        sums = work.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        so_far = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        cut = sums.withColumn("upto", so_far).filter("upto >= left AND upto - words < left")
        cut = cut.select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("l_"))
        work = work.join(cut, F.col("source").eqNullSafe(F.col("s_")) & (bucket == F.col("b_"))).select("source", "size", "rank", F.col("l_").alias("left"))
        work = cut_lineage(work)
    # equal ranks are taken or left together; the last one is taken if that comes nearer to the target
    tied = work.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("rank"))
    edge = tied.withColumn("upto", upto).filter("upto >= left AND upto - words < left")
    nearer = F.col("upto") - F.col("left") <= F.col("left") - (F.col("upto") - F.col("words"))
    edge = edge.select(F.col("source").alias("e_"), F.col("rank").alias("edge"), nearer.alias("taken_too"))
    return cut_lineage(plan.join(edge, F.col("source").eqNullSafe(F.col("e_")), "left").drop("e_"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights=WEIGHTS,
    share: float = TOTAL_SHARE, most: float = MOST_COPIES, prefix: str = "mix_",
) -> DataFrame:
    """All rows with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (how often the mix holds the row).

    A null text has no words; rows without words are copied as their source's whole part says. A null source is a source. Equal
    draws (repeated rows) share one decision. ``most`` bounds the copies. Empty tables give empty results; the columns of the
    input stay, and a prefix that clashes is an error.
    """
    need(docs, id_col, text_col, source_col)
    names = {n: prefix + n for n in ("size", "source_size", "target", "copies")}
    if {n.lower() for n in names.values()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"prefix {prefix!r} clashes with a column of the table")
    unit_name, s_, s_source = hidden(docs, "unit_", "s_", "plan_source")
    text = whole_text(text_col)
    sized = cut_lineage(
        docs.select(quoted(source_col).cast("string").alias("source"), word_count(text).alias("size"), _unit(quoted(id_col), text, seed).alias("unit"))
    )
    plan = plan_mix(sized, weights, share, most).select(
        F.struct("source_size", "target", "whole", "chance", "edge", "taken_too").alias(s_), F.col("source").alias(s_source)
    )
    rows = docs.withColumn(names["size"], word_count(text)).withColumn(unit_name, _unit(quoted(id_col), text, seed))
    joined = rows.join(plan, quoted(source_col).cast("string").eqNullSafe(F.col(s_source)))
    p = F.col(s_)
    rank = _rank(F.col(unit_name), p["chance"])
    # a source without an edge is short of words: all its fractions are taken
    extra = F.when((p["chance"] > 0) & (F.col(names["size"]) > 0), F.when(p["edge"].isNull() | (rank < p["edge"]) | ((rank == p["edge"]) & p["taken_too"]), 1).otherwise(0)).otherwise(0)
    return joined.select(
        *[quoted(c) for c in docs.columns], F.col(names["size"]), p["source_size"].alias(names["source_size"]), p["target"].alias(names["target"]),
        (p["whole"] + extra).cast("bigint").alias(names["copies"]),
    )
