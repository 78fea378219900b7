"""Order statistics without a single-partition sort.

Each operator has two plans with equal results. Inputs whose estimated size fits one task use the
plain Spark aggregate or window; larger ones use sketches and range partitions, so that no task
ever holds more than a slice of a column or group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.session import cut_lineage, freeze, is_small, shuffle_width

SKETCH_ACCURACY = 100_000


def bounded_join(big: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL, so that rows with a NULL key stay in their group.

    ``side`` is broadcast only when its estimated size is small; AQE handles the rest.
    """
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    right = side.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in names.items()])
    joined = big.join(F.broadcast(right) if is_small(side, 4.0) else right, same, how)
    rest = [c for c in [*big.columns, *side.columns] if c not in names]
    return joined.select(*[F.col(f"`{c}`") for c in [*on, *rest]])


def literal(value, kind: T.DataType) -> Column:
    """A collected value as a typed literal."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        pairs = [x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]
        return F.create_map(*pairs).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The row is computed first and becomes literals: the table keeps its own plan and size estimate,
    needs no join, and filters against the values reach the scan.
    """
    found = row.take(2)
    if len(found) > 1:
        raise ValueError("one_row needs an aggregate without groups")
    values = found[0] if found else dict.fromkeys(row.columns)
    return df.select("*", *[literal(values[f.name], f.dataType).alias(f.name) for f in row.schema])


def running_totals(
    df: DataFrame, order_by: Sequence[str], sums: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive prefix sums of ``sums`` ({output: column}) in ``order_by`` order within ``by``.

    ``order_by`` should identify rows within ``by`` (aggregate ties first).
    """
    by, order_by = list(by), list(order_by)
    if is_small(df, 2.0):
        w = W.partitionBy(*by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    # Range partitions split a hot group by its order key. The checkpoint freezes the cut points,
    # so totals and local sums see the same partitions even if tasks are retried.
    width = shuffle_width(df.sparkSession)
    ranged = freeze(df.repartitionByRange(width, *by, *order_by)).withColumn(
        "_pid", F.spark_partition_id()
    )
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid", *by).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    # Only a group that spans partitions has an offset: at most two rows per partition.
    offsets = (
        totals.withColumn("_first", F.min("_pid").over(W.partitionBy(*by)))
        .withColumns({f"_o_{o}": F.sum(f"_t_{o}").over(before) for o in sums})
        .filter("_pid > _first")
        .select("_pid", *[F.col(b).alias(f"_b_{b}") for b in by], *[f"_o_{o}" for o in sums])
    )
    local = W.partitionBy("_pid", *by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumns({o: F.sum(c).over(local) for o, c in sums.items()})
    same = [F.col("l._pid") == F.col("r._pid")] + [
        F.col(f"l.{b}").eqNullSafe(F.col(f"r._b_{b}")) for b in by
    ]
    joined = summed.alias("l").join(
        F.broadcast(offsets).alias("r"), reduce(lambda a, b: a & b, same), "left"
    )
    keep = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(
        *keep, *[(F.col(f"l.{o}") + F.coalesce(f"r._o_{o}", F.lit(0))).alias(o) for o in sums]
    )


def ranked(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """row_number() with hot groups split; ``order_by`` must be unique within ``by``."""
    if is_small(df, 2.0):
        w = W.partitionBy(*by).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(one, order_by, {name: "_one"}, by).drop("_one")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct (by, value): n, n_le (rows <= value), n_lt, dense rank and group total."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_one", F.lit(1).cast("bigint"))
    cum = running_totals(counts, [value], {"n_le": "n", "dense_rank": "_one"}, by).drop("_one")
    cum = cum.withColumn("n_lt", F.col("n_le") - F.col("n"))
    total = df.groupBy(*by).agg(F.count(value).alias("n_total")) if by else df.agg(
        F.count(value).alias("n_total")
    )
    return bounded_join(cum, total, by) if by else one_row(cum, total)


def sliding(
    df: DataFrame, order_by: Sequence[str], by: Sequence[str], back: int, exprs: dict[str, object],
    ahead: int = 0, chunk: int = 1_000_000,
) -> DataFrame:
    """Frame expressions over the ``back`` preceding and ``ahead`` following rows of each group.

    ``exprs`` maps an output name to ``f(window) -> Column``; the window is ordered and partitioned.
    A hot group is cut into chunks of consecutive rows; each chunk also gets the border rows its
    frames reach, so no task needs the whole group.
    """
    if is_small(df, 2.0):
        w = W.partitionBy(*by).orderBy(*order_by)
        return df.withColumns({o: f(w) for o, f in exprs.items()})
    rn = ranked(df, order_by, by, "_rn").withColumn("_pos", F.col("_rn") - 1)
    home = F.floor(F.col("_pos") / chunk)
    first = F.floor(F.greatest(F.col("_pos") - ahead, F.lit(0)) / chunk)
    last = F.floor((F.col("_pos") + back) / chunk)
    spread = rn.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*by, "_chunk").orderBy("_rn")
    out = spread.withColumns({o: f(w) for o, f in exprs.items()})
    return out.filter("_chunk = _home").drop("_rn", "_pos", "_home", "_chunk")


def quantile_name(column: str, i: int) -> str:
    return f"{column}__q{i}"


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per ``by``; column i-th prob: quantile_name(c, i)."""
    by, columns, probs = list(by), list(columns), list(probs)
    if is_small(df):
        arr = F.array(*[F.lit(float(p)) for p in probs])
        agg = df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), arr).alias(f"_{c}") for c in columns]
        )
        return agg.select(
            *by,
            *[F.col(f"_{c}")[i].alias(quantile_name(c, i)) for c in columns for i in range(len(probs))],
        )
    picked = _bracketed_quantiles(df, columns, probs, by)
    return picked.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("column") == c) & (F.col("_q") == i), F.col("value"))).alias(
                quantile_name(c, i)
            )
            for c in columns
            for i in range(len(probs))
        ]
    )


def _bracketed_quantiles(df, columns, probs, by):
    """Sketch brackets around each quantile, then an exact rank inside the bracket."""
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
            )
        ).alias("_s"),
    ).select(*by, "_s.column", "_s.value").filter("value IS NOT NULL AND NOT isnan(value)")
    keys = [*by, "column"]
    eps = 2.0 / SKETCH_ACCURACY
    marks = [m for p in probs for m in (max(p - eps, 0.0), min(p + eps, 1.0))]
    sketch = long.groupBy(*keys).agg(
        F.percentile_approx("value", marks, SKETCH_ACCURACY).alias("_m"),
        F.count(F.lit(1)).alias("_n"),
    )
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("_q"),
                F.lit(float(p)).alias("_p"),
                # a group below the sketch size is ranked whole: it is bounded by that size
                F.when(F.col("_n") > SKETCH_ACCURACY, F.col("_m")[2 * i]).otherwise(
                    F.lit(float("-inf"))
                ).alias("_lo"),
                F.when(F.col("_n") > SKETCH_ACCURACY, F.col("_m")[2 * i + 1]).otherwise(
                    F.lit(float("inf"))
                ).alias("_hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    # written first: its true size lets few groups be broadcast, so that the rows of a group stay in their tasks
    brackets = cut_lineage(sketch.select(*keys, "_n", slots.alias("_slots")))
    clamped = (
        bounded_join(long, brackets, keys)
        .select(*keys, "_n", "value", F.explode("_slots").alias("_s"))
        .select(
            *keys, "_n", "_s._q", "_s._p",
            F.when(F.col("value") < F.col("_s._lo"), F.lit(float("-inf")))
            .when(F.col("value") > F.col("_s._hi"), F.lit(float("inf")))
            .otherwise(F.col("value")).alias("value"),
        )
        .groupBy(*keys, "_n", "_q", "_p", "value").agg(F.count(F.lit(1)).alias("_c"))
    )
    w = W.partitionBy(*keys, "_q").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    h = (F.col("_n") - 1) * F.col("_p")
    hit = lambda pos: F.max(F.when((F.col("_cum") > pos) & (F.col("_cum") - F.col("_c") <= pos), F.col("value")))
    return (
        clamped.withColumn("_cum", F.sum("_c").over(w)).withColumn("_h", h)
        .groupBy(*keys, "_q").agg(
            hit(F.floor("_h")).alias("_a"), hit(F.ceil("_h")).alias("_b"), F.max("_h").alias("_h")
        )
        .withColumn("value", F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a")))
        .select(*keys, "_q", "value")
    )


# --- ranks of hash draws -------------------------------------------------------------------------

ALL = "g"  # sorts after every hex digit: everything is drawn
NONE = ""  # sorts before every draw


def hash_cuts(df: DataFrame, draw_col: str, quotas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The draw at rank ``take`` for each row of ``quotas`` (by..., slot, take) -> (by..., slot, cut).

    ``draw_col <= cut`` then marks exactly ``take`` rows, with no shuffle of the data. Draws are
    uniform, so a histogram over their first four digits leaves a sliver per group to rank.
    """
    by = list(by)
    if is_small(df, 2.0):
        w = W.partitionBy(*by).orderBy(draw_col)
        base = df.select(*by, draw_col).withColumn("take", F.row_number().over(w).cast("bigint"))
        hits = bounded_join(base, quotas, [*by, "take"])
    else:
        digits = 4
        rows = df.select(*by, draw_col).withColumn("_b", F.substring(draw_col, 1, digits))
        hist = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
        w = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        cum = hist.withColumn("_cum", F.sum("_n").over(w))
        edge = (
            _match(cum, quotas, by)
            .filter((F.col("_cum") >= F.col("take")) & (F.col("_cum") - F.col("_n") < F.col("take")))
            .withColumn("_need", F.col("take") - (F.col("_cum") - F.col("_n")))
            .select(*by, "slot", "_b", "_need")
        )
        inside = bounded_join(rows, edge, [*by, "_b"])
        w2 = W.partitionBy(*by, "slot").orderBy(draw_col)
        hits = inside.withColumn("_rn", F.row_number().over(w2)).filter("_rn = _need")
    found = hits.select(*by, "slot", F.col(draw_col).alias("cut"))
    return bounded_join(quotas, found, [*by, "slot"], "left").select(
        *by, "slot",
        F.coalesce("cut", F.when(F.col("take") <= 0, F.lit(NONE)).otherwise(F.lit(ALL))).alias("cut"),
    )


def _match(rows: DataFrame, quotas: DataFrame, by: list[str]) -> DataFrame:
    return bounded_join(rows, quotas, by) if by else rows.crossJoin(F.broadcast(quotas))


def lowest_cut(df: DataFrame, draw_col: str, take: int) -> str:
    """Draw value of the ``take``-th smallest row as a literal (one value to the driver)."""
    if take <= 0:
        return NONE
    if is_small(df, 2.0):
        row = df.select(draw_col).orderBy(draw_col).offset(take - 1).limit(1).first()
        return row[0] if row else ALL
    quotas = df.sparkSession.range(1).select(
        F.lit(0).alias("slot"), F.lit(take).cast("bigint").alias("take")
    )
    return hash_cuts(df, draw_col, quotas).first()["cut"]


def clipped(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


# --- ranks of rows ---------------------------------------------------------------------------------


def rank_rows(df: DataFrame, value: str, by: Sequence[str] = (), rank: str = "rnk", dense: str = "dense") -> DataFrame:
    """rank() and dense_rank() by ascending ``value``; large inputs rank distinct values and join back."""
    if is_small(df, 2.0):
        w = W.partitionBy(*by).orderBy(value)
        return df.withColumns({rank: F.rank().over(w).cast("bigint"), dense: F.dense_rank().over(w).cast("bigint")})
    ranks = value_ranks(df, value, by).select(*by, value, (F.col("n_lt") + 1).alias(rank), F.col("dense_rank").alias(dense))
    return bounded_join(df, ranks, [*by, value])


def tiles(df: DataFrame, order_by: Sequence[str], k: int, by: Sequence[str] = (), name: str = "tile") -> DataFrame:
    """ntile(k) from row numbers and group sizes: the first n % k tiles hold one row more."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rn = ranked(df, order_by, by, "_rn")
    j = bounded_join(rn, n, by) if by else one_row(rn, n)
    size, rest = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = rest * (size + 1)
    tile = F.when(F.col("_rn") <= edge, F.ceil(F.col("_rn") / (size + 1))).otherwise(
        rest + F.ceil((F.col("_rn") - edge) / F.greatest(size, F.lit(1)))
    )
    return j.withColumn(name, tile.cast("bigint")).select(*df.columns, name)
