"""Exact k-nearest-neighbour join and what builds on it: LOF, kNN distance, DBSCAN noise, kNN imputation.

Points are cut into blocks by a median-split tree over a bounded sample. Each query first searches
its own block, which bounds its k-th distance, and then only the blocks whose bounding box is
nearer than that. Columns that no query has a value in are not cut, and points with gaps in different
columns lie in different blocks, so that boxes bound every column their points have. Equal points are
merged first, so a point copied into a third of the table is one point with a multiplicity. Large
blocks of queries are split across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.draws import draw
from plumbline.operators.order_stats import bounded_join, lowest_cut, one_row
from plumbline.session import cut_lineage

SAMPLE = 20_000
BLOCK = 2_000
MAX_BLOCKS = 4_096
QUERIES_PER_TASK = 4_000
WIDE = 8  # above so many features a query visits most blocks
PART_BYTES = 64 << 20  # of points that meet queries in one task, where features are many
CELLS = 200_000  # query and block pairs that a task weighs at a time
GAP_COLUMNS = 3  # up to so many columns with gaps, blocks hold points with the same gaps only


def distinct_points(df: DataFrame, key: str, features: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, members): points = (pid, mult, features...) with the smallest key of equal rows as pid;
    members = (key, pid)."""
    fs = list(features)
    typed = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in fs])
    # -0.0 and 0.0 group together; NULL groups with NULL
    sig = F.md5(F.concat_ws("|", *[F.coalesce((F.col(c) + 0.0).cast("string"), F.lit("-")) for c in fs]))
    tagged = typed.withColumn("sig", sig)
    points = tagged.groupBy("sig").agg(
        F.min("key").alias("pid"), F.count(F.lit(1)).alias("mult"), *[F.any_value(c).alias(c) for c in fs]
    )
    points = cut_lineage(points)
    members = bounded_join(tagged.select("key", "sig"), points.select("sig", "pid"), ["sig"]).select("key", "pid")
    return points.select("pid", "mult", *fs), members


class Blocks:
    """Median-split tree over a bounded sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.fill = np.nan_to_num(np.nanmean(np.where(np.isfinite(sample), sample, np.nan), axis=0)) if len(sample) else np.zeros(sample.shape[1])
        self.nodes: list[tuple] = []  # (dimension, cut, left, right) or (-1, leaf, 0, 0)
        self.count = 0
        self._split(np.where(np.isnan(sample), self.fill, sample), leaves)

    def _split(self, pts: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(pts, axis=0) if len(pts) else np.zeros(len(self.fill))
        dim = int(np.argmax(spread))
        if leaves <= 1 or len(pts) < 2 or spread[dim] == 0:
            self.nodes[at] = (-1, self.count, 0, 0)
            self.count += 1
            return at
        cut = float(np.median(pts[:, dim]))
        low = pts[:, dim] <= cut
        if low.all():
            cut = float(np.max(pts[pts[:, dim] < cut, dim]))
            low = pts[:, dim] <= cut
        left = self._split(pts[low], leaves // 2)
        right = self._split(pts[~low], leaves - leaves // 2)
        self.nodes[at] = (dim, cut, left, right)
        return at

    def find(self, pts: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(pts), self.fill, pts)
        out = np.zeros(len(pts), dtype=np.int64)
        todo = [(0, np.arange(len(pts)))]
        while todo:
            node, rows = todo.pop()
            dim, cut, left, right = self.nodes[node]
            if dim < 0:
                out[rows] = cut
                continue
            low = filled[rows, dim] <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def _build_blocks(points: DataFrame, features: Sequence[str]) -> Blocks:
    n = points.count()
    drawn = points.withColumn("_h", draw(7, "blocks", "pid"))
    cut = lowest_cut(drawn, "_h", min(n, SAMPLE))
    rows = drawn.filter(F.col("_h") <= cut).select("_h", *features).toPandas().sort_values("_h")  # at most SAMPLE rows
    sample = rows[list(features)].to_numpy(dtype=float).reshape(-1, len(features))
    return Blocks(sample, int(min(max(n // BLOCK, 1), MAX_BLOCKS, max(len(sample) // 4, 1))))


def _distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Euclidean distances; with gaps, the sum over common columns is scaled up to all columns."""
    acc = np.zeros((len(q), len(d)))
    if not (np.isnan(q).any() or np.isnan(d).any()):
        for j in range(q.shape[1]):
            acc += np.square(q[:, j, None] - d[None, :, j])
        return np.sqrt(acc)
    both = np.zeros((len(q), len(d)))
    for j in range(q.shape[1]):
        diff = np.square(q[:, j, None] - d[None, :, j])
        ok = ~np.isnan(diff)
        acc += np.where(ok, diff, 0.0)
        both += ok
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(np.where(both > 0, acc * (q.shape[1] / both), np.inf))


def _close_pairs(q: np.ndarray, d: np.ndarray, squares: np.ndarray, qid: np.ndarray, did: np.ndarray, bound: np.ndarray, k: int):
    """(rows, cols, distances): all pairs that may be among the k nearest of a query within its bound, with exact distances.

    One matrix product gives all squared distances up to rounding; pairs beyond the k-th by more than that are left out.
    """
    own = np.square(q).sum(axis=1)
    about = own[:, None] + squares[None, :] - 2 * (q @ d.T)
    about[qid[:, None] == did[None, :]] = np.inf
    slack = 1e-10 * (own + squares.max(initial=0.0)) + 1e-300
    m = min(k, about.shape[1])
    limit = np.partition(about, m - 1, axis=1)[:, m - 1]
    with np.errstate(over="ignore"):
        limit = np.minimum(limit, np.square(bound) * (1 + 1e-9)) + 2 * slack
    rows, cols = np.nonzero((about <= limit[:, None]) & np.isfinite(about))
    total = np.zeros(len(rows))
    for j in range(q.shape[1]):
        total += np.square(q[rows, j] - d[cols, j])
    dist = np.sqrt(total)
    fits = dist <= bound[rows]
    return rows[fits], cols[fits], dist[fits]


def _search(queries: pd.DataFrame, data: pd.DataFrame, features: list[str], k: int) -> pd.DataFrame:
    """k nearest data points of each query (never itself) within the query's ``bound``."""
    q, d = queries[features].to_numpy(dtype=float), data[features].to_numpy(dtype=float)
    qid, did, mult = queries["pid"].to_numpy(), data["pid"].to_numpy(), data["mult"].to_numpy()
    bound = queries["bound"].to_numpy(dtype=float)
    out = []
    step = max(1, min(256, 4_000_000 // max(len(d), 1)))  # keeps the distance block near 32 MB
    plain = len(features) > WIDE and np.isfinite(q).all() and np.isfinite(d).all()
    squares = np.square(d).sum(axis=1) if plain else None
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        if plain:
            rows, cols, dist = _close_pairs(q[part], d, squares, qid[part], did, bound[part], k)
            frame = pd.DataFrame({"pid": qid[part][rows], "nid": did[cols], "dist": dist, "nmult": mult[cols]})
            out.append(frame.sort_values(["pid", "dist", "nid"]).groupby("pid", sort=False).head(k))
            continue
        dist = _distances(q[part], d)
        dist[qid[part][:, None] == did[None, :]] = np.inf
        m = min(k, dist.shape[1])
        near = np.argpartition(dist, m - 1, axis=1)[:, :m] if m < dist.shape[1] else np.tile(np.arange(m), (len(dist), 1))
        # ties at the k-th distance go to the smallest id
        edge = np.take_along_axis(dist, near, axis=1).max(axis=1)
        rows, cols = np.nonzero((dist <= edge[:, None]) & (dist <= bound[part][:, None]) & np.isfinite(dist))
        frame = pd.DataFrame({"pid": qid[part][rows], "nid": did[cols], "dist": dist[rows, cols], "nmult": mult[cols]})
        frame = frame.sort_values(["pid", "dist", "nid"]).groupby("pid", sort=False).head(k)
        out.append(frame)
    return pd.concat(out) if out else pd.DataFrame({"pid": [], "nid": [], "dist": [], "nmult": []})


def _cut_columns(queries: DataFrame, data: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str], int]:
    """(columns to cut blocks in, columns among them with gaps in the data, the commonest pattern of gaps).

    A column that no query has a value in adds nothing to a distance, so cuts there only make more blocks to visit.
    """
    asked = queries.agg(*[F.count(c).alias(c) for c in features]).first()
    cuts = [c for c in features if asked[c]] or list(features)
    held = data.agg(F.count(F.lit(1)), *[F.count(c) for c in cuts]).first()
    gaps = [c for c, n in zip(cuts, held[1:]) if n < held[0]]
    if not gaps or len(gaps) > GAP_COLUMNS:
        return cuts, [], 0
    return cuts, gaps, data.groupBy(_gap_code(gaps).alias("code")).count().orderBy(F.desc("count"), "code").first()["code"]


def _gap_code(gaps: Sequence[str]):
    return sum((F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate(gaps)), F.lit(0).cast("long"))


def nearest(queries: DataFrame, data: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(pid, nid, dist, nmult, rank): the k nearest distinct data points of each query point, exact.

    Both inputs have (pid, features...); data also has mult. A point is never its own neighbour.
    """
    fs = list(features)
    cuts, gaps, usual = _cut_columns(queries, data, fs)
    blocks = _build_blocks(data, cuts)
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(blocks)
    codes = 1 << len(gaps)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(block=shared.value.find(pdf[cuts].to_numpy(dtype=float)) * codes)

    cols = ", ".join(f"{c} double" for c in fs)
    key_type = dict(data.dtypes)["pid"]
    own = F.col("block") + (_gap_code(gaps) if gaps else F.lit(0))
    placed = cut_lineage(data.select("pid", "mult", *fs).mapInPandas(assign, f"pid {key_type}, mult long, {cols}, block long").withColumn("block", own))
    # a query starts among the points of the commonest gaps
    asked = cut_lineage(queries.select("pid", *fs).mapInPandas(assign, f"pid {key_type}, {cols}, block long").withColumn("block", F.col("block") + usual))

    # bounding boxes: one row per block, at most MAX_BLOCKS for each pattern of gaps; a column with gaps gives no bound
    box = placed.groupBy("block").agg(
        *[F.when(F.count(c) == F.count(F.lit(1)), F.min(c)).alias(f"{c}__lo") for c in fs],
        *[F.when(F.count(c) == F.count(F.lit(1)), F.max(c)).alias(f"{c}__hi") for c in fs],
    ).toPandas().sort_values("block")
    block_ids = box["block"].to_numpy(dtype=np.int64)
    low = box[[f"{c}__lo" for c in fs]].to_numpy(dtype=float)
    high = box[[f"{c}__hi" for c in fs]].to_numpy(dtype=float)
    boxes = spark.sparkContext.broadcast((block_ids, low, high))
    out_schema = f"pid {key_type}, nid {key_type}, dist double, nmult long"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"pid": [], "nid": [], "dist": [], "nmult": []})
        return _search(left, right, fs, k)

    def meet(q: DataFrame, data: DataFrame = placed, each: int = QUERIES_PER_TASK, kernel=search, also: Sequence[str] = ()) -> DataFrame:
        """Queries with (block, bound) against the points of that block; big query sets are salted."""
        load = q.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("salts"))
        salted = bounded_join(q, load, ["block"]).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int"))
        spread = bounded_join(data, load, ["block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return (
            salted.select("block", "salt", "pid", "bound", *also, *fs).groupBy("block", "salt")
            .cogroup(spread.select("block", "salt", "pid", "mult", *also, *fs).groupBy("block", "salt"))
            .applyInPandas(kernel, out_schema)
        )

    first = meet(asked.withColumn("bound", F.lit(float("inf"))))
    if len(block_ids) <= 1:
        return _top(first, k)
    first = cut_lineage(first)
    kth = first.groupBy("pid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = asked.join(kth, "pid", "left").fillna(float("inf"), ["bound"])

    # many features: blocks of a part share their queries, which then move once a part, not once a block
    wide = len(fs) > WIDE
    points = placed.count() if wide else 0
    room = max(1, min(PART_BYTES // (8 * len(fs) + 32), -(-points // int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism))))))
    per = max(1, room * len(block_ids) // max(points, 1)) if wide else 1

    def reached(q: np.ndarray, bound: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the blocks ``at`` each query must visit."""
        ids, lo, hi = (x[at] for x in boxes.value)
        have = np.maximum((~np.isnan(q)).sum(axis=1), 1)
        gap = np.zeros((len(q), len(ids)))
        for j in range(len(fs)):
            step = np.maximum(np.maximum(lo[None, :, j] - q[:, j, None], q[:, j, None] - hi[None, :, j]), 0.0)
            gap += np.square(np.nan_to_num(step))
        reach = np.sqrt(gap * (len(fs) / have)[:, None]) <= bound[:, None] * (1 + 1e-12)
        reach[ids[None, :] == own[:, None]] = False
        return reach

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = boxes.value[0]
        some, parts = max(1, CELLS // len(ids)), np.arange(0, len(ids), per)
        for pdf in (whole.iloc[k : k + some] for whole in batches for k in range(0, len(whole), some)):
            reach = reached(pdf[fs].to_numpy(dtype=float), pdf["bound"].to_numpy(dtype=float), pdf["block"].to_numpy(), np.arange(len(ids)))
            if wide:
                rows, cols_ = np.nonzero(np.logical_or.reduceat(reach, parts, axis=1))
                yield pdf.iloc[rows].assign(own=pdf["block"].to_numpy()[rows], block=cols_)
            else:
                rows, cols_ = np.nonzero(reach)
                yield pdf.iloc[rows].assign(block=ids[cols_])

    def search_part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Queries of many blocks (``own``) against the points of one part, block by block."""
        out, ids = [search(left[:0], right)], boxes.value[0]
        if len(left) and len(right):
            q, bound, own = left[fs].to_numpy(dtype=float), left["bound"].to_numpy(dtype=float), left["own"].to_numpy()
            for block, some in right.groupby("own"):
                mine = reached(q, bound, own, np.flatnonzero(ids == block))[:, 0]
                if mine.any():
                    out.append(_search(left[mine], some, fs, k))
        near = pd.concat(out[1:]) if len(out) > 1 else out[0]
        return near.sort_values(["pid", "dist", "nid"]).groupby("pid", sort=False).head(k) if len(near) else near

    if wide:
        number = pd.Series(np.arange(len(block_ids)) // per, index=block_ids)

        def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(own=pdf["block"], block=number.reindex(pdf["block"]).to_numpy())

        further = bounded.mapInPandas(visit, f"pid {key_type}, {cols}, block long, bound double, own long")
        shared_points = placed.mapInPandas(parted, f"pid {key_type}, mult long, {cols}, block long, own long")
        return _top(first.unionByName(meet(further, shared_points, room, search_part, ["own"])), k)

    further = bounded.mapInPandas(visit, f"pid {key_type}, {cols}, block long, bound double")
    second = meet(further)
    return _top(first.unionByName(second), k)


def _top(candidates: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("pid").orderBy("dist", "nid")
    return candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _row_neighbours(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(pid, nid, dist, used): how many of a row's k neighbours sit at each point; own copies come first."""
    own = points.filter("mult > 1").select(
        "pid", F.col("pid").alias("nid"), F.lit(0.0).alias("dist"), (F.col("mult") - 1).alias("n"), F.lit(0).alias("rank")
    )
    rows = own.unionByName(near.select("pid", "nid", "dist", F.col("nmult").alias("n"), "rank"))
    before = W.partitionBy("pid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)  # at most k + 1 rows
    taken = F.coalesce(F.sum("n").over(before), F.lit(0))
    return rows.withColumn("used", F.least(F.col("n"), F.greatest(F.lit(k) - taken, F.lit(0)))).filter("used > 0").select(
        "pid", "nid", "dist", "used"
    )


def lof(df: DataFrame, key: str, features: Sequence[str], k: int = 20, name: str = "lof") -> DataFrame:
    """(key, lof): local outlier factor of every row; the row itself is not its neighbour."""
    points, members = distinct_points(df, key, features)
    used = cut_lineage(_row_neighbours(points, nearest(points, points, features, k), k))
    kdist = used.groupBy("pid").agg(F.max("dist").alias("kdist"))
    reach = bounded_join(used, kdist.toDF("nid", "nk"), ["nid"])
    lrd = reach.groupBy("pid").agg(
        (1.0 / (F.sum(F.greatest("dist", "nk") * F.col("used")) / F.sum("used") + 1e-10)).alias("lrd")
    )
    lrd = cut_lineage(lrd)
    near = bounded_join(used, lrd.toDF("nid", "nlrd"), ["nid"]).groupBy("pid").agg(
        (F.sum(F.col("nlrd") * F.col("used")) / F.sum("used")).alias("around")
    )
    factor = near.join(lrd, "pid").select("pid", (F.col("around") / F.col("lrd")).alias(name))
    return bounded_join(members, factor, ["pid"]).select("key", name)


def knn_distance(df: DataFrame, key: str, features: Sequence[str], k: int = 10, name: str = "knn") -> DataFrame:
    """(key, knn): distance to the k-th neighbour."""
    points, members = distinct_points(df, key, features)
    used = _row_neighbours(points, nearest(points, points, features, k), k)
    far = used.groupBy("pid").agg(F.max("dist").alias(name))
    return bounded_join(members, far, ["pid"]).select("key", name)


def dbscan_noise(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(key, noise): 1 for rows that are neither core (``min_points`` rows within eps, itself included)
    nor within eps of a core row."""
    points, members = distinct_points(df, key, features)
    near = cut_lineage(nearest(points, points, features, min_points - 1).filter(F.col("dist") <= eps))
    around = near.groupBy("pid").agg(F.sum("nmult").alias("others"))
    marked = cut_lineage(
        points.join(around, "pid", "left").withColumn("core", F.col("mult") + F.coalesce("others", F.lit(0)) >= min_points)
    )
    cores = marked.filter("core").select("pid", "mult", *features)
    if cores.isEmpty():
        return members.select("key", F.lit(1).alias("noise"))
    edge = nearest(marked.filter("NOT core"), cores, features, 1).filter(F.col("dist") <= eps).select("pid", F.lit(0).alias("_near"))
    flags = marked.join(edge, "pid", "left").select("pid", F.when(F.col("core"), 0).otherwise(F.coalesce("_near", F.lit(1))).alias("noise"))
    return bounded_join(members, flags, ["pid"]).select("key", "noise")


def knn_impute(df: DataFrame, key: str, columns: Sequence[str], features: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Fill gaps of ``columns`` with the mean of the k nearest rows that have a value (gap-aware distance
    over ``features``). Ties go to the smallest key. A row without any donor gets the column mean."""
    fs = list(features or columns)
    out = df
    for c in columns:
        points, members = distinct_points(df, key, fs)
        donors = points.filter(F.col(c).isNotNull())
        asking = points.filter(F.col(c).isNull())
        near = nearest(asking, donors, fs, k)
        values = near.join(donors.select(F.col("pid").alias("nid"), F.col(c).alias("_v")), "nid")
        before = W.partitionBy("pid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        weighed = values.withColumn("_u", F.least("nmult", F.greatest(F.lit(k) - F.coalesce(F.sum("nmult").over(before), F.lit(0)), F.lit(0))))
        fill = weighed.groupBy("pid").agg((F.sum(F.col("_v") * F.col("_u")) / F.sum("_u")).alias("_fill"))
        fills = members.join(fill, "pid").select(F.col("key").alias(key), "_fill")
        mean = df.agg(F.avg(c).alias("_mean"))
        # only rows with a gap are in fills
        out = one_row(out.join(fills, key, "left"), mean).withColumn(
            c, F.coalesce(F.col(c).cast("double"), F.col("_fill"), F.col("_mean"))
        ).drop("_fill", "_mean")
    return out.select(*df.columns)
