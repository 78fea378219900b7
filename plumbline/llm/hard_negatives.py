"""Hard negatives by exact integer scores: Strassen products of anchor panels and candidate tiles, then mergeable heaps.

Rows are packed into tiles of ``TILE`` candidates and panels of about ``PANEL`` anchors; every pair of a panel and a tile is one int64
product in one task, and a task keeps only the best few scores of each anchor. A first pass finds the anchors' positives, a second
the negatives inside the score windows that those set. Panels are a stated query set: they go to the tiles as a broadcast
while they are small, else both sides meet by (panel, share of the tiles), so no task gets more than ``SHARE`` tiles of a key.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. Shorter vectors count as padded with zeros.
Repeated rows are rows of their own: equal scores go by id, then by place. Ids and labels are integers. Scores are
exact; vectors whose products could pass 2^63 / 100 are refused. An empty table or one without anchors gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import hidden, need, quoted, sized_broadcast
from plumbline.session import cut_lineage

TILE = 1024
PANEL = 512
LEAF = 16
#: Tiles that one key of the shuffled form may have.
SHARE = 256
#: Panels whose heaps a task holds at a time; beyond that it hands them on.
HELD = 64
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


# ---- products ---------------------------------------------------------------------------------------------------------


def _padded(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    if x.shape == (rows, cols):
        return x
    out = np.zeros((rows, cols), np.int64)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = x.shape[0] // 2, x.shape[1] // 2
    return x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """a times b transposed; both have ``depth`` halvings in every dimension."""
    if not depth:
        return a @ b.T
    a11, a12, a21, a22 = _halves(a)
    b11, b21, b12, b22 = _halves(b)  # of b transposed
    d = depth - 1
    m1 = _strassen(a11 + a22, b11 + b22, d)
    m2 = _strassen(a21 + a22, b11, d)
    m3 = _strassen(a11, b12 - b22, d)
    m4 = _strassen(a22, b21 - b11, d)
    m5 = _strassen(a11 + a12, b22, d)
    m6 = _strassen(a21 - a11, b11 + b12, d)
    m7 = _strassen(a12 - a22, b21 + b22, d)
    out = np.empty((a.shape[0], b.shape[0]), np.int64)
    c11, c12, c21, c22 = _halves(out)
    np.add(m1, m4, out=c11)
    c11 -= m5
    c11 += m7
    np.add(m3, m5, out=c12)
    np.add(m2, m4, out=c21)
    np.subtract(m1, m2, out=c22)
    c22 += m3
    c22 += m6
    return out


def products(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b`` (int64), by Strassen's recursion with zero padding."""
    width = max(a.shape[1], b.shape[1])
    depth = 0
    while min(a.shape[0], b.shape[0], width) >= leaf << (depth + 1):
        depth += 1
    up = lambda n: -(-n >> depth) << depth
    rows, cols, width = up(a.shape[0]), up(b.shape[0]), up(width)
    return _strassen(_padded(a, rows, width), _padded(b, cols, width), depth)[: a.shape[0], : b.shape[0]]


# ---- heaps ------------------------------------------------------------------------------------------------------------


class Heaps:
    """The best ``size`` (score, id, row) of every slot: higher scores first, then smaller ids, then earlier rows.

    Merging is associative and commutative, so tiles, tasks and retries may come in any order.
    """

    def __init__(self, slots: int, size: int):
        self.size = size
        self.scores = np.full((slots, size), _NONE)
        self.ids = np.full((slots, size), _LAST)
        self.rows = np.full((slots, size), _LAST)

    def merge(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Add a block of candidates, one line a slot; empty places have the score ``_NONE``."""
        s = np.concatenate([self.scores[slots], scores], axis=1)
        i = np.concatenate([self.ids[slots], ids], axis=1)
        r = np.concatenate([self.rows[slots], rows], axis=1)
        best = np.lexsort((r, i, ~s), axis=-1)[:, : self.size]
        for kept, new in ((self.scores, s), (self.ids, i), (self.rows, r)):
            kept[slots] = np.take_along_axis(new, best, axis=1)


def _best(scores: np.ndarray, size: int) -> np.ndarray:
    """Columns of the ``size`` highest scores of each line, ties by the earlier column."""
    return np.argsort(~scores, axis=1, kind="stable")[:, :size]


def _positives(heaps: Heaps, panel: dict, tile: dict, scores: np.ndarray) -> None:
    for label in np.intersect1d(panel["labels"], tile["labels"]):
        a, c = np.flatnonzero(panel["labels"] == label), np.flatnonzero(tile["labels"] == label)
        some = scores[np.ix_(a, c)]
        some[panel["rows"][a][:, None] == tile["rows"][c][None, :]] = _NONE  # an anchor is no partner of its own
        best = _best(some, heaps.size)
        top = np.take_along_axis(some, best, axis=1)
        none = top == _NONE
        heaps.merge(a, top, np.where(none, _LAST, tile["ids"][c][best]), np.where(none, _LAST, tile["rows"][c][best]))


def _negatives(heaps: Heaps, panel: dict, tile: dict, scores: np.ndarray) -> None:
    """Slots are windows: the line of an anchor, the lowest and the highest score."""
    lines, low, high = panel["lines"], panel["low"], panel["high"]
    low = np.maximum(low, heaps.scores[:, -1])  # a full heap takes no lower score
    new = [np.full((len(lines), heaps.size), x) for x in (_NONE, _LAST, _LAST)]
    bounds = np.searchsorted(lines, np.arange(len(panel["rows"]) + 1))
    touched = []
    for a in range(len(panel["rows"])):
        lo, hi = bounds[a], bounds[a + 1]
        if lo == hi:
            continue
        line = scores[a]
        some = np.flatnonzero((line >= low[lo:hi].min()) & (line <= high[lo:hi].max()) & (tile["labels"] != panel["labels"][a]))
        if not len(some):
            continue
        some = some[np.argsort(~line[some], kind="stable")]
        down = ~line[some]
        for w in range(lo, hi):
            x, y = np.searchsorted(down, ~high[w], "left"), np.searchsorted(down, ~low[w], "right")
            if x < y:
                got = some[x : min(y, x + heaps.size)]
                for out, values in zip(new, (line, tile["ids"], tile["rows"])):
                    out[w, : len(got)] = values[got]
                touched.append(w)
    if touched:
        slots = np.array(touched)
        heaps.merge(slots, *[x[slots] for x in new])


# ---- Spark ------------------------------------------------------------------------------------------------------------

_TILE = "tile bigint, ids binary, labels binary, anchors binary, vectors binary"
_PANEL = "panel int, rows binary, ids binary, labels binary, vectors binary"
_FOUND = "slot bigint, score bigint, id bigint, row bigint"
_ROW_BITS = TILE.bit_length() - 1


def _int(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _tiles(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """Rows packed by ``TILE``, ordered by id inside a tile, so that a stable sort by score breaks ties by id."""

    def pack(batches):
        part, n = TaskContext.get().partitionId() << 24, 0
        held: list[pa.RecordBatch] = []
        count = 0

        def tiles(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, n
            table = pa.Table.from_batches(held).combine_chunks()
            at = 0
            while count - at >= TILE or (last and at < count):
                some = table.slice(at, TILE)
                at += some.num_rows
                ids, labels, anchors = (some.column(k).to_numpy() for k in range(3))
                vectors = some.column(3).combine_chunks()
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                flat = np.zeros((some.num_rows, dim), kind)
                flat[np.arange(dim)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy()
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_pydict({
                    "tile": pa.array([part | n], pa.int64()), "ids": [ids[order].astype(np.int64).tobytes()], "labels": [labels[order].astype(np.int64).tobytes()],
                    "anchors": [anchors[order].astype(np.int8).tobytes()], "vectors": [flat[order].tobytes()],
                })
                n += 1
            held, count = ([table.slice(at).combine_chunks().to_batches()[0]] if at < count else []), count - at

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= TILE:
                yield from tiles(False)
        if count:
            yield from tiles(True)

    return cut_lineage(rows.mapInArrow(pack, _TILE))


def _tile(row: dict, dim: int, kind: str) -> dict:
    ids = _int(row["ids"])
    return {
        "ids": ids, "labels": _int(row["labels"]), "rows": (row["tile"] << _ROW_BITS) + np.arange(len(ids)),
        "vectors": np.frombuffer(row["vectors"], kind).reshape(len(ids), dim),
    }


def _panels(tiles: DataFrame, dim: int, kind: str) -> tuple[DataFrame, int]:
    """Anchors, dealt by a hash of their place to panels of about ``PANEL``."""

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t, at = _tile(row, dim, kind), np.flatnonzero(np.frombuffer(row["anchors"], np.int8))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(t["rows"][at], pa.int64()), "id": pa.array(t["ids"][at], pa.int64()),
                    "label": pa.array(t["labels"][at], pa.int64()), "vector": pa.array([t["vectors"][k].tobytes() for k in at], pa.binary()),
                })

    anchors = cut_lineage(tiles.mapInArrow(pick, "row bigint, id bigint, label bigint, vector binary"))
    n = -(-anchors.count() // PANEL)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, ids, labels = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("row", "id", "label"))
        return pa.table({
            "panel": pa.array([table.column("panel")[0].as_py()], pa.int32()), "rows": pa.array([rows], pa.binary()), "ids": pa.array([ids], pa.binary()),
            "labels": pa.array([labels], pa.binary()), "vectors": pa.array([b"".join(table.column("vector").to_pylist())], pa.binary()),
        })

    dealt = anchors.withColumn("panel", F.pmod(F.xxhash64("row"), F.lit(max(n, 1))).cast("int"))
    return cut_lineage(dealt.groupBy("panel").applyInArrow(pack, _PANEL)), n


def _pairs(tiles: DataFrame, panels: DataFrame, n_panels: int) -> DataFrame:
    """Every tile beside every panel."""
    sides = panels.select("panel", *[F.col(c).alias(f"p_{c}") for c in panels.columns if c != "panel"])
    every = tiles.drop("anchors").withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(n_panels - 1))))
    marked = sized_broadcast(sides)
    if marked is not sides:
        return every.join(marked, "panel")
    shares = max(1, -(-tiles.count() // SHARE))
    every = every.withColumn("share", F.pmod(F.xxhash64("tile"), F.lit(shares)))
    return every.join(sides.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint")))), ["panel", "share"]).drop("share")


def _search(pairs: DataFrame, dim: int, kind: str, size: int, windows: bool, low: int, high: int) -> DataFrame:
    """(slot, score, id, row): the best of every task for each slot; a slot is an anchor's row, or a window's number."""

    def search(batches):
        held: dict[int, tuple[Heaps, np.ndarray]] = {}

        def hand_on():
            for heaps, slots in held.values():
                which, _ = np.nonzero(heaps.scores != _NONE)
                full = heaps.scores != _NONE
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(slots[which], pa.int64()), "score": pa.array(heaps.scores[full], pa.int64()),
                    "id": pa.array(heaps.ids[full], pa.int64()), "row": pa.array(heaps.rows[full], pa.int64()),
                })
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tile = _tile(row, dim, kind)
                rows = _int(row["p_rows"])
                panel = {"rows": rows, "labels": _int(row["p_labels"])}
                if windows:
                    anchors, scores = _int(row["p_anchors"]), _int(row["p_scores"])
                    order = np.lexsort((np.arange(len(anchors)), anchors))
                    panel |= {"lines": np.searchsorted(rows, anchors[order]), "low": -(-low * scores[order] // 100), "high": high * scores[order] // 100}
                    slots = _int(row["p_slots"])[order]
                else:
                    slots = rows
                if row["panel"] not in held:
                    if len(held) >= HELD:
                        yield from hand_on()
                    held[row["panel"]] = Heaps(len(slots), size), slots
                vectors = np.frombuffer(row["p_vectors"], kind).reshape(len(rows), dim)
                found = products(vectors.astype(np.int64), tile["vectors"].astype(np.int64))
                (_negatives if windows else _positives)(held[row["panel"]][0], panel, tile, found)
        yield from hand_on()

    return pairs.mapInArrow(search, _FOUND)


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` of each slot; Spark cuts groups to them before the shuffle."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: float = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``is_anchor`` is a condition over the columns of ``vectors``. Components become ``floor(scale * x)``. Positives are the best
    other rows of the anchor's label; negatives the best rows of other labels that score between ``low`` and ``high`` percent
    of the positive.
    """
    need(vectors, id_col, label_col, vector_col)
    for c in (id_col, label_col):
        if dict(vectors.dtypes)[c] not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{c} must be an integer column")
    spark = vectors.sparkSession
    id_, label, anchor, vector = hidden(vectors, "hn_id", "hn_label", "hn_anchor", "hn_vector")
    rows = (
        vectors.select(
            quoted(id_col).cast("bigint").alias(id_), quoted(label_col).cast("bigint").alias(label),
            F.coalesce(is_anchor, F.lit(False)).alias(anchor), quoted(vector_col).cast("array<double>").alias(vector),
        )
        .filter(quoted(id_).isNotNull() & quoted(label).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
        .withColumn(vector, F.transform(vector, lambda x: F.floor(x * F.lit(float(scale)))))
    )
    dim, most = rows.agg(F.max(F.size(vector)), F.max(F.array_max(F.transform(vector, F.abs)))).first()
    dim, most = dim or 0, most or 0
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if dim * most * most * 100 >= 1 << 63:
        raise ValueError(f"{dim} components up to {most} may pass the range of exact scores")
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    dim = max(dim, 1)
    tiles = _tiles(rows, dim, kind)
    panels, n = _panels(tiles, dim, kind)
    if not n:
        return spark.createDataFrame([], result)

    best = _first(_search(_pairs(tiles, panels, n), dim, kind, n_positives, False, low, high), n_positives)
    names = panels.select("panel", "rows", "ids").mapInArrow(_anchor_ids, "panel int, slot bigint, anchor_id bigint")
    positives = cut_lineage(
        best.join(names, "slot").select(
            F.monotonically_increasing_id().alias("window"), "panel", F.col("slot").alias("anchor"), "anchor_id",
            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        )
    )
    lists = positives.groupBy("panel").agg(F.sort_array(F.collect_list(F.struct("anchor", "window", "positive_score"))).alias("found"))
    wide = cut_lineage(panels.join(lists, "panel").mapInArrow(_with_windows, _PANEL + ", anchors binary, slots binary, scores binary"))
    found = _first(_search(_pairs(tiles, wide, n), dim, kind, n_negatives, True, low, high), n_negatives)
    return found.withColumnRenamed("slot", "window").join(positives, "window").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _anchor_ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rows = _int(row["rows"])
            yield pa.RecordBatch.from_pydict({
                "panel": pa.array([row["panel"]] * len(rows), pa.int32()), "slot": pa.array(rows, pa.int64()), "anchor_id": pa.array(_int(row["ids"]), pa.int64()),
            })


def _with_windows(batches):
    for batch in batches:
        for row in batch.to_pylist():
            found = row.pop("found")
            for name, field in (("anchors", "anchor"), ("slots", "window"), ("scores", "positive_score")):
                row[name] = np.array([f[field] for f in found], np.int64).tobytes()
            out = pa.RecordBatch.from_pylist([row])
            yield out.set_column(0, "panel", pa.array([row["panel"]], pa.int32()))
