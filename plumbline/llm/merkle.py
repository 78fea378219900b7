"""Merkle manifest of a table: leaves of rows, a tree a source, a tree over the sources, and a witness of every row.

Trees grow by aligned append. An ``Appender`` takes the nodes of one block in order; every node that joins an open subtree gets a
partial witness, the siblings on its left, and each later sibling that completes extends it on the right. A full subtree becomes one
node of the level above. Blocks of ``ARITY ** 2`` nodes are appended in parallel tasks, and the roots of blocks are further appends
of the next round, until each source has one node. Witnesses then go down again: a block's nodes get their own siblings and those of
the block's root. No task holds more than one block, whatever the size of a source.

Every field of a leaf is ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Rows ascend by id (null first), equal ids by leaf;
repeated rows are leaves of their own. Sources ascend by their UTF-8 bytes, null first. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import global_positions, need, quoted, sized_broadcast
from plumbline.session import cut_lineage

ARITY = 16
LEVELS = 2
BLOCK = ARITY**LEVELS
SALTS = 16
FLUSH = 4096


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---- append -----------------------------------------------------------------------------------------------------------


class Node:
    """A completed subtree, with the witness that it has so far inside its parent."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, value: str, left: str):
        self.digest, self.left, self.right, self.parent = value, left, [], None


class Appender:
    """Aligned append of up to ``ARITY ** levels`` digests."""

    def __init__(self, levels: int):
        self.levels = levels
        self.leaves: list[Node] = []
        self._open: list[list[Node]] = [[] for _ in range(levels + 1)]

    def append(self, value: str) -> None:
        self.leaves.append(self._add(0, value))

    def _add(self, level: int, value: str) -> Node:
        run = self._open[level]
        for earlier in run:
            earlier.right.append(value)
        node = Node(value, "".join(n.digest for n in run))
        run.append(node)
        if level < self.levels and len(run) == ARITY:
            self._close(level)
        return node

    def _close(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        parent = self._add(level + 1, digest("".join(n.digest for n in run)))
        for n in run:
            n.parent = parent

    def finish(self) -> str:
        """Close the open subtrees, also those of one node, and give the root."""
        for level in range(self.levels):
            if self._open[level]:
                self._close(level)
        return self._open[self.levels][0].digest

    def witness(self, leaf: Node) -> list[tuple[str, str]]:
        """(left, right) siblings a level, lowest first."""
        out, node = [], leaf
        while node.parent is not None:
            out.append((node.left, "".join(node.right)))
            node = node.parent
        return out


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


def fold(value: str, witness: Sequence[tuple[str, str]]) -> str:
    """The root that a digest and its siblings give."""
    for left, right in witness:
        value = digest(left + value + right)
    return value


def _text(witness: Sequence[tuple[str, str]]) -> str:
    return "/".join(f"{left}:{right}" for left, right in witness)


def _levels(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split(":")) for level in text.split("/")] if text else []


# ---- blocks in tasks --------------------------------------------------------------------------------------------------


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)])


def _blocks(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) of sorted rows that begin with both."""
    key, held = None, []
    for row in _rows(batches):
        if row[:2] != key and held:
            yield key, held
            held = []
        key = row[:2]
        held.append(row[2:])
    if held:
        yield key, held


def _packed(rows: Iterator[tuple], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)


def _block() -> Column:
    return F.shiftright("idx", (BLOCK - 1).bit_length())


def _climb(nodes: DataFrame) -> DataFrame:
    """The roots of blocks, as nodes (tree, idx, n, digest) of the next round."""
    shape = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def roots(batches):
        def made():
            for (tree, block), rows in _blocks(batches):
                n = rows[0][1]
                grown = Appender(min(LEVELS, height(n)))
                for _, _, value in rows:
                    grown.append(value.hex())
                yield tree, block, -(-n // BLOCK), bytes.fromhex(grown.finish())

        return _packed(made(), shape)

    rows = nodes.select("tree", _block().alias("block"), "idx", "n", "digest")
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return cut_lineage(dealt.mapInArrow(roots, "tree string, idx bigint, n bigint, digest binary"))


def _down(nodes: DataFrame, above: DataFrame, payload: list[str], result: Sequence[tuple[str, str, pa.DataType]], give: Callable) -> DataFrame:
    """Rows that ``give(tree, payload, digest, witness, above)`` makes of every node.

    ``above`` has (tree, idx, witness, top) of the nodes' blocks. One such row goes before the nodes of its block, so that no join
    repeats it for each of them.
    """
    kinds = {f.name: f.dataType for f in nodes.schema}
    first = above.select(
        "tree", F.col("idx").alias("block"), F.lit(-1).cast("bigint").alias("idx"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("digest"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in payload], "witness", "top",
    )
    rows = nodes.select("tree", _block().alias("block"), "idx", "n", "digest", *payload, F.lit(None).cast("string").alias("witness"), F.lit(None).cast("string").alias("top"))
    dealt = first.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    shape = pa.schema([(name, kind) for name, _, kind in result])

    def witnessed(batches):
        def made():
            for (tree, _), (head, *below) in _blocks(batches):
                upper, top = _levels(head[-2]), head[-1]
                grown = Appender(min(LEVELS, height(below[0][1])))
                for row in below:
                    grown.append(row[2].hex())
                grown.finish()
                for row, leaf in zip(below, grown.leaves):
                    yield give(tree, row, leaf.digest, grown.witness(leaf), upper, top)

        return _packed(made(), shape)

    return dealt.mapInArrow(witnessed, ", ".join(f"{name} {kind}" for name, kind, _ in result))


# ---- manifest ---------------------------------------------------------------------------------------------------------


def leaf(fields: Sequence[Column]) -> Column:
    """Digest (binary) of one row's fields."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with idx, their place in their tree, and n, its size."""
    stored = global_positions(rows, order, "pos")
    sizes = cut_lineage(stored.groupBy("tree").agg(F.min("pos").alias("start"), F.count("*").alias("n")))
    small = sized_broadcast(sizes)
    if small is not sizes:
        joined = stored.join(small, "tree")
    else:  # a source may hold a third of the rows
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stored.withColumn("salt", F.pmod("pos", F.lit(SALTS)).cast("int")).join(salted, ["tree", "salt"]).drop("salt")
    return joined.withColumn("idx", F.col("pos") - F.col("start")).drop("pos", "start")


class Manifest:
    """The nodes of every round as tables, the sources' roots and the root. Tables are below the shared checkpoint folder."""

    def __init__(self, leaves: DataFrame, rounds: list[DataFrame], sources: list[DataFrame], root: str | None):
        self.leaves, self.rounds, self.sources, self.root = leaves, rounds, sources, root

    def _above_leaves(self) -> DataFrame | None:
        """(tree, idx, witness, top) of the leaves' blocks."""
        if self.root is None:
            return None
        wide = [("tree", "string", pa.string()), ("idx", "bigint", pa.int64()), ("witness", "string", pa.string()), ("top", "string", pa.string())]
        spark = self.leaves.sparkSession
        above = spark.createDataFrame([("", 0, "", self.root)], "tree string, idx bigint, witness string, top string")
        for nodes in reversed(self.sources[1:]):
            above = _down(nodes, above, [], wide, lambda tree, row, value, own, upper, top: (tree, row[0], _text([*own, *upper]), top))
        above = cut_lineage(_down(
            self.sources[0], above, ["source"], wide, lambda tree, row, value, own, upper, top: (row[3], 0, _text([*own, *upper]), value)
        ))
        for nodes in reversed(self.rounds):
            above = cut_lineage(_down(nodes, above, [], wide, lambda tree, row, value, own, upper, top: (tree, row[0], _text([*own, *upper]), top)))
        return above

    def witnesses(self) -> DataFrame:
        """(tree, id, leaf, witness): the (left:right) siblings a level from the leaf to the root, levels parted by /.

        ``tree`` is the source after a 1, or 0 for the null source.
        """
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema}
        result = [("tree", "string", pa.string()), ("id", "string", pa.string()), ("leaf", "string", pa.string()), ("witness", "string", pa.string())]
        above = self._above_leaves()
        if above is None:
            return self.leaves.sparkSession.createDataFrame([], f"tree string, id {kinds['id']}, leaf string, witness string")
        texts = self.leaves.withColumn("id", F.col("id").cast("string"))
        made = _down(texts, above, ["id"], result, lambda tree, row, value, own, upper, top: (tree, row[3], value, _text([*own, *upper])))
        return made.withColumn("id", F.col("id").cast(kinds["id"]))

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

        ``folded_root`` comes from the row's ``changed`` leaf, or its own where it has none, and the original siblings.
        """
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema}
        names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root")
        root, above = self.root, self._above_leaves()
        if above is None:
            return self.leaves.sparkSession.createDataFrame([], f"id {kinds['id']}, " + ", ".join(f"{n} string" for n in names[1:]) + ", verified boolean")

        def give(tree, row, value, own, upper, top):
            siblings = "".join(left + right for left, right in own) + "".join(left + right for left, right in upper)
            changed = row[4]
            folded = fold(fold(value if changed is None else changed.hex(), own), upper)
            return row[3], value, top, root, digest(siblings), folded

        texts = self.leaves.withColumn("id", F.col("id").cast("string")).withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
        made = _down(texts, above, ["id", "changed"], [(n, "string", pa.string()) for n in names], give)
        return made.withColumn("id", F.col("id").cast(kinds["id"])).withColumn("verified", F.col("folded_root") == F.col("root"))


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of block roots above the nodes; the last has one node a tree."""
    rounds = []
    while True:
        nodes = _climb(nodes)
        if nodes.filter("n > 1").isEmpty():
            return rounds, nodes
        rounds.append(nodes)


def build(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """Manifest of all rows. ``changed`` gives other values of some fields, for rows where ``where`` holds, to be checked by ``proofs``."""
    need(docs, id_col, source_col, *fields)
    other = F.lit(None).cast("binary")
    if changed:
        other = F.when(F.lit(True) if where is None else where, leaf([changed.get(f, quoted(f)) for f in fields]))
    rows = cut_lineage(docs.select(
        F.coalesce(F.concat(F.lit("1"), quoted(source_col).cast("string")), F.lit("0")).alias("tree"), quoted(id_col).alias("id"),
        leaf([quoted(f) for f in fields]).alias("digest"), other.alias("changed"),
    ))
    leaves = cut_lineage(_placed(rows, ["tree", "id", "digest"]))
    rounds, tops = _rounds(leaves)
    tops = tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = cut_lineage(_placed(tops, ["tree", "source"]))
    above, last = _rounds(sources)
    root = last.first()
    return Manifest(leaves, rounds, [sources, *above], root["digest"].hex() if root else None)
