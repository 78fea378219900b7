"""Shared helpers: column guards, native word expressions, numpy word hashes, global row positions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, plan_bytes

# fixed values: the white space that parts words
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables up to this estimated size may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def need(df: DataFrame, *columns: str) -> None:
    """A missing input column is an error of the caller."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no input column has, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_{uuid.uuid4().hex[:6]}"
        out.append(name)
        taken.add(name.lower())
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, also with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast when its measured size is below ``limit``; Spark decides otherwise."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def whole_text(column: str) -> Column:
    return F.coalesce(quoted(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order; an empty array where there are none."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def global_positions(df: DataFrame, order: Sequence[str], position: str = "position", parts: int | None = None) -> DataFrame:
    """Rows with their place (0, 1, ...) in the order of the columns ``order``, which should identify a row.

    Range partitions are sorted and written once; a row's place is its place in its partition plus the
    number of rows before that partition. Nothing is sorted in one task.
    """
    spread = df.repartitionByRange(parts, *[quoted(c) for c in order]) if parts else df.repartitionByRange(*[quoted(c) for c in order])
    stored = cut_lineage(spread.sortWithinPartitions(*[quoted(c) for c in order]).withColumn(position, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(position), 33)
    counts = stored.groupBy(part.alias("part")).agg((F.max(position).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"))
    before, starts = 0, {}
    for row in counts.orderBy("part").collect():  # one row a partition
        starts[row["part"]] = before
        before += row["n"]
    if not starts:
        return stored
    lookup = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if len(starts) <= 64 else None
    if lookup is not None:
        return stored.withColumn(position, lookup[part].cast("bigint") + F.col(position).bitwiseAND(F.lit((1 << 33) - 1)))
    table = df.sparkSession.createDataFrame(list(starts.items()), "part bigint, start bigint")
    return (
        stored.withColumn("part", part).join(F.broadcast(table), "part")
        .withColumn(position, F.col("start") + F.col(position).bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start")
    )


def tree_sum(parts: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Sum of the arrays in (chunk int, part int, data binary), per chunk.

    Partitions are added in groups of 64 chunks' worth first, so that no task holds the arrays of all partitions; what reaches
    the driver is one array a chunk, whose size the caller fixes.
    """

    def add(key, rows):
        total = sum(np.frombuffer(x, dtype) for x in rows["data"])
        rows = rows.iloc[:1].copy()
        rows["data"] = [total.tobytes()]
        return rows

    shape = "chunk int, part int, data binary"
    first = parts.groupBy("chunk", F.pmod("part", F.lit(64)).alias("group")).applyInPandas(add, shape)
    return {r["chunk"]: np.frombuffer(r["data"], dtype) for r in first.groupBy("chunk").applyInPandas(add, shape).collect()}


# ---- numpy word hashes ------------------------------------------------------------------------------------------------

SEGMENT = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 256), _MULTIPLIER, np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps)
    return _powers


def _segment_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a byte segment that ends at a word's end."""
    at = np.flatnonzero(~_IS_SPACE[data])
    if not len(at):
        return at, np.zeros(0, np.uint64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(np.diff(at), 1, out=first[1:])
    begins = np.flatnonzero(first)
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        values = _BYTE[data[at]] * _power_table(int(lengths.max()))[place]
        return at[begins], mix64(np.add.reduceat(values, begins) + lengths.astype(np.uint64))


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z folded, and per text the end of its words in that array.

    Works on segments of 1 MB cut at white space, so that a very long text needs no more memory than its words.
    """
    parts = [t or b"" for t in texts]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in parts), np.int64, len(parts)))
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while hi < len(data) and not _IS_SPACE[data[hi - 1]]:
            gaps = np.flatnonzero(_IS_SPACE[data[hi : hi + SEGMENT]])
            hi = hi + int(gaps[0]) + 1 if len(gaps) else min(len(data), hi + SEGMENT)
        s, h = _segment_hashes(data[lo:hi])
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def slices(texts: Sequence[bytes | None], size: int = 2 * SEGMENT):
    """Consecutive ranges of the texts of about ``size`` bytes, at least one text each: bounds the memory of a task."""
    lo = total = 0
    for k, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def rolled_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """63-bit hash of the ``width`` words from each place on; the last places run into the next text."""
    rolled = np.zeros_like(words)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled *= _MULTIPLIER
            rolled[: max(0, len(words) - k)] += words[k:]
    return mix64(rolled) >> np.uint64(1)


def shingle_sets(texts: Sequence[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; a shorter text is one shingle, an empty one none."""
    words, ends = word_hashes(texts)
    rolled = rolled_hashes(words, width)
    out, lo = [], 0
    for hi in ends.tolist():
        n = hi - lo
        if n >= width:
            values = np.sort(rolled[lo : hi - width + 1])
            fresh = np.empty(len(values), bool)
            fresh[0] = True
            np.not_equal(values[1:], values[:-1], out=fresh[1:])
            out.append(values[fresh])
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    h = h * _MULTIPLIER + w
            out.append(mix64(np.array([h], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
        lo = hi
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


# ---- span digests -----------------------------------------------------------------------------------------------------


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,value>> in code points, in the JVM.

    The pieces between matches and the matches alternate, so their lengths add up to every match's place.
    Evaluates to an empty array without scanning twice when nothing matches.
    """
    return F.when(text.rlike(pattern), F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))


def placed(found: Column) -> Column:
    """Turn the (gaps, hits) of ``found_spans`` into array<struct<start,end,value>>."""
    steps = F.zip_with(
        F.slice(found["gaps"], F.lit(1), F.size(found["hits"])), found["hits"],
        lambda g, h: F.struct(F.length(g).cast("bigint").alias("skip"), h.alias("value")),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))
    walked = F.aggregate(
        steps, start,
        lambda acc, x: F.struct(
            (acc["at"] + x["skip"] + F.length(x["value"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
            ))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.coalesce(walked, empty)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of a sorted array of structs with those fields."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,value:string>"


def ranked_spans(found: Column, kind: str, rank: int, keep) -> Column:
    """Spans of one kind that pass ``keep(value)``, sortable by start, then kind rank."""
    return F.transform(
        F.filter(found, lambda s: keep(s["value"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
        ),
    )
