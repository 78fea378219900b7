"""Token ids of a corpus as wavelet matrices, one compressed file per shard.

``write`` tokenizes whole texts, orders documents by id and writes shards below a folder; ``read`` gives the documents back from
those files alone, ``count`` and ``occurrences`` search them, and ``Shard`` opens the bytes of one file.

Format of a file (little endian): magic, header length (uint32), header (JSON), ids (zstd of a JSON list of strings or null), document
ends (zstd of int64), and per bit-plane, most significant first, its chunks. A plane holds one bit of every token, in the order that the
planes above leave: tokens with bit 0 first, then those with bit 1. Each chunk of ``CHUNK`` bits is zstd on its own, and the
header has the chunks' lengths and the ones before each, so that access, rank and select read two or three chunks a plane.

Order: id ascending (null first), then text hash, then text; repeated rows stay. A null or empty text is the end id alone. A text is never
split over shards; a shard closes at ``SHARD_TOKENS`` tokens, so a longer text makes a longer shard. Empty tables give no shard.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import hidden, need, quoted, sized_broadcast, slices
from plumbline.session import cut_lineage, plan_bytes, scratch_path, shuffle_width

MAGIC = b"WVMX0001"
CHUNK = 1 << 17
SHARD_TOKENS = 1 << 21
PART_BYTES = 64 * 1024 * 1024
#: Distinct units after which a Python worker forgets them all. It changes the speed, not the result.
MEMO = 1_500_000
PIECE = 4 << 20

# ---- the matrix -------------------------------------------------------------------------------------------------------


def _planes(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit-planes as boolean arrays; every plane sorts the tokens stably by its bit for the next."""
    for k in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << k)) != 0
        yield ones
        ids = np.concatenate([ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))])


def pack(ids: np.ndarray, doc_ids: Sequence[str | None], ends: Sequence[int], **header) -> bytes:
    """The file of one shard: tokens, the documents' ids and where each document ends."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    ids = np.ascontiguousarray(ids, np.uint32 if len(ids) and int(ids.max()) > 0xFFFF else np.uint16)
    bits = int(ids.max()).bit_length() if len(ids) else 0
    body, sizes, before, zeros = [], [], [], []
    for ones in _planes(ids, bits):
        chunks = [ones[lo : lo + CHUNK] for lo in range(0, len(ones), CHUNK)]
        counts = [int(np.count_nonzero(c)) for c in chunks]
        packed = [squeeze(np.packbits(c).tobytes()) for c in chunks]
        body += packed
        sizes.append([len(p) for p in packed])
        before.append(np.concatenate([[0], np.cumsum(counts)]).tolist())
        zeros.append(len(ids) - sum(counts))
    names = squeeze(json.dumps(list(doc_ids)).encode())
    places = squeeze(np.asarray(ends, "<i8").tobytes())
    head = json.dumps(header | {
        "tokens": len(ids), "documents": len(doc_ids), "chunk": CHUNK, "zeros": zeros, "sizes": sizes, "ones_before": before,
        "names": len(names), "places": len(places),
    }).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, names, places, *body])


class Shard:
    """One shard file. Methods take token positions inside the shard."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of wavelet planes")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4
        self.header = json.loads(data[at : at + n])
        at += n
        self._data, self._names, self._places = data, at, at + self.header["names"]
        at = self._places + self.header["places"]
        self._chunks = []
        for sizes in self.header["sizes"]:
            offsets = at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            self._chunks.append(offsets)
            at = int(offsets[-1])
        self.n = self.header["tokens"]
        self.bits = len(self.header["zeros"])
        self._chunk = lru_cache(maxsize=64)(self._read_chunk)

    @property
    def doc_ids(self) -> list[str | None]:
        raw = self._data[self._names : self._names + self.header["names"]]
        return json.loads(zstandard.ZstdDecompressor().decompress(raw))

    @property
    def ends(self) -> np.ndarray:
        raw = self._data[self._places : self._places + self.header["places"]]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8")

    def _read_chunk(self, plane: int, k: int) -> np.ndarray:
        lo, hi = self._chunks[plane][k], self._chunks[plane][k + 1]
        size = min(self.header["chunk"], self.n - k * self.header["chunk"])
        raw = zstandard.ZstdDecompressor().decompress(self._data[lo:hi], max_output_size=(size + 7) // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size)

    def _plane(self, plane: int) -> np.ndarray:
        parts = [self._read_chunk(plane, k) for k in range(len(self.header["sizes"][plane]))]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(bool)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, self.header["chunk"])
        return self.header["ones_before"][plane][k] + (int(np.count_nonzero(self._chunk(plane, k)[:rest])) if rest else 0)

    def _place(self, plane: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) bit of that value in a plane."""
        before = np.asarray(self.header["ones_before"][plane])
        if not bit:
            before = np.minimum(np.arange(len(before)) * self.header["chunk"], self.n) - before
        k = int(np.searchsorted(before, nth, side="right")) - 1
        return k * self.header["chunk"] + int(np.flatnonzero(self._chunk(plane, k) == bit)[nth - before[k]])

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            bit = int(self._chunk(p, i // self.header["chunk"])[i % self.header["chunk"]])
            ones = self._ones(p, i)
            token, i = token << 1 | bit, self.header["zeros"][p] + ones if bit else i - ones
        return token

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """The range that the token's occurrences in [lo, hi) have below the last plane."""
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.header["zeros"][p] + a, self.header["zeros"][p] + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._narrow(token, min(lo, hi), hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position ``i``."""
        return self.count(token, 0, i)

    def select(self, token: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) occurrence of a token."""
        a, b = self._narrow(token, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._place(p, bit, i - self.header["zeros"][p] if bit else i)
        return i

    def positions(self, token: int) -> np.ndarray:
        """Positions of all occurrences, ascending; from the last plane up, a whole plane at a time."""
        a, b = self._narrow(token, 0, self.n)
        at = np.arange(a, b)
        for p in range(self.bits - 1, -1, -1) if b > a else ():
            bit = token >> (self.bits - 1 - p) & 1
            places = np.flatnonzero(self._plane(p) == bool(bit))
            at = places[at - self.header["zeros"][p] if bit else at]
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, as uint32; undoes the planes' sorts from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            ones, zeros = self._plane(p), self.header["zeros"][p]
            above = np.empty(self.n, kind)
            above[~ones] = ids[:zeros]
            above[ones] = ids[zeros:] + kind(1 << (self.bits - 1 - p))
            ids = above
        return ids.astype("<u4")


# ---- tokens -----------------------------------------------------------------------------------------------------------

# Characters that some engines count as white space and others do not; texts with them are cut only between ASCII letters.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK, _QUOTE = 3, 4
_KIND = np.zeros(256, np.uint8)  # ASCII letters, digits, marks and the apostrophe; 0 for all else
_KIND[33:127] = _MARK
_KIND[_LETTER], _KIND[48:58], _KIND[39] = 1, 2, _QUOTE
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb" ?[^ \t\n\x0b\x0c\r]+")
_CUT = re.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])")


def _unit_starts(data: np.ndarray, firsts: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Where the units of concatenated texts begin.

    A unit is a run of like characters and one blank before it, or white space. Byte-level tokenizers whose pattern takes blanks
    in front of words never merge over these borders, so the ids of a text are those of its units.
    """
    space = _SPACE[data]
    after = np.empty(len(data), bool)  # the next byte of the same text is no white space
    after[:-1] = ~space[1:]
    after[-1] = False
    after[firsts[1:] - 1] = False
    before = np.empty(len(data), bool)  # the byte before is white space
    before[0] = False
    before[1:] = space[:-1]
    starts = space & (after | ~before)
    starts[1:] |= ~space[1:] & before[1:] & (data[:-1] != 32)
    kind = _KIND[data]
    starts[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] != _QUOTE) & ((kind[:-1] != _MARK) | (kind[1:] != _QUOTE))
    if odd.any():
        letter = _LETTER[data]
        sure = np.zeros(len(data), bool)
        sure[1:-1] = (data[1:-1] == 32) & letter[:-2] & letter[2:]
        starts = np.where(odd, sure, starts)
    starts[firsts] = True
    return np.flatnonzero(starts)


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): one unit of each kind and, for every unit, its kind. Units are kept apart exactly, not by hash alone."""
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.full(int(lengths.max()), _FACTOR, np.uint64)
        powers[0] = 1
        hashes = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[place], starts)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    same = lengths[first][which] == lengths
    place += np.repeat(np.where(same, starts[first][which], starts), lengths)
    same &= np.logical_and.reduceat(data[place] == data, starts)
    if not same.all():  # equal hashes of different units: each stands for itself
        other = np.flatnonzero(~same)
        which[other] = len(first) + np.arange(len(other))
        first = np.concatenate([first, other])
    return first, which


class Encoder:
    """Ids of texts by a byte-level tokenizer file; every distinct unit of a batch is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._line_end = np.array(self._tokenizer.encode("\n", add_special_tokens=False).ids, np.uint32)
        if len(self._line_end) != 1:
            raise ValueError("the tokenizer has no id for a line end")
        self._forget()

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._ids, self._starts, self._lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _alone(self, units: list[bytes]) -> list[np.ndarray]:
        texts = [u.decode("utf-8", "replace") for u in units]
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids and line ends of units of one word each; a line end is never merged with its neighbours."""
        texts = ["".join(f"{u}\n" for u in b"\n".join(units[lo : lo + 64]).decode("utf-8", "replace").split("\n")) for lo in range(0, len(units), 64)]
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        words = list(filter(_WORD.fullmatch, units))
        if words and _ODD.search(b"\n".join(words).decode("utf-8", "replace")):
            words = [u for u in words if not _ODD.search(u.decode("utf-8", "replace"))]
        known = set(words)
        rest = [u for u in units if u not in known]
        lines = np.concatenate([np.zeros(0, np.uint32), *self._lines(words)])
        ends = lines == self._line_end[0]
        lengths = np.diff(np.flatnonzero(ends), prepend=-1) - 1
        others = self._alone(rest)
        new = np.concatenate([lengths, np.fromiter(map(len, others), np.int64, len(others))])
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(new) - new])
        self._lengths = np.concatenate([self._lengths, new])
        self._ids = np.concatenate([self._ids, lines[~ends], *others])
        for u in (words, rest):
            self._index.update(zip(u, range(len(self._index), len(self._index) + len(u))))

    def _table(self, units: list[bytes]) -> np.ndarray:
        """Row of every (distinct) unit in the table of known units; learns those that are missing."""
        if len(self._index) > MEMO:
            self._forget()
        missing = [u for u in units if u not in self._index]
        if missing:
            self._learn(missing)
        return np.fromiter(map(self._index.__getitem__, units), np.int64, len(units))

    def _pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty texts, or of parts of texts cut where ``_CUT`` matches."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        firsts = np.cumsum(sizes) - sizes
        odd = np.zeros(len(data), bool)
        for k in range(len(pieces)):
            if not pieces[k].isascii() or any(c in pieces[k] for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
                if _ODD.search(pieces[k].decode("utf-8", "replace")):
                    odd[firsts[k] : firsts[k] + sizes[k]] = True
        starts = _unit_starts(data, firsts, odd)
        lengths = np.diff(np.append(starts, len(data)))
        first, which = _distinct(data, starts, lengths)
        raw = data.tobytes()
        rows = self._table([raw[a : a + n] for a, n in zip(starts[first].tolist(), lengths[first].tolist())])[which]
        n = self._lengths[rows]
        ends = np.cumsum(n)
        tokens = self._ids[np.arange(ends[-1]) + np.repeat(self._starts[rows] - (ends - n), n)]
        return np.split(tokens, ends[np.searchsorted(starts, firsts[1:]) - 1])

    def encode(self, texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of every text, in order; at most about two pieces are held at once."""
        for lo, hi in slices(texts, PIECE):
            batch, owner = [], []
            for k in range(lo, hi):
                text = texts[k] or b""
                while len(text) > 2 * PIECE and (cut := _CUT.search(text, PIECE)):
                    batch.append(text[: cut.start()])
                    owner.append(k)
                    text = text[cut.start() :]
                if text:
                    batch.append(text)
                    owner.append(k)
            made: dict[int, list[np.ndarray]] = {}
            for a, b in slices(batch, 2 * PIECE):
                for k, ids in zip(owner[a:b], self._pieces(batch[a:b])):
                    made.setdefault(k, []).append(ids)
            for k in range(lo, hi):
                yield np.concatenate(made[k]) if k in made else np.zeros(0, np.uint32)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


# ---- Spark ------------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the shards of all documents below ``folder`` and return it.

    Range partitions by id stream through the tokenizer, and every shard becomes one file through Spark's own committer, so lost
    executors leave no half shards. ``tokenizer`` is the path of a byte-level tokenizer file that every executor has.
    """
    need(docs, id_col, text_col)
    id_, text, mix = hidden(docs, "wm_id", "wm_text", "wm_mix")
    rows = docs.select(quoted(id_col).alias(id_), quoted(text_col).cast("string").alias(text)).withColumn(mix, F.xxhash64(text))
    size, parts = plan_bytes(rows), shuffle_width(docs.sparkSession)
    if size < 1 << 60:  # beyond that Spark does not know it
        parts = max(parts, size // PART_BYTES)
    ordered = rows.repartitionByRange(parts, id_, mix).sortWithinPartitions(id_, mix, text)

    def shards(batches):
        make, part = encoder(tokenizer), TaskContext.get().partitionId()
        before, ids, names, ends, total = 0, [], [], [], 0

        def close():
            header = {"part": part, "before": before}
            return pa.RecordBatch.from_arrays([pa.array([pack(np.concatenate(ids), names, ends, **header)], pa.binary())], ["content"])

        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for key, tokens in zip(keys, make.encode(texts)):
                ids.append(np.append(tokens, np.uint32(end_id)).astype(np.uint32))
                total += len(ids[-1])
                names.append(key)
                ends.append(total)
                if total >= shard_tokens:
                    yield close()
                    before += total
                    ids, names, ends, total = [], [], [], 0
        if ids:
            yield close()

    packed = ordered.select(quoted(id_).cast("string"), quoted(text).cast("binary")).mapInArrow(shards, "content binary")
    # the text sink writes the bytes as they are, each row to a file of its own, and a line end that the header's lengths leave out
    packed.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content")


def read(spark: SparkSession, folder: str, id_type: str = "bigint", with_tokens: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, tokens]) of every document, from the files alone.

    ``start`` counts the tokens of all documents before it in the whole corpus; ``ids_crc32`` is taken over the document's
    ids as little-endian unsigned 32-bit integers.
    """
    kinds = "part bigint, id string, at bigint, n_tokens bigint, ids_crc32 bigint" + (", tokens array<bigint>" if with_tokens else "")

    def documents(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                tokens, ends, ids = shard.tokens(), shard.ends, shard.doc_ids
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                bounds = list(zip(starts.tolist(), ends.tolist()))
                columns = [
                    pa.array([shard.header["part"]] * len(ids), pa.int64()), pa.array(ids, pa.string()),
                    pa.array(starts + shard.header["before"], pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(tokens[a:b].tobytes()) for a, b in bounds], pa.int64()),
                ]
                if with_tokens:
                    columns.append(pa.array([tokens[a:b] for a, b in bounds], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["part", "id", "at", "n_tokens", "ids_crc32", "tokens"][: len(columns)])

    found = cut_lineage(_files(spark, folder).mapInArrow(documents, kinds))
    starts = _part_starts(found.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")))
    return found.join(starts, "part").select(
        F.col("id").cast(id_type).alias("id"), (F.col("at") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", *(["tokens"] if with_tokens else [])
    )


def _part_starts(sizes: DataFrame) -> DataFrame:
    """Tokens before each partition: sums within runs of 512 partitions, then one row a run through the driver."""
    stored = cut_lineage(sizes.withColumn("run", F.shiftright("part", 9)))
    total, before = 0, []
    for run, n in sorted(stored.groupBy("run").agg(F.sum("n")).collect()):
        before.append((run, total))
        total += n
    runs = stored.sparkSession.createDataFrame(before, "run bigint, run_start bigint")
    window = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = stored.select("part", "run", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("inside"))
    return sized_broadcast(cut_lineage(inside.join(F.broadcast(runs), "run").select("part", (F.col("inside") + F.col("run_start")).alias("part_start"))))


def count(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n): occurrences of each given token in all shards, by rank alone."""
    wanted = list(dict.fromkeys(int(t) for t in tokens))

    def counted(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([shard.count(t) for t in wanted], pa.int64())], ["token", "n"])

    return _files(spark, folder).mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int, id_type: str = "bigint") -> DataFrame:
    """(id, position): every place of a token, counted from 0 inside its document."""

    def found(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                at, ends, ids = shard.positions(int(token)), shard.ends, shard.doc_ids
                which = np.searchsorted(ends, at, side="right")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in which], pa.string()), pa.array(at - starts[which], pa.int64())], ["id", "position"])

    return _files(spark, folder).mapInArrow(found, "id string, position bigint").select(F.col("id").cast(id_type).alias("id"), "position")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to a fresh shared folder and read the documents back from them."""
    folder = write(docs, tokenizer, scratch_path(docs.sparkSession, "wavelet"), id_col, text_col)
    return read(docs.sparkSession, folder, dict(docs.dtypes)[id_col])
