"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question keeps its template when its parameters change. Windows
of template tokens of benchmark items and documents are joined by hash. A hit counts if its slots agree: along one
alignment of document and item, equal slot values of the item must stand for equal values in the document. Where one
stands for several, its most frequent value there holds and only windows with another are dropped; windows with the item's own
values always count. Documents that hold enough of an item's windows, or a long enough part of it word for word, are
reported.

The benchmark's window hashes go to all tasks when their measured size allows it, as a filter of document windows; else
all document windows are joined. Either way the join on the hash decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_BYTES, hidden, need, quoted, rolled_hashes, slices
from plumbline.session import cut_lineage, plan_bytes

WIDTH, LEAST_LITERALS, COVERAGE = 8, 4, 0.5
#: Words of an item that a document may not hold word for word, whatever their share of the item is.
LEAST_WORDS = 50
# fixed values: units of measure and money
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ton tons ml l s sec min h hr hrs ms day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter "
    "liters litre litres second seconds minute minutes hour hours dollar dollars euro euros cent cents percent % $ € £ mph kmh".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’*_#|"
SLOT = {"<num>": 1, "<unit>": 2, "<name>": 3}


def template(text: str) -> tuple[list[str], list[str]]:
    """(template tokens, their values). A capitalised word that doesn't begin a sentence is a name."""
    kinds, values = [], []
    begins = True
    for raw in WORD.findall(text):
        word = raw.strip(EDGE)
        if word:
            low = word.lower()
            if NUMBER.match(word):
                kind = "<num>"
            elif low in UNITS:
                kind = "<unit>"
            elif not begins and word[0].isupper() and word[1:].islower():
                kind = "<name>"
            else:
                kind = low
            kinds.append(kind)
            values.append(low)
            begins = raw[-1] in ".!?:" or raw[-2:-1] in (".", "!", "?")
        else:
            begins = begins or raw[-1] in ".!?"
    return kinds, values


def _token_hash(kind: str, cache: dict[str, int]) -> int:
    h = cache.get(kind)
    if h is None:
        data = kind.encode("utf-8", "surrogatepass")
        h = 1469598103934665603
        for byte in data:
            h = ((h ^ byte) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        if len(cache) < 200_000:
            cache[kind] = h
    return h


def _windows(kinds: list[str], cache: dict[str, int], width: int) -> np.ndarray:
    """Hash of each window of ``width`` template tokens."""
    hashed = np.array([_token_hash(k, cache) for k in kinds], np.uint64)
    return rolled_hashes(hashed, width)[: max(0, len(kinds) - width + 1)].view(np.int64)


def _literal(kinds: list[str], width: int) -> np.ndarray:
    """Which windows hold enough tokens that aren't placeholders."""
    plain = np.cumsum([0, *[k not in SLOT for k in kinds]])
    return plain[width:] - plain[:-width] >= min(LEAST_LITERALS, width)


def _item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, width, place, window, kinds, values, total): the informative windows of each item, all if it has none."""

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                kinds, values = template(text or "")
                width = min(WIDTH, len(kinds))
                if not width:
                    continue
                windows, plain = _windows(kinds, cache, width), _literal(kinds, width)
                places = np.flatnonzero(plain) if plain.any() else np.arange(len(windows))
                for p in places.tolist():
                    rows.append((item, width, p, int(windows[p]), [k if k in SLOT else "" for k in kinds[p : p + width]], values[p : p + width], len(places)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                     pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], pa.list_(pa.string())), pa.array(cols[6], pa.int64())],
                    names=["item", "width", "place", "window", "kinds", "values", "total"],
                )

    rows = items.select(quoted(id_col).cast("bigint").alias("item"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, "item bigint, width int, place bigint, window bigint, kinds array<string>, values array<string>, total bigint")


def _doc_windows(docs: DataFrame, widths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(id, key, width, at, window, found): windows of documents, only the wanted ones if these are given."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        cache: dict[str, int] = {}
        probe = shared.value if shared is not None else None
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
            for lo, hi in slices(texts):
                rows = []
                for k in range(lo, hi):
                    kinds, values = template((texts[k] or b"").decode("utf-8", "replace"))
                    for width in widths:
                        windows = _windows(kinds, cache, width)
                        if probe is not None:
                            at = np.minimum(np.searchsorted(probe, windows), len(probe) - 1)
                            places = np.flatnonzero(probe[at] == windows)
                        else:
                            places = np.arange(len(windows))
                        for p in places.tolist():
                            rows.append((ids[k], keys[k], width, p, int(windows[p]), values[p : p + width]))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                         pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.list_(pa.string()))],
                        names=["id", "key", "width", "at", "window", "found"],
                    )

    return docs.mapInArrow(run, "id bigint, key bigint, width int, at bigint, window bigint, found array<string>")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, least_words: int = LEAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(id, key, item, n_windows, n_matched, coverage, changed): documents that hold items, one row a pair: a share of ``coverage``
    of the item's windows, or ``least_words`` of its words in windows with the item's own values.

    ``key`` is the hash of the row's id and text; repeated rows are one. ``changed`` says that a slot has another value than in the
    item. Null or empty texts and items match nothing; equal items are reported each. Items of fewer than 8 template tokens are
    one window. Empty tables give empty results. Extra columns are ignored.
    """
    need(docs, id_col, text_col)
    need(items, item_col, item_text_col)
    windows = cut_lineage(_item_windows(items, item_col, item_text_col))
    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most 8
    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("key"), quoted(text_col).alias("text"))
    small = plan_bytes(windows) <= broadcast_bytes
    wanted = np.sort(windows.select("window").distinct().toPandas()["window"].to_numpy(np.int64)) if small and widths else None
    hits = _doc_windows(rows, widths or [WIDTH], wanted)
    if wanted is not None:
        hits = cut_lineage(hits)
    met = hits.join(F.broadcast(windows) if small else windows, ["window", "width"])
    met = met.withColumn("shift", F.col("at") - F.col("place")).dropDuplicates(["key", "item", "shift", "place"])
    placed = F.transform(F.arrays_zip("kinds", "values", "found"), lambda s, i: F.struct((F.col("place") + i).alias("p"), s["kinds"].alias("k"), s["values"].alias("v"), s["found"].alias("f")))
    slots = F.transform(F.filter(placed, lambda s: s["k"] != ""), lambda s: F.struct(s["p"].alias("p"), s["v"].alias("v"), s["f"].alias("f")))
    # per alignment: its windows, and for each item value the document value it stands for
    aligned = met.groupBy("id", "key", "item", "total", "width", "shift").agg(F.collect_list(F.struct(F.col("place"), slots.alias("slots"))).alias("windows"))
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten(F.transform("windows", lambda w: w["slots"]))))
    aligned = aligned.withColumn("pairs", F.array_distinct(F.transform("slots", lambda s: F.struct(s["v"].alias("v"), s["f"].alias("f")))))
    agreed = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["v"])))
    counted = F.transform("pairs", lambda x: F.struct(x["v"].alias("v"), x["f"].alias("f"), F.size(F.filter("slots", lambda s: (s["v"] == x["v"]) & (s["f"] == x["f"]))).alias("n")))
    aligned = aligned.withColumn("counted", F.when(~agreed, counted))

    def beats(y, x):
        """More places; then the item's own value, then the smaller one."""
        tie = (y["n"] == x["n"]) & ((y["f"] == y["v"]) | ((x["f"] != x["v"]) & (y["f"] < x["f"])))
        return (y["v"] == x["v"]) & (y["f"] != x["f"]) & ((y["n"] > x["n"]) | tie)

    winners = F.filter("counted", lambda x: ~F.exists("counted", lambda y: beats(y, x)))
    aligned = aligned.withColumn("pairs", F.coalesce(F.transform(winners, lambda x: F.struct(x["v"].alias("v"), x["f"].alias("f"))), F.col("pairs")))

    def verbatim(w):
        return F.forall(w["slots"], lambda s: s["v"] == s["f"])

    good = F.filter("windows", lambda w: verbatim(w) | F.forall(w["slots"], lambda s: F.array_contains("pairs", F.struct(s["v"].alias("v"), s["f"].alias("f")))))
    aligned = aligned.withColumn("windows", good).filter(F.size("windows") > 0)
    whole = aligned.select(
        "id", "key", "item", "total", "width", F.transform("windows", lambda w: w["place"]).alias("places"),
        F.transform(F.filter("windows", verbatim), lambda w: w["place"]).alias("same"), F.exists("slots", lambda s: s["v"] != s["f"]).alias("changed"),
    ).groupBy("id", "key", "item", "total", "width").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_matched"), F.max("changed").alias("changed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("same"),
    )
    # words below verbatim windows, which overlap
    words = F.aggregate(
        "same", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.col("width") - F.greatest(acc["end"] - p, F.lit(0).cast("bigint"))).alias("n"), (p + F.col("width")).alias("end")),
        lambda acc: acc["n"],
    )
    share = F.col("n_matched") / F.col("total")
    return whole.filter((share >= coverage) | (words >= least_words)).select("id", "key", "item", F.col("total").alias("n_windows"), "n_matched", share.alias("coverage"), "changed")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay."""
    found = contaminated(docs, items, id_col, text_col, **options)
    (key,) = hidden(docs, "leak_key")
    bad = found.select(F.col("key").alias(key)).distinct()
    return docs.join(bad, F.xxhash64(quoted(id_col), quoted(text_col)) == F.col(key), "left_anti")
