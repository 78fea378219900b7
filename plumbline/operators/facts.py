"""All numbers of a report from one read of a table.

The read counts (column, kind, value): values, shapes of text values and whole rows. Counting happens before the shuffle, so a hot value
costs one row a task. Every statistic then comes from that table of distinct values, and one row a column reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import patterns as P
from plumbline.operators.order_stats import running_totals
from plumbline.session import cut_lineage

_FAMILIES = ((T.StringType, "text"), (T.IntegralType, "integer"), (T.NumericType, "float"), (T.BooleanType, "boolean"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime"))


def _family(kind: T.DataType) -> str:
    return next((name for types, name in _FAMILIES if isinstance(kind, types)), "other")


def counted(df: DataFrame, columns: Sequence[str], compat: bool = False) -> DataFrame:
    """(column, kind, text, num, n): how often every value ('v'), text shape ('s') and whole row ('r') occurs. One read of ``df``."""
    family = {f.name: _family(f.dataType) for f in df.schema if f.name in columns}
    none = F.lit(None).cast("double")
    cells = []
    for c in columns:
        num = F.col(c).cast("double") if family[c] in ("integer", "float") else none
        cells.append(F.struct(F.lit(c).alias("column"), F.lit("v").alias("kind"), F.col(c).cast("string").alias("text"), num.alias("num")))
        if family[c] == "text":
            cells.append(F.struct(F.lit(c).alias("column"), F.lit("s").alias("kind"), P.shape(F.col(c), compat).alias("text"), none.alias("num")))
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in columns])))
    cells.append(F.struct(F.lit("*").alias("column"), F.lit("r").alias("kind"), row.alias("text"), none.alias("num")))
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("text IS NOT NULL")
    return cut_lineage(long.groupBy("column", "kind", "text", "num").agg(F.count(F.lit(1)).alias("n")))


class Facts:
    """Statistics of a table's columns."""

    def __init__(self, df: DataFrame, columns: Sequence[str], compat: bool = False, formats: list[str] | None = None):
        self.columns = list(columns)
        self.family = {f.name: _family(f.dataType) for f in df.schema if f.name in self.columns}
        self.numbers = [c for c in self.columns if self.family[c] in ("integer", "float")]
        self.texts = [c for c in self.columns if self.family[c] == "text"]
        counts = counted(df, self.columns, compat)
        value, is_text = F.col("kind") == "v", (F.col("kind") == "v") & F.col("column").isin(self.texts)
        parsed = counts.withColumn("_t", F.when(is_text, F.col("text"))).withColumn("_v", P.to_number(F.col("_t")))
        times = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
        rows = parsed.groupBy("column", "kind").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("num").alias("min"), F.max("num").alias("max"),
            (F.sum(F.col("n") * F.col("num")) / F.sum("n")).alias("mean"), times(value & (F.col("num") == F.floor("num"))).alias("integral"),
            times(F.col("_v").isNotNull()).alias("num"), times(F.col("_v") == F.floor("_v")).alias("whole"),
            times(P.to_datetime(F.col("_t"), formats).isNotNull()).alias("time"), times(P.to_boolean(F.col("_t")).isNotNull()).alias("bool"),
            *[times(F.col("_t").rlike(p)).alias(f"p_{name}") for name, p in P.FORMAT_PATTERNS.items()],
        ).collect()  # three rows a column at most
        by = {(r["column"], r["kind"]): r.asDict() for r in rows}
        whole = by.get(("*", "r"), {"n": 0, "distinct": 0})
        self.rows, self.distinct_rows = whole["n"], whole["distinct"]
        empty = {"n": 0, "distinct": 0, "min": None, "max": None, "mean": None, "integral": 0, "num": 0, "whole": 0, "time": 0, "bool": 0}
        self.values = {c: by.get((c, "v"), empty) for c in self.columns}
        self.shapes = {c: by.get((c, "s"), {"distinct": 0})["distinct"] for c in self.texts}
        self._spread(counts.filter((F.col("kind") == "v") & F.col("num").isNotNull()).select("column", "num", "n"))

    def _spread(self, numbers: DataFrame) -> None:
        """Quartiles from running counts of distinct values, then deviations and values outside the fences."""
        self.quartiles = {c: (None, None, None) for c in self.numbers}
        self.std = dict.fromkeys(self.numbers)
        self.outside = dict.fromkeys(self.numbers, 0)
        known = [c for c in self.numbers if self.values[c]["n"]]
        if not known:
            return
        size = F.element_at(F.create_map(*[x for c in known for x in (F.lit(c), F.lit(self.values[c]["n"]))]), F.col("column"))
        summed = numbers.groupBy("column", "num").agg(F.sum("n").alias("n"))
        upto = running_totals(summed, ["num"], {"upto": "n"}, ["column"]).withColumn("size", size)
        hits = []
        for i, p in enumerate((0.25, 0.5, 0.75)):
            place = (F.col("size") - 1) * F.lit(p)
            for side, at in (("a", F.floor(place)), ("b", F.ceil(place))):
                hits.append(F.max(F.when((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at), F.col("num"))).alias(f"{side}{i}"))
        for r in upto.groupBy("column").agg(*hits).collect():
            n = self.values[r["column"]]["n"]
            part = [((n - 1) * p) % 1 for p in (0.25, 0.5, 0.75)]
            self.quartiles[r["column"]] = tuple(r[f"a{i}"] + part[i] * (r[f"b{i}"] - r[f"a{i}"]) for i in range(3))
        bounds = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in self.quartiles.items() if q1 is not None}
        pick = lambda d: F.element_at(F.create_map(*[x for c, v in d.items() for x in (F.lit(c), F.lit(float(v)))]), F.col("column"))
        low, high, mean = (pick(d) for d in ({c: b[0] for c, b in bounds.items()}, {c: b[1] for c, b in bounds.items()}, {c: self.values[c]["mean"] for c in known}))
        out = (F.col("num") < low) | (F.col("num") > high)
        for r in numbers.groupBy("column").agg(
            F.sum(F.when(out, F.col("n")).otherwise(0)).alias("o"), F.sum(F.col("n") * F.pow(F.col("num") - mean, 2)).alias("sq")
        ).collect():
            n = self.values[r["column"]]["n"]
            self.outside[r["column"]] = r["o"]
            self.std[r["column"]] = math.sqrt(r["sq"] / (n - 1)) if n > 1 else None

    def inferred(self, c: str) -> str:
        """Numeric, then datetime, boolean, categorical (< 50 % distinct), text."""
        v, family = self.values[c], self.family[c]
        if not v["n"]:
            return "unknown"
        if family in ("integer", "float"):
            return "integer" if family == "integer" or v["integral"] == v["n"] else "float"
        if family in ("boolean", "datetime"):
            return family
        if v["num"] == v["n"]:
            return "integer" if v["whole"] == v["n"] else "float"
        if v["time"] == v["n"]:
            return "datetime"
        if v["bool"] == v["n"]:
            return "boolean"
        return "categorical" if v["distinct"] / v["n"] < 0.5 else "text"

    def scores(self) -> dict[str, float | None]:
        """Completeness, validity, uniqueness, consistency, accuracy and their weighted mean."""
        n, filled = self.rows, sum(v["n"] for v in self.values.values())
        valid = []
        for c in self.columns:
            kind = self.inferred(c)
            if kind != "unknown":
                text = self.family[c] == "text"
                valid.append((80.0 if kind in ("text", "categorical") else 60.0) if text else 100.0 if self.family[c] == kind else 60.0)
        measured = [c for c in self.numbers if self.values[c]["n"] >= 10]
        share = sum(self.outside[c] for c in measured) / sum(self.values[c]["n"] for c in measured) if measured else None
        out = {
            "completeness": filled * 100.0 / (n * len(self.columns)) if n else None,
            "validity": sum(valid) / len(valid) if valid else 0.0,
            "uniqueness": self.distinct_rows * 100.0 / n if n else None,
            "consistency": sum(100.0 / s for s in self.shapes.values() if s) / len(self.texts) if self.texts else 100.0,
            "accuracy": 85.0 if share is None else max(0.0, 100.0 - 200.0 * share),
        }
        weights = {"completeness": 0.25, "validity": 0.25, "uniqueness": 0.2, "consistency": 0.15, "accuracy": 0.15}
        out["overall"] = None if None in out.values() else sum(out[m] * w for m, w in weights.items())
        return out

    def rows_of_report(self) -> list[tuple[str, str, str, float | None]]:
        """(section, subject, metric, value) of every number."""
        pct = lambda a: round(a * 100.0 / self.rows, 2) if self.rows else None
        out: list[tuple] = []
        for c, v in self.values.items():
            out += [("profile", c, "null_count", self.rows - v["n"]), ("profile", c, "null_pct", pct(self.rows - v["n"]))]
            out += [("profile", c, "distinct_count", v["distinct"]), ("profile", c, "distinct_pct", pct(v["distinct"]))]
        for c in self.numbers:
            v = self.values[c]
            out += [("profile", c, m, v[m]) for m in ("min", "max", "mean")]
            out += [("profile", c, "std", self.std[c]), ("profile", c, "median", self.quartiles[c][1]), ("outliers", c, "outliers", self.outside[c])]
        out += [("scores", "*", m, None if s is None else round(s, 2)) for m, s in self.scores().items()]
        out += [("duplicates", "*", "duplicates", self.rows - self.distinct_rows), ("summary", "*", "rows", self.rows)]
        out.append(("missing", "*", "missing", sum(self.rows - v["n"] for v in self.values.values())))
        for c in self.texts:
            out += [("patterns", c, name, self.values[c][f"p_{name}"]) for name in P.FORMAT_PATTERNS if self.values[c].get(f"p_{name}")]
        return [(a, b, m, None if x is None else float(x)) for a, b, m, x in out]
