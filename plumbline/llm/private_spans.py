"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees score each by its format and its context; a
threshold per kind, calibrated on held-out candidates, selects the redactions. The base kinds are always reported, and
they label the training candidates: a candidate is personal if a base span covers the same place. The trees don't see
the checks that make a base span (they see shapes and surroundings), so they carry over to spans that the strict
patterns miss. Fitting and calibration use all candidates, a fourth of them held out by hash; ``fit_rows`` can bound them.
DataFrame and Spark ML operations only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPAN, found_spans, hidden, need, placed, quoted, ranked_spans, whole_text
from plumbline.session import cut_lineage

# fixed values: the base kinds, in order. Loops are possessive and a match begins where a run or the last match ends: the spans are those of
# the plain forms (a start inside a run fails if the run's first place does), without recursion or a second look at a long run
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]++"
_RUN = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++"
EMAIL = rf"{_RUN}@{_LABEL}(?:\.{_LABEL})++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
# generators of candidates: wider than the base patterns
WIDE = {
    "mail_like": rf"{_RUN}(?:@|\x20?\((?:at|AT)\)\x20?|\x20(?:at|AT)\x20){_LABEL}(?:(?:\.|\x20(?:dot|DOT)\x20){_LABEL})++",
    "address_like": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "digits_like": r"[0-9](?:[\x20.-]?[0-9]){9,}+",
    "phone_like": r"(?:\+|\()[0-9][\x20().0-9-]{7,}[0-9]",
}
TREES, DEPTH = 10, 3
#: Least precision on held-out candidates that a threshold must reach.
PRECISION = 0.95
CONTEXT = 24
WORDS = {"near_mail": "mail|contact|write", "near_phone": "phone|tel|call|mobile|fax", "near_card": "card|visa|credit|account|iban", "near_net": "host|server|addr|ip|client"}


def luhn(digits: Column) -> Column:
    """The check sum of a digit string is a multiple of 10."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(turned, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _spans(docs: DataFrame, text: str, kinds: dict[str, str], tests, first_rank: int, into: str) -> DataFrame:
    steps = hidden(docs, *[f"s_{k}" for k in kinds])
    out = docs
    for name, pattern in zip(steps, kinds.values()):
        out = out.withColumn(name, found_spans(F.col(text), pattern))
    for name in steps:
        out = out.withColumn(name, placed(F.col(name)))
    arrays = [ranked_spans(F.col(n), kind, first_rank + k, test) for k, (n, kind, test) in enumerate(zip(steps, kinds, tests))]
    return out.withColumn(into, F.sort_array(F.concat(*arrays))).drop(*steps)


def _base_tests():
    return (
        lambda v: F.lit(True),
        lambda v: ~F.exists(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).__gt__(3) | (F.regexp_replace(p, "^0+(?=.)", "").substr(1, 4).cast("int") > 255)),
        lambda v: F.length(_digits(v)).between(14, 19) & luhn(_digits(v)),
        lambda v: F.length(_digits(v)).between(10, 15),
    )


def features() -> list[Column]:
    """Shape and surroundings of a candidate with columns kind, value, before, after."""
    value, before, after = F.col("value"), F.lower("before"), F.col("after")
    n = F.length(value).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double") / n

    shape = [
        n, F.length(_digits(value)).cast("double"), share("[0-9]"), share("[A-Za-z]"), share("[.]"), share("[ -]"), share("[()]"),
        F.size(F.split(value, "[^0-9]+")).cast("double"), value.startswith("+").cast("double"), value.contains("@").cast("double"),
        F.regexp_count(value, F.lit(r"\.[A-Za-z]{2,}$")).cast("double"),
        before.rlike(r"[A-Za-z0-9]$").cast("double"), after.rlike(r"^[A-Za-z0-9]").cast("double"), before.rlike(r"[:=#]\s?$").cast("double"),
    ]
    kind = [(F.col("kind") == k).cast("double") for k in WIDE]
    return shape + kind + [before.rlike(words).cast("double") for words in WORDS.values()]


def _fit(candidates: DataFrame, fit_rows: int | None):
    """Trees and a threshold a kind, from all candidates or the ``fit_rows`` with the smallest hashes; None without both labels."""
    ordered = candidates.withColumn("order", F.xxhash64("value", "before", "after"))
    chosen = ordered if fit_rows is None else ordered.orderBy("order").limit(fit_rows)
    sample = cut_lineage(chosen.withColumn("held", F.pmod(F.col("order"), F.lit(4)) == 0))
    seen = sample.filter("NOT held").groupBy("label").count().count()  # two rows at most
    if seen < 2:
        return None, {}
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=16).fit(sample.filter("NOT held"))
    scored = model.transform(sample.filter("held")).select("kind", "label", F.round(vector_to_array("probability")[1], 2).alias("p"))
    steps = scored.groupBy("kind", "p").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).collect()  # 101 rows a kind
    limits = {}
    for kind in {r["kind"] for r in steps}:
        hits = total = 0
        for r in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["p"]):
            hits, total = hits + r["hits"], total + r["n"]
            if hits >= PRECISION * total:
                limits[kind] = max(0.5, float(r["p"]))
    return model, limits


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int | None = None, prefix: str = "private_") -> DataFrame:
    """All rows with ``private_base`` and ``private_spans`` (arrays of start, rank, kind, end, value, places in code points).

    Added spans that overlap a base span are left out; of added spans that overlap, the likelier stays (ties: the earlier, then the
    longer). Kinds without a threshold of enough precision add nothing. A null text is an empty one; repeated rows get the same
    spans; rows with one id and different texts are told apart by the text's hash. Columns of the input stay, and a prefix
    that clashes is an error. Empty tables give empty results.
    """
    need(docs, id_col, text_col)
    names = {n: prefix + n for n in ("base", "spans")}
    if {n.lower() for n in names.values()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"prefix {prefix!r} clashes with a column of the table")
    text, base, wide, key = hidden(docs, "t_", "b_", "w_", "k_")
    with_text = docs.withColumn(text, whole_text(text_col))
    scanned = _spans(with_text, text, dict(zip(BASE, (EMAIL, IP, CARD, PHONE))), _base_tests(), 0, base)
    scanned = _spans(scanned, text, WIDE, [lambda v: F.length(v) <= 200] * len(WIDE), len(BASE), wide).withColumn(key, F.xxhash64(quoted(id_col), F.col(text)))
    rows = scanned.filter(F.size(wide) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(base).alias("base"), F.explode(wide).alias("s"))
    start, end = F.col("s.start").cast("int"), F.col("s.end").cast("int")
    rows = rows.select(
        "key", F.struct("s.start", "s.rank", "s.kind", "s.end", "s.value").alias("s"), F.col("s.kind").alias("kind"), F.col("s.value").alias("value"),
        F.substring("text", F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))).alias("before"),
        F.substring("text", end + 1, F.lit(4)).alias("after"),
        F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"])).cast("int").alias("label"),
    ).dropDuplicates(["key", "s"])
    assembled = [c.alias(f"f{k}") for k, c in enumerate(features())]
    candidates = cut_lineage(rows.select("key", "s", "kind", "value", "before", "after", "label", *assembled))
    vectors = VectorAssembler(inputCols=[f"f{k}" for k in range(len(assembled))], outputCol="features").transform(candidates)
    model, limits = _fit(vectors, fit_rows)
    none = F.array().cast(f"array<{SPAN}>")
    if model is None or not limits:
        added = candidates.limit(0).select(F.col("key").alias("key_"), F.array("s").alias("added"))
    else:
        limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
        good = model.transform(vectors.filter("label = 0")).withColumn("p", F.round(vector_to_array("probability")[1], 2)).filter(F.col("p") >= limit[F.col("kind")])
        order = F.struct((-F.col("p")).alias("p"), F.col("s.start").alias("start"), (-F.col("s.end")).alias("end"), F.col("s").alias("s"))
        picked = good.groupBy("key").agg(F.sort_array(F.collect_list(order)).alias("all"))
        free = F.aggregate(
            "all", none,
            lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["s"]["end"]) & (x["s"]["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x["s"]))),
        )
        added = picked.select(F.col("key").alias("key_"), free.alias("added"))
    joined = scanned.drop(text, wide).join(added, F.col(key) == F.col("key_"), "left")
    return joined.select(
        *[quoted(c) for c in docs.columns], F.col(base).alias(names["base"]),
        F.sort_array(F.concat(F.col(base), F.coalesce(F.col("added"), none))).alias(names["spans"]),
    )
