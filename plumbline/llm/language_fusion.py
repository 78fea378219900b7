"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigrams, hashed into a fixed table and counted per language over all labelled texts by
grouped aggregation. They are combined with what a page declares in its markup, and with a prior of its host, which is smoothed
towards its address suffix and that towards all pages; priors and the reliability of declarations are grouped counts over all
pages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hidden, need, quoted, sized_broadcast, slices
from plumbline.llm.page_diff import ARTICLE, blocks
from plumbline.session import cut_lineage

TABLE = 1 << 14
#: Strength of the smoothing towards the wider prior, and of the counts behind a declaration's reliability.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 8.0, 20.0, 4.0
#: Trigrams of a text overlap and depend on each other: their log likelihood counts this much, and at most for so many.
TRUST, MOST_GRAMS = 0.5, 400
#: Languages whose trigram counts a task holds at once; more are counted and scored block by block.
LANGUAGE_BLOCK = 64


def _grams(data: bytes) -> np.ndarray:
    """Hashed byte trigrams, ASCII letters folded."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(2246822519)) ^ (b[2:] * np.uint32(3266489917) + np.uint32(374761393))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(668265263)) >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    counts: DataFrame  # lang, gram, n

    def logs(self, lo: int) -> np.ndarray:
        """Log chances of the trigrams (languages x table) in the block of languages from ``lo`` on."""
        names = self.languages[lo : lo + LANGUAGE_BLOCK]
        counts = np.zeros((len(names), TABLE), np.int64)
        if names:
            place = (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1).alias("place")
            got = self.counts.filter(F.col("lang").isin(names)).select(place, "gram", "n").toPandas()  # bounded: block x table
            counts[got["place"].to_numpy(np.int64), got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        smoothed = counts + 0.5
        return np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts per language over all labelled texts; rows without a label or text teach nothing."""
    need(labelled, text_col, lang_col)
    rows = labelled.select(quoted(text_col).alias("text"), quoted(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # names only

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def rows_of(lang):
            grams = np.flatnonzero(held[lang])
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams, pa.int32()), "n": pa.array(held[lang][grams], pa.int64())})

        for batch in batches:
            texts, langs = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in slices(texts):
                for lang in set(langs[lo:hi]):
                    grams = [_grams(texts[k]) for k in range(lo, hi) if langs[k] == lang]
                    found = np.bincount(np.concatenate(grams), minlength=TABLE)
                    held[lang] = held[lang] + found if lang in held else found
                    if len(held) > LANGUAGE_BLOCK:
                        yield from (rows_of(x) for x in held)
                        held.clear()
        yield from (rows_of(x) for x in held)

    return Model(languages, cut_lineage(rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))))


def _likelihood(grams: np.ndarray, logs: np.ndarray) -> list[float]:
    """Log likelihood of a text's trigrams in each language of a block."""
    weight = TRUST * min(1.0, MOST_GRAMS / max(len(grams), 1))
    return (logs[:, grams].sum(axis=1) * weight).tolist() if len(grams) else [0.0] * len(logs)


def _read(pages: DataFrame, model: Model, html_col: str) -> Column:
    """Struct of the declared language, log likelihoods of the first block of languages, number of trigrams of a page's text, and
    the trigrams if there are more blocks."""
    shared = pages.sparkSession.sparkContext.broadcast(model.logs(0))  # bounded: block x table
    more = len(model.languages) > LANGUAGE_BLOCK

    @F.pandas_udf("struct<declared:string,likelihood:array<double>,n_grams:bigint,grams:array<int>>")
    def read(html_: pd.Series) -> pd.DataFrame:
        out = []
        for page in html_:
            found = blocks(page)
            body = [t for t, s in found if s == ARTICLE] or [t for t, _ in found]
            grams = _grams("\n".join(body).encode("utf-8", "surrogatepass"))
            out.append((_declared(page), _likelihood(grams, shared.value), len(grams), grams.astype(np.int32) if more else None))
        return pd.DataFrame(out, columns=["declared", "likelihood", "n_grams", "grams"])

    return read(quoted(html_col))


def _score_block(read: DataFrame, model: Model, lo: int) -> DataFrame:
    """The log likelihoods of one more block of languages, appended."""
    shared = read.sparkSession.sparkContext.broadcast(model.logs(lo))  # bounded: block x table

    @F.pandas_udf("array<double>")
    def score(grams: pd.Series) -> pd.Series:
        return grams.map(lambda g: _likelihood(g, shared.value))

    return cut_lineage(read.withColumn("likelihood", F.concat("likelihood", score("grams"))))


def _declared(page: str | None) -> str | None:
    """The language of the html element, or of a content-language header in the markup, without its region."""
    head = page or ""
    m = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", head, re.I) or re.search(
        r"""<meta\b[^>]*content-language[^>]*content\s*=\s*["']?([A-Za-z]{2,8})""", head, re.I
    )
    return m.group(1).lower() if m else None


def identify(
    pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id, url, lang, posterior, text_lang, declared, suffix, host, n_grams), one row per page.

    A page without text goes by its declaration and priors; without a url by the prior of all pages; a declaration outside
    the model's languages is no evidence. Null html is an empty page. Repeated rows are judged alike. A model without languages
    gives null. Extra columns are ignored; empty tables give empty results.
    """
    need(pages, id_col, url_col, html_col)
    host = F.lower(F.regexp_extract(quoted(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/]*@)?([^/?#:]+)", 1))
    suffix = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]+)$", 1)
    read = pages.select(
        quoted(id_col).alias("id"), quoted(url_col).alias("url"), F.coalesce(host, F.lit("")).alias("host"), suffix.alias("suffix"), _read(pages, model, html_col).alias("r")
    )
    langs = model.languages
    read = cut_lineage(read.select("id", "url", "host", "suffix", "r.declared", "r.likelihood", "r.n_grams", "r.grams"))
    if not langs:
        return read.select("id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host", "n_grams")
    for lo in range(LANGUAGE_BLOCK, len(langs), LANGUAGE_BLOCK):
        read = _score_block(read, model, lo)
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_position("likelihood", F.array_max("likelihood")).cast("int")
    read = read.drop("grams").withColumn("code", F.when(F.col("n_grams") > 0, best - 1)).withColumn("text_lang", F.element_at(names, F.col("code") + 1))
    known = F.col("declared").isin(langs)
    n_langs = len(langs)

    # reliability of declarations: how often each is made on pages whose text speaks for each language
    pairs = cut_lineage(read.filter(known).groupBy("declared", "code").agg(F.count(F.lit(1)).alias("n")))
    total = np.full(n_langs, DECLARED_WEIGHT * (1.0 if n_langs > 1 else 0.8))
    for r in pairs.filter("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")).collect():  # one row a language
        total[r["code"]] += r["n"]
    place = {lang: k for k, lang in enumerate(langs)}

    def reliability(rows):
        seen = np.full(n_langs, DECLARED_WEIGHT * 0.2 / max(n_langs - 1, 1))
        seen[place[rows["declared"].iloc[0]]] = DECLARED_WEIGHT * 0.8
        spoken = rows[rows["code"].notna()]
        seen[spoken["code"].to_numpy(np.int64)] += spoken["n"].to_numpy(np.int64)
        return pd.DataFrame({"said_of": rows["declared"].iloc[:1].to_list(), "said": [np.log(seen / total).tolist()]})

    said = cut_lineage(pairs.groupBy("declared").applyInPandas(reliability, "said_of string, said array<double>"))

    def counts(*keys: str) -> DataFrame:
        each = read.groupBy(*keys, "code").agg(F.count(F.lit(1)).cast("double").alias("n"))
        entries = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n")))
        return each.groupBy(*keys).agg(F.map_from_entries(entries).alias("m")).select(
            *keys, F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("c")
        )

    def smooth(c: str, wide: Column, weight: float) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(c, wide, lambda x, p: (x + F.lit(weight) * p) / (total + F.lit(weight)))

    row = np.zeros(n_langs)
    for r in read.filter("code IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a language
        row[r["code"]] = r["n"]
    whole = (row + 1.0) / (row.sum() + n_langs)
    everywhere = F.array(*[F.lit(float(x)) for x in whole])
    suffixes = counts("suffix").select("suffix", smooth("c", everywhere, SUFFIX_WEIGHT).alias("suffix_prior"))
    hosts = counts("host", "suffix").join(suffixes, "suffix").select("host", smooth("c", F.col("suffix_prior"), HOST_WEIGHT).alias("prior"))
    hosts = cut_lineage(hosts)
    (h,) = hidden(read, "h_host")
    joined = read.join(hosts.withColumnRenamed("host", h), F.col("host") == F.col(h), "left")
    prior = F.when(F.col("host") == "", everywhere).otherwise(F.coalesce("prior", everywhere))
    joined = joined.join(sized_broadcast(said), F.col("declared") == F.col("said_of"), "left")
    declared = F.coalesce("said", F.array_repeat(F.lit(0.0), n_langs))
    joined = joined.withColumn("logit", F.zip_with(F.zip_with("likelihood", F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b), declared, lambda a, b: a + b))
    joined = joined.withColumn("top", F.array_max("logit"))
    joined = joined.withColumn("mass", F.aggregate(F.transform("logit", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    return joined.select(
        "id", "url", F.element_at(names, F.array_position("logit", F.col("top")).cast("int")).alias("lang"), (F.lit(1.0) / F.col("mass")).alias("posterior"),
        "text_lang", "declared", "suffix", "host", "n_grams",
    )
