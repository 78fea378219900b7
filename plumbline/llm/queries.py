"""The registered queries of this package; each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, jaccard_join, language_fusion, maxent, merkle, merkle_sql, mixing, page_diff, private_spans, secrets, slots, templates, wavelet, weak_quality
from plumbline.llm.common import lower_ascii, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query("op3_pareto_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"),
    )


@_query("op8_virtual_slots")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, new_map = slots.shard(docs, 24)
    narrow = rows.select(
        "doc_id", F.col("shard_size").alias("size"), F.crc32(F.encode(whole_text("text"), "UTF-8")).cast("bigint").alias("text_crc32"),
        F.col("shard_no").alias("shard"), F.col("shard_slot").alias("virtual_slot"),
    )
    placed = slots.positions(narrow, "shard", "virtual_slot", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(new_map.version).alias("map_version"),
    )


@_query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


@_query("op4_weak_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    measured = [f"quality_measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *measured, F.col("quality_base_failed").alias("base_failed"), F.col("quality_kept").alias("kept"), F.col("quality_posterior").alias("posterior"))


@_query("op2_ownership_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *secrets.digest(found, "secret_", secrets.BASE), F.size("secret_owned").cast("bigint").alias("n_owner_specific"))


@_query("op6_boosted_private_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.digest(found, "private_", private_spans.BASE))


@_query("op10_maxent_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = maxent.score(docs, maxent.fit(docs))
    return scored.select(
        F.col("id").alias("doc_id"), (~maxent.in_training(F.col("id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query("op1_page_differencing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_diff.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@_query("op7_template_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = templates.contaminated(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched", "coverage", "changed")


@_query("op5_language_fusion")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_fusion.fit(_table(spark, sf_dir, "documents").select("text", "lang"))
    return language_fusion.identify(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), model).withColumnRenamed("id", "page_id")


@_query("op11_wavelet_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@_query("op12_strassen_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


SQL["op12_strassen_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""


@_query("op13_incremental_witnesses")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(*fields)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = merkle.build(docs, fields, changed={"text": lower_ascii(F.col("text"))}, where=tampered).proofs()
    return proofs.withColumnRenamed("id", "doc_id")


SQL["op13_incremental_witnesses"] = merkle_sql.PROOFS
