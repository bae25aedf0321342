"""Queries of the text operators over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, html_extract, language_id, nearest, periodic_runs, pii, quality_rules, sharding, simhash, substring_dedup, url_filter, whitening
from .common import table
from .oracles import ORACLES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def hex64(c: F.Column) -> F.Column:
    """A signed long's 64 bits as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), dirty.alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), 24)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    d = url_filter.judged(pages, url_filter.outcomes_by_path(pages, table(spark, sf_dir, "labels")), RULES)
    return d.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = language_id.learnt(d.where(~held))
    return language_id.identified(d.select("doc_id", held.alias("held_out"), "text"), profiles)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    d = whitening.whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return d.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_k")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


def planted(df: DataFrame) -> DataFrame:
    """doc_id and text; by the hash of its id, a tenth of the texts repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("int")
    w = F.when(h % 10 == 0, F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    d = df.select("doc_id", "text", g.alias("g"), w.alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_bpe, op4_simhash, op5_substring_dedup, op6_quality_rules, op7_pii, op8_html_extract, op9_url_filter, op10_language_id, op11_whitening, op12_periodic_runs, op13_nearest)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
