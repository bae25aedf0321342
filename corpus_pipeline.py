"""A corpus run: quality rules, near-dedup by SimHash anchors and shingle similarity, benchmark decontamination, PII redaction, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvefx.llm import bpe, decontamination, near_copies, pii, quality_rules
from curvefx.llm.common import STORED, removed, stored, table
from curvefx.llm.queries import RANKS

#: All stages: texts are read whole at any length; null ids and nulls in other columns stay as they are; rows that share an id
#: are told apart by their texts; an empty table gives an empty one.
#: No SQL: fingerprints, the PII model and BPE are not expressible; tests compare run() with brute force.
ORACLE_SQL = None


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and hash of doc_id and text are in rows; null ids match null ids."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col("doc_id").alias("_id"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("_hash"))
    chosen = rows.select(F.col("doc_id").alias("_own"), F.col("_row")).distinct()
    return d.join(chosen, (d["_hash"] == chosen["_row"]) & d["_id"].eqNullSafe(chosen["_own"]), "left_semi").select("_all.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep; null and empty texts fail the base rule, repeated rows fare alike."""
    return keep_rows(docs, quality_rules.judged(docs, table(spark, sf_dir, "labels")).where("kept").select("doc_id", "_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8), that with the smallest id, nulls last, then hash. Texts without words are one group, repeated rows become one."""
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")
    firsts = near_copies.near_copies(docs).groupBy("component").agg(F.min(order).alias("_first"))
    return keep_rows(docs, firsts.select("_first.doc_id", "_first._row")).dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows; texts without words have no hits and stay, repeated rows too."""
    d = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, d.where((F.col("n_hit") == 0) | (F.col("n_hit") * 20 < F.col("n_words"))).select("doc_id", "_row"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind; n_chars counts the new text. Null texts stay null."""
    out = pii.found(docs, replace=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the number and digests of each document's tokens, with its redacted text's characters; a null text counts as empty. Repeated rows repeat."""
    return bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("pii", redact), ("byte-level bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stored before the next; what a stage stored for itself goes once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(STORED)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            removed(spark, STORED[max(0, before - (k > 0)) : -1])  # with the previous stage's result
    return docs
