"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; ``run`` writes each
result as Parquet in the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.op1_best_fit_packing import best_fit_packing
from tidemark.llm.op2_minhash_dedup import near_duplicates
from tidemark.llm.op4_decontamination import decontaminate
from tidemark.llm.op6_pii import sanitize
from tidemark.llm.op9_quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample of good text go."""
    return keep_good(docs, C.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; repeated rows of it are one, different texts of one id are different documents."""
    rows = C.numbered(C.keyed(docs), "pipeline-near")
    gone = near_duplicates(rows.select("id", "text"), id_col="id").filter("NOT kept").select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("id"))
    i, th = C.fresh("id", "th")
    gone = rows.select("id", F.col("doc").alias(i), F.xxhash64("text").alias(th)).join(gone, "id", "left_semi")
    gone = C.stored(gone.select(i, th).distinct(), "pipeline-gone")
    kept = docs.join(gone, C.same_text(docs, "doc_id", "text", i, th), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if docs.count() != docs.select("doc_id").distinct().count() else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a twentieth or more of benchmark text go."""
    return decontaminate(docs, C.table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are generalised; ``n_chars`` follows the text."""
    clean = sanitize(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(clean.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document as pieces with their places in sequences of 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
