"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import decontamination, near, packing, quality, secret_scan
from orebed.llm.shared import Scratch, counted_broadcast, drop_scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at a half or more; null and empty texts go by the score of an empty text."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where(F.col("score") >= 0.5).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near duplicates (five words, 0.8), in one row.

    Where several texts share a doc_id, one of them keeps it and the others count as documents of their own, behind all
    that have an id to themselves; so do rows without a doc_id. Equal rows are one document. Nothing else goes."""
    scratch = Scratch(spark, "near-stage")
    text = F.xxhash64("text")
    rows = docs.select("doc_id", text.alias("of")).groupBy("doc_id", "of").count()
    rows = scratch.save(rows, "rows")  # a row of three numbers for each document
    shared_ids = rows.groupBy("doc_id").agg(F.min("of").alias("first"), F.count("*").alias("n")).where("n > 1 or doc_id is null")
    shared_ids = scratch.save(shared_ids.select(F.col("doc_id").alias("id"), "first"), "shared")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shared_ids.limit(1).count():
        own = keyed.join(counted_broadcast(shared_ids), F.col("doc_id").eqNullSafe(F.col("id")), "left")
        other = F.col("doc_id").isNull() | (F.col("first") != text)  # false for ids with one text: first is null there
        apart = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        keyed = own.select("row", F.when(F.coalesce(other, F.lit(False)), apart).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    found = near.near_duplicates(keyed, shingle_words=5, least=(80, 100), bands=30, rows=4)
    gone = scratch.save(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = keyed.join(counted_broadcast(gone), F.col("doc_id") == F.col("gone"), "left_anti")
    if rows.where("count > 1").limit(1).count():  # equal rows: of these alone the texts are dealt by their ids
        many = rows.where("count > 1").select(F.col("doc_id").alias("id"), F.col("of").alias("same"))
        many = counted_broadcast(scratch.save(many, "many"))
        again = F.col("row.doc_id").eqNullSafe(F.col("id")) & (text == F.col("same"))
        left = left.join(many, again, "left_anti").unionByName(left.join(many, again, "left_semi").dropDuplicates(["doc_id"]))
    return left.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew."""
    masked = secret_scan.redact(docs, secret_scan.train(spark, corpus=docs))
    if "n_chars" in masked.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096. Fewer words are kept than packing does alone: the workers of the
    stages before hold memory too."""
    return packing.pack_documents(docs, cache_words=150_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage learns its rules and the fourth its forest: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written to the shared folder and read again, and what a stage kept
    for itself is dropped then."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    held = Scratch.live[:]  # the last is its own
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage-{k}")
            drop_scratch(held)
            if k:
                scratch.drop(f"stage-{k - 1}")
    return docs
