"""Versions by content, results stored once, job states, and uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256

MAX_RETRIES = 3


def content_versions(arrivals: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """arrivals with content_hash and version: content like the latest version of its key is no new version."""
    w = Window.partitionBy(key).orderBy(*order)
    hashed = arrivals.withColumn("content_hash", sha256(F.col(content))).withColumn("__last", F.lag("content_hash").over(w))
    new = (F.col("__last").isNull() | (F.col("__last") != F.col("content_hash"))).cast("long")
    return hashed.withColumn("is_new", new == 1).withColumn("version", F.sum(new).over(w)).drop("__last")


def insert_absent(stored: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Results whose key isn't stored yet, one for each key, to be appended."""
    return results.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def job_states(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Folds a log (job_id, event, event_seq; RUNNING, SUCCESS, FAIL, QUEUED) into job_id, state, retries. A failure adds
    a retry: QUEUED again below max_retries, DEAD_LETTER from there on. The last event decides, counts need no order."""
    agg = events.groupBy("job_id").agg(F.max_by("event", "event_seq").alias("last"), F.sum((F.col("event") == "FAIL").cast("int")).alias("retries"))
    failed = F.when(F.col("retries") >= max_retries, "DEAD_LETTER").otherwise("QUEUED")
    return agg.select("job_id", F.when(F.col("last") == "FAIL", failed).otherwise(F.col("last")).alias("state"), "retries")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def exact_duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """content_hash, n and first_id of texts that several rows have; counted before the shuffle, so no text moves."""
    hashed = rows.select(F.col(key).alias("id"), sha256(F.col(text)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
