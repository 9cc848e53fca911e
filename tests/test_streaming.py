"""Streams equal batches."""

from pyspark.sql import functions as F

from orebed.operators import store
from orebed.streaming import jobs


def test_job_states(spark, tmp_path):
    rows = [(i % 7, ["RUNNING", "FAIL", "SUCCESS", "FAIL", "QUEUED"][(i * 3) % 5], i) for i in range(120)]
    df = spark.createDataFrame(rows, "job_id long, event string, event_seq long")
    for k in range(3):
        df.where(F.col("event_seq") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = []
    q = jobs.job_states(s).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.append({r["job_id"]: (r["state"], r["retries"]) for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for b in seen:
        last |= b
    assert last == {r["job_id"]: (r["state"], r["retries"]) for r in store.job_states(df).collect()}


def test_versions_across_batches(spark, tmp_path):
    batches = [[("a", "A", 1), ("b", "X", 1)], [("a", "A", 2), ("b", "Y", 2)], [("a", "B", 3), ("a", "A", 4), ("b", "Y", 3)]]
    for k, b in enumerate(batches):
        df = spark.createDataFrame(b, "paper_id string, content string, arrived int")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        jobs.ingest_versions(s, f"{tmp_path}/table", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r["paper_id"], r["version"], r["content"]) for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert got == {("a", 1, "A"), ("a", 2, "B"), ("a", 3, "A"), ("b", 1, "X"), ("b", 2, "Y")}
