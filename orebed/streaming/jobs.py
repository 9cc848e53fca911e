"""Streams: job states folded from a log, versions ingested once, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from ..operators.answers import Permanent, holds_json, with_reason
from ..operators.store import MAX_RETRIES, content_versions, insert_absent

STATE = "last string, retries int, seq long"


def job_states(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The streaming form of the fold: job_id, state, retries after each batch. events: job_id long, event string,
    event_seq long, in any order within a batch; an event older than the state changes the count of failures only."""

    def fold(key, frames, state) -> Iterator:
        import pandas as pd

        last, retries, seq = state.get if state.exists else (None, 0, -1)
        for f in frames:
            retries += int((f["event"] == "FAIL").sum())
            top = f.loc[f["event_seq"].idxmax()]
            if top["event_seq"] > seq:
                last, seq = top["event"], int(top["event_seq"])
        state.update((last, retries, seq))
        said = last if last != "FAIL" else "DEAD_LETTER" if retries >= max_retries else "QUEUED"
        yield pd.DataFrame({"job_id": [key[0]], "state": [said], "retries": [retries]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, state string, retries int", STATE, "update", "NoTimeout")


ASKED = "job_id long, event string, event_seq long, state string, attempt int, raw_text string, error string"
#: The state store that timers need (a setting of the session, read when a query starts).
TIMER_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


JOB = StructType().add("prompt", StringType()).add("asked", StringType()).add("attempt", IntegerType()).add("done", BooleanType())


class _Asking(StatefulProcessor):
    """One job: its prompt is kept until an answer comes or attempts are used up; waiting is a timer."""

    def __init__(self, client: Callable[[], Callable[[str], str]], max_retries: int, delay: float):
        self.client, self.max_retries, self.delay = client, max_retries, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.call = handle, None
        self.job = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        prompts = [r.prompt for r in rows]
        if self.job.exists():  # asked before: the same job comes again after a restart of its source
            return
        if not (prompts[0] or "").strip():
            self.job.update(("", "", 0, True))
            yield Row(job_id=key[0], event="FAIL", event_seq=0, state="DEAD_LETTER", attempt=0, raw_text=None, error="empty document")
            return
        self.job.update((prompts[0], prompts[0], 0, False))
        yield from self.tried(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if self.job.exists() and not self.job.get()[3]:
            yield from self.tried(key[0], timerValues)

    def tried(self, job_id: int, timer_values) -> Iterator[Row]:
        """Attempts until one must wait or none is left. A reply that isn't JSON is asked for again at once."""
        prompt, asked, attempt, _ = self.job.get()
        row = lambda event, state, text, error: Row(job_id=job_id, event=event, event_seq=2 * attempt + (event != "RUNNING"), state=state, attempt=attempt, raw_text=text, error=error)
        while attempt <= self.max_retries:
            attempt += 1
            yield row("RUNNING", "RUNNING", None, None)
            last, wait = attempt > self.max_retries, False
            try:
                self.call = self.call or self.client()
                text = self.call(asked)
                if holds_json(text):
                    self.job.update(("", "", attempt, True))
                    yield row("SUCCESS", "SUCCESS", text, None)
                    return
                error = "not valid JSON"
                asked = with_reason(prompt, error)
            except Permanent as e:
                error, last = str(e), True
            except Exception as e:
                error, wait = str(e), True
            yield row("FAIL", "DEAD_LETTER" if last else "QUEUED", None, error)
            if last:
                break
            self.job.update((prompt, asked, attempt, False))
            if wait:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + round(1000 * self.delay * attempt))
                return
        self.job.update(("", "", attempt, True))

    def close(self) -> None:
        pass


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], max_retries: int = 2, delay: float = 2.0) -> DataFrame:
    """A stream of prompts (job_id long, prompt) asked of a model, as a log (ASKED) of every attempt and what came of it:
    RUNNING, then SUCCESS with the answer or FAIL with the reason; state is QUEUED while attempts are left, DEAD_LETTER then.

    No task sleeps: a failed call is state with a timer, due after delay times the attempt, and other jobs go on. A reply that
    isn't JSON is asked for again at once with the reason added; a Permanent error and an empty prompt end their job. At
    most max_retries + 1 attempts. A job that comes again isn't asked again. Attempts of a batch that fails are made again, as
    a stream's batches are: an answer is stored once, though the model may be asked twice.

    store.job_states(max_retries + 1) folds the log to the same states (a Permanent error ends earlier). Set TIMER_STORE in
    the session before the query starts."""
    keyed = prompts.select(F.col("job_id").cast("long").alias("job_id"), F.col("prompt").cast("string").alias("prompt")).where("job_id is not null")
    return keyed.groupBy("job_id").transformWithState(_Asking(client, max_retries, delay), ASKED, "Update", "ProcessingTime")


def ingest_versions(stream: DataFrame, table: str, checkpoint: str, key: str = "paper_id", content: str = "content", order: str = "arrived"):
    """Appends content versions of a document stream to a parquet table: batches number on from what is stored, content
    like the latest version adds nothing, and a batch that comes again is recognised by its content hashes."""

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(table)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old is None:
            fresh = content_versions(batch, key, content, [order]).where("is_new").drop("is_new")
        else:
            last = old.groupBy(key).agg(F.max_by("content_hash", "version").alias("__hash"), F.max("version").alias("__v"))
            seen = batch.join(last, key, "left")
            new = content_versions(seen, key, content, [order]).where("is_new and not (version = 1 and content_hash <=> __hash)")
            shift = F.when(F.col("__hash").isNull(), 0).otherwise(F.col("__v") - F.when(F.col("__first_same"), 1).otherwise(0))
            first = content_versions(seen, key, content, [order]).where("version = 1").groupBy(key).agg(F.max(F.col("content_hash").eqNullSafe(F.col("__hash"))).alias("__first_same"))
            fresh = new.join(first, key).withColumn("version", F.col("version") + shift).drop("is_new", "__hash", "__v", "__first_same")
            fresh = insert_absent(old, fresh, [key, "version"])
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type; events later than `late` behind the newest are left out. Beyond parity."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
