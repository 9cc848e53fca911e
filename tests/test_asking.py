"""Prompts asked of a scripted model: in a batch, and as a stream whose waits are timers."""

import json
import sys
import time

from pyspark import cloudpickle

from orebed.operators import answers, store
from orebed.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


def test_scripted_retries():
    waits = []
    model = answers.Scripted(ConnectionError("away"), "no JSON", '{"a": 1}')
    assert answers.answer_with_retries(model, "Q", 2, 2.0, waits.append) == ('{"a": 1}', 3, None)
    assert waits == [2.0] and model.asked[:2] == ["Q", "Q"] and "not valid JSON" in model.asked[2]
    assert answers.answer_with_retries(answers.Scripted(answers.Permanent("forbidden")), "Q") == (None, 1, "forbidden")
    assert answers.answer_with_retries(answers.Scripted("no"), "Q", 1) == (None, 2, "not valid JSON")
    assert answers.holds_json("so:\n```json\n[1]\n```") and answers.holds_json('it is {"a": 2} here') and not answers.holds_json("{a}") and not answers.holds_json(None)


def model_in(folder):
    """A model that fails as a prompt says, and counts its calls in files, which all workers see."""

    def make():
        def call(prompt):
            job = prompt.split("\n")[0]
            path = f"{folder}/{job}"
            with open(path, "a+") as f:
                f.write(f"{time.time()}\n")
            with open(path) as f:
                n = len(f.readlines())
            kind, _, number = job.partition("-")
            if kind == "down" and n <= int(number):
                raise ConnectionError("away")
            if kind == "forbidden":
                raise answers.Permanent("forbidden")
            if kind == "talks" and n <= int(number):
                return "I cannot say."
            return json.dumps({"n": n, "told": "last reply" in prompt})

        return call

    return make


def test_asking_as_a_stream(spark, tmp_path):
    prompts = [(1, "good-0"), (2, "down-1"), (3, "down-2"), (4, "down-9"), (5, "talks-1"), (6, "talks-9"), (7, "forbidden-0"), (8, "  "), (9, None), (2, "down-1")]
    df = spark.createDataFrame(prompts, "job_id long, prompt string")
    for part in ("a", "b"):  # every job comes twice
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    (tmp_path / "calls").mkdir()
    key, value = jobs.TIMER_STORE
    spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = jobs.ask(stream, model_in(str(tmp_path / "calls")), max_retries=2, delay=0.5)
        keep = lambda b, k: b.write.mode("overwrite").parquet(f"{tmp_path}/log/{k}")
        run = q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
        rows, deadline = [], time.time() + 120
        while time.time() < deadline and len({r["job_id"] for r in rows if r["state"] in ("SUCCESS", "DEAD_LETTER")}) < 9:
            time.sleep(1)
            assert run.exception() is None
            done = [f"{tmp_path}/log/{k}" for k in range(run.lastProgress["batchId"] if run.lastProgress else 0)]
            rows = spark.read.parquet(*done).collect() if done else []
        run.stop()
    finally:
        spark.conf.unset(key)
    last = {}
    for r in sorted(rows, key=lambda r: (r["job_id"], r["event_seq"])):
        last[r["job_id"]] = (r["state"], r["attempt"], r["error"])
    assert last == {
        1: ("SUCCESS", 1, None),
        2: ("SUCCESS", 2, None),
        3: ("SUCCESS", 3, None),
        4: ("DEAD_LETTER", 3, "away"),
        5: ("SUCCESS", 2, None),
        6: ("DEAD_LETTER", 3, "not valid JSON"),
        7: ("DEAD_LETTER", 1, "forbidden"),
        8: ("DEAD_LETTER", 0, "empty document"),
        9: ("DEAD_LETTER", 0, "empty document"),
    }
    text = {r["job_id"]: json.loads(r["raw_text"]) for r in rows if r["raw_text"]}
    assert text == {1: {"n": 1, "told": False}, 2: {"n": 2, "told": False}, 3: {"n": 3, "told": False}, 5: {"n": 2, "told": True}}
    at = [float(x) for x in (tmp_path / "calls" / "down-9").read_text().split()]
    assert len(at) == 3 and at[1] - at[0] >= 0.5 and at[2] - at[1] >= 1.0  # after delay times the attempt; nobody asks again
    folded = store.job_states(spark.createDataFrame([(r["job_id"], r["event"], r["event_seq"]) for r in rows if r["job_id"] < 7], "job_id long, event string, event_seq long"), 3)
    assert {r["job_id"]: r["state"] for r in folded.collect()} == {j: s for j, (s, _, _) in last.items() if j < 7}
