"""Functions of the engine's surface that no query goes through: literal inputs, and what must come of them."""

import datetime
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from orebed.operators import documents, evaluation, fusion, ner, normalize, retrieval, store
from orebed.plans import engine
from orebed.sources import readers, sinks
from orebed.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test
BLOCK = "paper_id string, version int, block_ordinal int, block_type string, page int, section string, text string"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_lists_and_versions_of_fusion(spark):
    rows = [("P", 1, "NER", []), ("P", 1, "LLM", ["heat"]), ("P", 1, "RULE", None), ("Q", 1, "LLM", ["a"]), ("Q", 1, "NER", ["b"]), ("R", 1, "LLM", [])]
    got = fusion.first_lists(spark.createDataFrame(rows, "paper_id string, version int, source string, items array<string>")).collect()
    assert {(r["paper_id"], r["source"], tuple(r["items"])) for r in got} == {("P", "LLM", ("heat",)), ("Q", "NER", ("b",))}
    assert one(spark, fusion.hybrid_version(F.lit("rule@1"), F.lit("ner@1"))) == "hybrid@rule@1+ner@1"
    assert one(spark, fusion.hybrid_version(F.lit("r"), F.lit("n"), F.lit("l"))) == "hybrid@r+n+l"


def test_scalars_links_and_suffix(spark):
    rows = [(1, "agnps", "DI water", "llm@x"), (2, None, None, "llm@x"), (3, "mud", "ETHANOL ", "llm@x")]
    df = spark.createDataFrame(rows, "id int, material string, solvent string, extractor_version string")
    got = {r["id"]: (r["material"], r["material_id"], r["solvent"], r["extractor_version"]) for r in engine.normalized_predictions(df).collect()}
    assert got == {1: ("Silver nanoparticles", "AGNP", "Deionized water", "llm@x+normalized"), 2: (None, None, None, "llm@x+normalized"), 3: ("mud", None, "Ethanol", "llm@x+normalized")}

    def registry():
        def ask(name):
            if name == "bad":
                raise ConnectionError("away")
            return [7, 8] if name == "Silver nitrate" else []

        return ask

    names = spark.createDataFrame([("Silver nitrate",), ("Silver nitrate",), ("bad",), ("none",), (None,)], "canonical_name string")
    assert {tuple(r) for r in normalize.external_links(names, registry).collect()} == {("Silver nitrate", "PubChem", "7", None), ("bad", "PubChem", None, "away"), ("none", "PubChem", None, None)}


def test_granularity_parameters_and_latest(spark):
    kind = lambda a, b, page, section: one(spark, documents.evidence_granularity(*[F.lit(x).cast(t) for x, t in ((a, "int"), (b, "int"), (page, "int"), (section, "string"))]))
    assert [kind(0, 4, None, None), kind(None, 4, 2, None), kind(None, None, None, "S"), kind(None, None, None, None)] == ["char_span", "page_or_section", "page_or_section", "unlocalized"]
    config = spark.range(1).select(F.lit(5).alias("k"), F.lit(None).cast("string").alias("none"), F.lit(" Ask. ").alias("prompt"))
    params = config.select(documents.as_params(config)).first()[0]
    assert params["k"] == "5" and params["none"] is None and params["prompt_sha"] == one(spark, documents.prompt_fingerprint(F.lit("Ask."))) and "prompt" not in params
    rows = spark.createDataFrame([("P", "rule", 1, "a"), ("P", "rule", 2, "b"), ("P", "ner", 1, "c"), ("Q", "rule", 5, "d")], "paper_id string, extractor string, version int, payload string")
    assert sorted(r["payload"] for r in engine.read_results(rows, "P").collect()) == ["b", "c"]
    assert [r["payload"] for r in engine.read_results(rows, "P", 1).where("extractor = 'rule'").collect()] == ["a"]
    assert sorted(r["payload"] for r in store.latest(rows, ["paper_id"], "version").collect()) == ["b", "d"]


def test_strategies_and_what_they_need(spark):
    assert engine.strategies()["llm"] == {"needs_answers": True, "available": False} and engine.strategies(True)["hybrid"]["available"] and engine.strategies()["rule"]["available"]
    blocks = spark.createDataFrame([("P", 1, 0, "paragraph", 1, None, "heated at 80 C")], BLOCK)
    with pytest.raises(engine.Unavailable, match="llm"):
        engine.extract(blocks, "prompt_llm")
    assert engine.extract(blocks, "rule").count() == 1


def test_model_entities_and_embeddings(spark):
    def tagger():
        return lambda t: [{"text": "Ag", "start": t.index("Ag"), "end": t.index("Ag") + 2, "label": "CHEM", "score": 0.5}, {"text": "x", "start": 0, "end": 1, "label": "NOISE"}] if "Ag" in t else []

    df = spark.createDataFrame([("P", 1, 0, "paragraph", 1, None, "10 mM Ag"), ("P", 1, 1, "paragraph", 1, None, "none")], BLOCK)
    got = ner.mentions(df, model=lambda c: ner.model_entities(c, tagger, {"CHEM": "PRECURSOR"})).collect()
    assert [(r["text"], r["start"], r["label"], r["concentration"]["value"]) for r in got] == [("Ag", 6, "PRECURSOR", 10.0)]

    def encoder():
        return lambda texts: [[float(len(t)), 0.0] for t in texts]

    got = {r["text"]: r["embedding"] for r in retrieval.embed_with(spark.createDataFrame([("abc",), ("",), (None,)], "text string"), encoder).collect()}
    assert got == {"abc": [1.0, 0.0], "": [0.0, 0.0], None: None}


def test_sparse_search_is_the_cosine(spark):
    texts = {1: "silver nitrate in water", 2: "water and silver", 3: "gold", 4: "silver silver nitrate", 5: ""}
    e = retrieval.embed(spark.createDataFrame(list(texts.items()), "id int, text string"), ["id"])
    dense = {r["id"]: r["embedding"] for r in retrieval.dense(e, ["id"]).collect()}
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.sparse_top(e.where("id < 3"), e, k=3, digits=9).collect()}
    for q in (1, 2):
        want = sorted(((-round(sum(x * y for x, y in zip(dense[q], dense[i])), 9), i) for i in dense if any(x * y for x, y in zip(dense[q], dense[i]))))[:3]
        assert [(i, -s) for s, i in want] == [(i, pytest.approx(s)) for (_, i), s in sorted(((k, s) for k, s in got.items() if k[0] == q), key=lambda x: (-x[1], x[0][1]))]


def parts(spark, temperature, solvent, technique="TEM"):
    q = "struct<value:double,unit:string>"
    top = spark.createDataFrame([("P1", ("Ag",), solvent, (temperature, "C"), (2.0, "h"), None, "reduction"), ("P9", ("Ag",), None, None, None, None, None)], f"paper_id string, material struct<name:string>, solvent string, temperature {q}, reaction_time {q}, ph double, synthesis_method string")
    pre = spark.createDataFrame([("P1", 0, "AgNO3", (10.0, "mM"), None, None)], f"paper_id string, item_idx int, name string, concentration {q}, amount {q}, canonical_id string")
    return top, pre, spark.createDataFrame([("P1", technique)], "paper_id string, technique string")


def test_experiment_of_two_extractors(spark):
    gold = tuple(df.where("paper_id = 'P1'") for df in parts(spark, 80.0, "water"))
    good, bad = parts(spark, 80.0, "WATER"), parts(spark, 90.0, None, "SEM")
    with pytest.raises(ValueError, match="P9"):
        engine.evaluate(good, gold, strict=True)
    counts = {r["level"]: (r["tp"], r["fp"], r["fn"]) for r in engine.evaluate(good, gold).collect()}
    assert counts["field"] == (4, 1, 1) and counts["relation"] == (1, 0, 0) and counts["entity"] == (4, 0, 0)
    config = spark.range(1).select(F.lit("x").alias("name"), F.lit("p").alias("prompt"))
    run = {r["name"]: r["value"] for r in engine.tracked_experiment("r", config, {"A": good, "B": bad}, gold).collect()}
    assert run["paper_count"] == 2 and run["scored_paper_count"] == 1 and run["A.field.f1"] == pytest.approx(0.8) and run["B.field.precision"] == 0.75 and len(run) == 20
    reports = engine.run_experiment({"A": good}, gold)[1]
    line = sinks.report_lines(reports).first()
    assert (line["paper_id"], line["extractor"]) == ("P1", "A") and {x["level"] for x in json.loads(line["report"])} == {"entity", "relation", "field"}


def test_windowed_counts_leave_late_events_out(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), "view", 1.0), (at(1, 50), "view", 2.0)], [(at(9), "view", 4.0)], [(at(1, 10), "view", 100.0), (at(9, 30), "buy", 5.0)], [(at(15), "view", 0.0)]]
    s = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in/*")
        q = jobs.windowed_counts(s).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, "view"): (2, 3.0), (9, "view"): (1, 4.0), (9, "buy"): (1, 5.0)}


def test_sections_and_page_statistics(spark):
    rows = [("P", 1, k, "paragraph", 1 + k // 2, None, t) for k, t in enumerate(["Alpha  beta", "", "gamma " * 30, "tail", "ALPHA beta"])]
    blocks = spark.createDataFrame(rows, BLOCK)
    sections = spark.createDataFrame([("P", 2, "Late", "alpha Alpha beta gamma"), ("P", 1, "One", "x Alpha beta y"), ("P", 3, None, "tail"), ("P", 4, "Empty", " "), ("Q", 0, "Other", "ALPHA beta")], "paper_id string, section_ordinal int, heading string, text string")
    got = {r["block_ordinal"]: r["section"] for r in documents.assign_sections(blocks, sections).collect()}
    assert got == {0: "One", 1: None, 2: None, 3: None, 4: None}
    stats = readers.page_statistics(blocks).first()
    assert (stats["pages"], stats["needs_ocr"]) == (3, True)
    facts = spark.createDataFrame([(1, 1, 0, 4, 0.5), (0, 1, 0, 4, 0.5), (1, 0, 0, 4, 0.5), (1, 1, -1, 4, 0.5), (1, 1, 5, 4, 0.5), (1, 1, 0, 4, 1.5), (1, None, None, None, 1.0)], "version int, page int, char_start int, char_end int, confidence double")
    good, bad = documents.validate(facts)
    assert good.count() == 2 and sorted(r["reason"] for r in bad.collect()) == ["char_end", "char_start", "confidence", "page", "version"]
    assert evaluation.ablation(spark.createDataFrame([("P", "A", "field", 0, 0, 0)], "paper_id string, extractor string, level string, tp long, fp long, fn long")).first()["f1"] == 0.0
