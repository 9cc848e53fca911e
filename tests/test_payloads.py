"""Schemas of payloads, gold results, and payloads of any depth as leaves and back."""

import json

import pytest
from pyspark.sql import functions as F

from orebed.operators import annotation, schema

GOOD = {
    "material": {"name": "Ag", "composition": None, "size": {"value": 12, "unit": "nm"}, "morphology": "rods"},
    "precursors": [{"name": "AgNO3", "amount": {"value": "5", "unit": "mg"}, "concentration": None}, {"name": "PVP", "canonical_id": "pvp"}],
    "solvent": "water",
    "temperature": {"value": 80.5, "unit": "C"},
    "reaction_time": None,
    "pH": 7,
    "steps": [{"order": 1, "description": "mix"}, {"order": 2.0, "description": "heat"}],
    "characterization": [{"technique": "TEM", "finding": "12 nm"}],
    "properties": [{"name": "gap", "value": {"value": 2, "unit": "eV"}}],
    "something else": [[{"deep": 1}]],
}


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


CASES = [
    (GOOD, []),
    ({}, []),
    (changed(["temperature", "unit"], KeyError), [("temperature.unit", "missing")]),
    (changed(["temperature", "unit"], None), [("temperature.unit", "null")]),
    (changed(["temperature", "value"], "warm"), [("temperature.value", "not a number")]),
    (changed(["temperature"], "80 C"), [("temperature", "not an object")]),
    (changed(["material"], ["Ag"]), [("material", "not an object")]),
    (changed(["material", "size", "value"], {}), [("material.size.value", "not a number")]),
    (changed(["material", "morphology"], 4), [("material.morphology", "not a text")]),
    (changed(["precursors"], None), [("precursors", "null")]),
    (changed(["precursors"], {"name": "x"}), [("precursors", "not a list")]),
    (changed(["precursors", 0], None), [("precursors[0]", "null")]),
    (changed(["precursors", 0, "amount"], {"value": 1}), [("precursors[0].amount.unit", "missing")]),
    (changed(["precursors", 1, "name"], KeyError), [("precursors[1].name", "missing")]),
    (changed(["steps", 0, "order"], 0), [("steps[0].order", "below 1")]),
    (changed(["steps", 1, "order"], 1.5), [("steps[1].order", "not a whole number")]),
    (changed(["steps", 1, "description"], None), [("steps[1].description", "null")]),
    (changed(["characterization", 0, "technique"], True), [("characterization[0].technique", "not a text")]),
    (changed(["properties", 0, "value", "unit"], 3), [("properties[0].value.unit", "not a text")]),
    (changed(["pH"], True), []),
]


def test_violations(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(100, None), (101, "not JSON"), (102, "null"), (103, "[]"), (104, '"x"')]
    df = spark.createDataFrame(rows, "id int, payload string").withColumn("path", F.lit("x"))
    got = schema.violations(df.drop("path"), ["id"]).collect()
    want = [(i, *f) for i, (_, faults) in enumerate(CASES) for f in faults] + [(i, "", "not an object") for i in range(100, 105)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert schema.violations(df.where("false"), ["id"]).count() == 0
    record = schema.violations(spark.createDataFrame([(1, '{"paper_id": "P"}'), (2, "{}")], "id int, payload string"), ["id"], schema=schema.RECORD)
    assert [tuple(r) for r in record.collect()] == [(2, "paper_id", "missing")]


def leaves(spark, payloads):
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in payloads.items()], "paper_id string, payload string")
    return annotation.flatten(df, ["paper_id"])


def test_gold_results(spark):
    """Agreed, settled and failing payloads; an open path is an error."""
    b = changed(["temperature", "value"], 81)
    first = leaves(spark, {"P1": GOOD, "P2": GOOD, "P3": changed(["steps", 0, "order"], 0)})
    pairs = annotation.compare(first, leaves(spark, {"P1": GOOD, "P2": b, "P3": changed(["steps", 0, "order"], 0)}), ["paper_id"])
    none = spark.createDataFrame([], "paper_id string, path string, value string")
    with pytest.raises(ValueError, match="P2/temperature.value"):
        annotation.gold_results(pairs, none, ["paper_id"], "third")
    settled = spark.createDataFrame([("P2", "temperature.value", "81")], none.schema)
    results, facts, failed = annotation.gold_results(pairs, settled, ["paper_id"], "third")
    got = {r["paper_id"]: r for r in results.collect()}
    assert set(got) == {"P1", "P2"} and {(r["extractor"], r["extractor_version"]) for r in got.values()} == {("HUMAN", "gold@third")}
    assert json.loads(got["P1"]["payload"]) == GOOD and json.loads(got["P2"]["payload"]) == b
    assert [(r["paper_id"], [tuple(e) for e in r["errors"]]) for r in failed.collect()] == [("P3", [("steps[0].order", "below 1")])]
    of = {(r["paper_id"], r["field"]): r for r in facts.collect()}
    assert of["P2", "temperature.value"]["value"] == "81" and of["P1", "temperature.value"]["value"] == "80.5"
    assert ("P1", "reaction_time") not in of and not any(p == "P3" for p, _ in of)
    assert {(r["source"], r["confidence"], r["evidence_text"]) for r in of.values()} == {("HUMAN", 1.0, "human annotation (adjudicated)")}


def nested(depth):
    """A payload with lists and objects in turn, and a leaf on every level."""
    out = "end"
    for k in range(depth):
        out = {"n": k, "k": out} if k % 2 else [k, out, {}]
    return {"top": out}


def without_empty(x):
    if isinstance(x, dict):
        return {k: v for k, v in ((k, without_empty(v)) for k, v in x.items()) if v not in ({}, [])}
    return [v for v in map(without_empty, x) if v not in ({}, [])] if isinstance(x, list) else x


@pytest.mark.parametrize("depth", [0, 1, 5, 6, 12, 25])
def test_any_depth(spark, depth):
    payload = {**nested(depth), 'odd "key"\\': ["[", "}", '\\"{', None, 1.5], "paper_id": "gone"}
    df = spark.createDataFrame([("P", json.dumps(payload)), ("Q", '{"a": 1}'), ("R", "{}"), ("S", None)], "id string, payload string")
    flat = annotation.flatten(df, ["id"])
    assert [tuple(r) for r in flat.where("id <> 'P'").collect()] == [("Q", "a", "1", True)]
    back = {r["id"]: json.loads(r["payload"]) for r in annotation.unflatten(flat, ["id"]).collect()}
    del payload["paper_id"]
    assert back == {"P": without_empty(payload), "Q": {"a": 1}}


def test_gaps_in_lists(spark):
    df = spark.createDataFrame([(1, "a[2].b", "3"), (1, "a[0]", '"x"'), (1, "c", None), (2, "z[0][1]", "true")], "id int, path string, value string")
    got = {r["id"]: json.loads(r["payload"]) for r in annotation.unflatten(df, ["id"]).collect()}
    assert got == {1: {"a": ["x", None, {"b": 3}], "c": None}, 2: {"z": [[None, True]]}}
    assert annotation.unflatten(df.where("false"), ["id"]).count() == 0
