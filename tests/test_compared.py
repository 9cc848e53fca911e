"""What answers are compared by: made in many tasks, parsed once, and only where gold is."""

import math

import pytest
from pyspark.sql import functions as F

from orebed.functions.tables import CANONICAL
from orebed.operators import answers, evaluation
from orebed.plans import engine, queries, views

TEXTS = [(0, "one"), (2, "one"), (2, "two\nlines"), (5, "a\n"), (8, ""), (9, ""), (11, "é\r\nµ\n\n"), (14, None), (-1, "x\ny"), (-4, "x"), (17, "x\ny"), (50, "a\nb")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("compared"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (0, 5, 17, 50, 99)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_firsts_of_odd_texts(spark, sf_dir):
    """As with a row for each line."""
    want = {}
    for k, text in TEXTS:
        for i, _ in enumerate([] if text is None else text.split("\n")):
            if math.fmod(k + i, 3) != 2:
                want[k] = min(want.get(k, i), i)
    assert {r["doc_id"]: r["ord"] for r in views.view(spark, sf_dir, "firsts").collect()} == want and 8 not in want and want[2] == 1


def test_answers_are_made_in_many_tasks(spark, sf_dir):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.view(spark, sf_dir, "answers").rdd.getNumPartitions() == n


def test_answers_are_parsed_once_and_only_with_gold(spark, sf_dir, monkeypatch):
    plans, write = {}, queries.written

    def kept(df, name="step"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(queries, "written", kept)
    (p, pp, pt), (g, _, _) = queries.both(spark, sf_dir)
    assert plans["predicted"].count("ArrowEvalPython") == 1 and "LeftSemi" in plans["predicted"] and "$.steps" not in plans["predicted"]
    assert {r[0] for r in p.select("paper_id").collect()} == {5, 17} and {r[0] for r in g.select("paper_id").collect()} == {0, 5, 17, 50}
    assert pp.count() == 4 and pt.count() == 2
    assert {r[0] for r in queries.both(spark, sf_dir, lone=True)[0][0].select("paper_id").collect()} == {2, 5, 9, 11, 17, -1, -4}


def test_wanted_parts_alone(spark):
    df = spark.createDataFrame([("1", '{"material": "Au", "reagents": ["a", {"name": "b", "amount": "2 mg"}], "time": "2 h", "pH": "7", "steps": ["x"], "techniques": ["TEM"], "properties": [{"name": "n", "value": 2, "unit": "g"}]}'), ("2", "none")], "paper_id string, raw_text string")
    parsed = answers.parse(df).withColumn("version", F.lit(1))
    whole = answers.predictions(parsed).drop("parsed")
    for only in (queries.COMPARED, ["steps", "ph"]):
        some = answers.predictions(parsed, only=only).drop("parsed")
        assert set(only) == set(some.columns) - {"paper_id", "raw_text", "version", "error"}
        assert some.orderBy("paper_id").collect() == whole.select(some.columns).orderBy("paper_id").collect()


def test_statuses_of_papers_on_both_sides(spark):
    kind = "paper_id int, material struct<name:string>, solvent string, temperature struct<value:double,unit:string>, reaction_time struct<value:double,unit:string>, ph double, synthesis_method string"
    pred = spark.createDataFrame([(1, ("Au",), "Water", (80.0, "C"), (2.0, "h"), None, None), (1, None, None, None, None, 7.0, "m"), (2, ("Au",), "x", None, None, None, None)], kind)
    gold = spark.createDataFrame([(1, ("au",), "water", (353.15, "K"), (2.0, "parsec"), None, None), (3, ("Au",), "x", None, None, None, None)], kind)
    got = sorted(tuple(r) for r in evaluation.scalar_status(pred, gold).collect())
    first = [("material.name", "incorrect"), ("reaction_time", "incorrect"), ("solvent", "incorrect"), ("synthesis_method", "both_absent"), ("temperature", "correct")]
    second = [("material.name", "missing"), ("pH", "spurious"), ("reaction_time", "missing"), ("solvent", "missing"), ("synthesis_method", "spurious"), ("temperature", "missing")]
    assert got == sorted((1, *x) for x in first + second)
    named = sorted((r["in_pred"], r["in_gold"], r["equal"]) for r in evaluation.named_scalars(pred.where("material is not null"), gold).collect())
    assert named == [(True, True, True)] * 2
    parts = lambda df: (df, spark.createDataFrame([], "paper_id int, item_idx int, name string, canonical_id string, concentration struct<value:double,unit:string>, amount struct<value:double,unit:string>"), spark.createDataFrame([], "paper_id int, technique string"))
    assert {(r["paper_id"], r["level"]) for r in engine.evaluate(parts(pred), parts(gold)).collect()} == {(1, "entity"), (1, "field")}


def test_every_unit_in_its_canonical_one(spark):
    df = spark.createDataFrame([(u, d, f) for u, d, f in CANONICAL] + [("parsec", None, None), (None, None, None)], "u string, d string, f double")
    rows = df.select("d", "f", evaluation.dimension(F.col("u")).alias("dim"), evaluation.to_canonical(F.lit(3.7), F.col("u")).alias("v")).collect()
    assert all(r["dim"] == r["d"] and r["v"] == (None if r["f"] is None else 3.7 * r["f"]) for r in rows) and len(rows) == len(CANONICAL) + 2


def test_texts_do_not_meet_labels(spark, sf_dir):
    """Of a document, two numbers are joined with labels; its text stays where it is read."""
    plan = views.view(spark, sf_dir, "gold")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("RepartitionByExpression") and "octet_length" in plan
