"""Facts of recipes alone, whatever a document's own text says before; what isn't wanted isn't computed."""

import pytest
from pyspark.sql import functions as F

from orebed.operators import answers, ner, rules
from orebed.plans import engine, queries, views


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("stated"))
    rows = [(3, "key 40a7f of\nsecond"), (4, "in a token 21cf920c of 5g"), (5, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_first_of_the_recipe_wins(spark, sf_dir):
    said = {r["doc_id"]: (r["temp"], "C", r["hours"], "h") for r in views.view(spark, sf_dir, "said").collect()}
    got = {r[0]: tuple(r[1:]) for r in queries.rule_first_wins_prediction(spark, sf_dir).collect()}
    assert got == said and set(said) == {3, 4}
    fused = {(r["paper_id"], r["field"]): (r["value_num"], r["value_unit"]) for r in queries.fuse_scalars(spark, sf_dir).collect()}
    assert all(fused[k, "temperature"] == v[:2] and fused[k, "reaction_time"] == v[2:] for k, v in said.items())


def test_a_word_that_begins_as_a_unit(spark):
    """As in the reference, words end where letters of any language do."""
    df = spark.createDataFrame([("1", 1, 0, None, None, "4448007678649085 für der, 5 F")], "paper_id string, version int, block_ordinal int, page int, section string, text string")
    assert [r["value_num"] for r in rules.facts(df, only=["temperature"]).collect()] == [5.0]


def test_rule_queries_read_words_as_their_sql(spark, tmp_path):
    """Words that begin as a unit and go on with another letter than ASCII's, white space and digits of other kinds, of every rule."""
    duckdb = pytest.importorskip("duckdb")
    text = "4448007678649085 für der\n5 hôtel 7 s\u00e9 8 süß\n3 gé, 4 lé, 5 mlé, 6 Mé 9 mM\u00e9\n5\u00a0F 6\u2003h 7\u000bmL 8\u000cmg\n\u0663 C \uff18 g 1\u0663 K\n-80.5 °C, 4_F 5 F_ 6 K9 7 kelvin. 8 µM 9 µl 10 µg 11 wt% 5 mg/mL\n5 F"
    d = str(tmp_path)
    spark.createDataFrame([(1, text), (2, text.replace("\n", " \n")), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    for name in ("temperature", "time", "concentration", "volume"):
        got = sorted(map(tuple, queries.QUERIES[f"rule_{name}"](spark, d).collect()))
        assert got == sorted(c.execute(queries.SQL[f"rule_{name}"]).fetchall()) and got, name
    # line 5 has a mass before a slash, which is none; the SQL has no such rule
    got = sorted(tuple(r) for r in queries.QUERIES["rule_mass"](spark, d).where("block_ordinal <> 5").collect())
    assert got == sorted(r for r in c.execute(queries.SQL["rule_mass"]).fetchall() if r[1] != 5) and got


def test_wanted_facts_alone(spark):
    df = spark.createDataFrame([("1", 1, 0, None, None, "AgNO3 (2 mM) in water at 60 C for 2 h, TEM.")], "paper_id string, version int, block_ordinal int, page int, section string, text string")
    every = engine.hybrid_facts(df)
    for keys in (["temperature", "solvent"], ["precursors.name", "precursors.concentration"], ["characterization.technique"]):
        key = lambda r: repr(r)
        assert sorted(engine.hybrid_facts(df, keys=keys).collect(), key=key) == sorted(every.where(F.col("field_key").isin(keys)).collect(), key=key)
    plan = engine.hybrid_facts(df, keys=["characterization.technique"])._jdf.queryExecution().optimizedPlan().toString()
    assert "mg/mL" not in plan and "Celsius" not in plan
    assert ner.mentions(df, labels=["SOLVENT"]).count() == 1


def test_answers_are_made_once(spark, sf_dir):
    plan = answers.parse(views.view(spark, sf_dir, "answers"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_answers_are_dealt_to_tasks(spark, sf_dir):
    """A few small rows lead to them, which adaptive execution puts into one task."""
    made = queries.recorded(spark, sf_dir)
    assert made.count() == 2 and made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_evidence_goes_on_without_its_block(spark):
    """A block is sent once, without a copy in lower case, and of a hit its span alone is summed up."""
    from orebed.operators import answers

    blocks = spark.createDataFrame([("P", 1, 0, "paragraph", 1, "A", "nothing"), ("P", 1, 1, "paragraph", 1, "B", "in ETHANOL at 180 C, 80.0 °C"), ("P", 1, 2, "paragraph", 2, "C", "ethanol, 80 C")], "paper_id string, version int, block_ordinal int, block_type string, page int, section string, text string")
    facts = spark.createDataFrame([("P", 1, "solvent", None, None, "Ethanol"), ("P", 1, "temperature", 80.0, "C", None), ("P", 1, "method", None, None, "other")], "paper_id string, version int, field string, value_num double, value_unit string, value_str string")
    located = answers.locate(facts, blocks)
    got = {r["field"]: (r["block_ordinal"], r["section"], r["char_start"], r["char_end"], r["evidence_text"], r["confidence"]) for r in located.collect()}
    assert got == {"solvent": (1, "B", 3, 10, "ETHANOL", 0.8), "temperature": (1, "B", 21, 28, "80.0 °C", 0.8), "method": (None, None, None, None, answers.UNLOCATED_TEXT, 0.6)}
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    assert "__low" not in plan and all("__block_text" not in line for line in plan.splitlines() if "min_by" in line)
