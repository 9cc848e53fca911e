"""The engine's own operators on literal inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from orebed.functions import tables, text
from orebed.operators import annotation, answers, documents, evaluation, fusion, ner, normalize, retrieval, rules, store
from orebed.plans import engine
from orebed.sources import readers, sinks

BLOCK = "paper_id string, version int, block_ordinal int, block_type string, page int, section string, text string"


def blocks(spark, *texts, **same):
    return spark.createDataFrame([("P", 1, i, same.get("block_type", "paragraph"), 1 + i // 2, same.get("section"), t) for i, t in enumerate(texts)], BLOCK)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("rule", "said", "want"),
    [
        ("temperature", "at 80 °C and 300 kelvin", [(80.0, "C"), (300.0, "K")]),
        ("temperature", "25-30 °C", [(-30.0, "C")]),
        ("temperature", "80 °C", [(80.0, "C")]),
        ("temperature", "Figure 3 C", [(3.0, "C")]),
        ("temperature", "80 ºC", []),
        ("reaction_time", "2 hours, 30min, 5 s", [(2.0, "h"), (30.0, "min"), (5.0, "s")]),
        ("concentration", "10 mM; 5 mg/mL; 1 wt%; 45 nm; 3 m", [(10.0, "mM"), (5.0, "mg/mL"), (1.0, "wt%"), (45.0, "nM"), (3.0, "M")]),
        ("concentration", "5 μM", []),
        ("concentration", "5 µM 2 mMol", [(5.0, "uM")]),
        ("volume", "10 mL, 5 µL, 2L", [(10.0, "mL"), (5.0, "uL"), (2.0, "L")]),
        ("mass", "5 mg, 2 g/mL, 3 kg", [(5.0, "mg"), (3.0, "kg")]),
        ("mass", "nothing", []),
    ],
)
def test_rules(spark, rule, said, want):
    got = one(spark, lambda t: rules.matches(t, rule), said)
    assert [(m["value"], m["unit"]) for m in got] == want
    assert all(said[m["start"] : m["end"]] == m["text"] for m in got)


def test_offsets_count_code_points_and_first_wins(spark):
    b = blocks(spark, "😀 no", "😀é heated at 80 C for 2 h", "then 90 C", "")
    facts = rules.facts(b)
    by = {r["block_ordinal"]: b_ for r, b_ in zip(b.collect(), b.collect(), strict=True)}
    assert all(by[r["block_ordinal"]]["text"][r["char_start"] : r["char_end"]] == r["evidence_text"] for r in facts.collect())
    p = rules.first_wins(facts).first()
    assert (p["temperature"]["value"], p["reaction_time"]["unit"]) == (80.0, "h")


def test_entities_and_links(spark):
    said = "Silver nitrate (10 mM) and 5 mg of PVP in DI water_ gave AgNPs; TEM, tem. Waters, xPVP"
    found = one(spark, ner.entities, said)
    assert [(e["text"], e["label"]) for e in found] == [("Silver nitrate", "PRECURSOR"), ("PVP", "PRECURSOR"), ("DI water", "SOLVENT"), ("AgNPs", "MATERIAL"), ("TEM", "CHARACTERIZATION"), ("tem", "CHARACTERIZATION")]
    few = {"PRECURSOR": ["silver nitrate", "PVP"], "SOLVENT": ["water", "DI water"]}
    assert [tuple(e) for e in one(spark, lambda t: ner.greedy_entities(t, few), said)] == [tuple(e) for e in found[:3]]
    overlapping = {"A": ["b c"], "B": ["a b", "c d e"]}
    assert [e["text"] for e in one(spark, lambda t: ner.greedy_entities(t, overlapping), "a b c d e")] == ["a b", "c d e"]
    first = ner.first_mentions(ner.mentions(blocks(spark, said, "PVP (99 mM)", "silver nitrate 7 mM"))).where("label = 'PRECURSOR'").orderBy("item_idx").collect()
    assert [(r["text"], r["concentration"]["value"], r["amount"]["value"]) for r in first] == [("Silver nitrate", 10.0, 5.0), ("PVP", 10.0, 5.0)]
    far = ner.mentions(blocks(spark, "PVP " + "x" * 70 + " 5 mM")).first()
    assert far["concentration"] is None


def answer(spark, value):
    df = spark.createDataFrame([("P", 1, value if isinstance(value, str) else json.dumps(value))], "paper_id string, version int, raw_text string")
    return answers.predictions(answers.parse(df)).first()


def test_answers(spark):
    full = {
        "material": {"name": "Ag", "size": {"value": 10, "unit": "nm"}, "shape": "round"},
        "reagents": ["AgNO3", {"chemical": "PVP", "mass": "5 mg", "concentration": ["2 mM"]}, {"x": 1}, 3],
        "solvent": ["n/a", "water"], "time": "~2 hours", "temperature": {"value": "80 °C"}, "pH": "7.5", "method": {"name": "reduction"},
        "procedure": ["mix", {"action": "heat"}, None], "techniques": ["TEM", {"method": "XRD", "result": "fcc"}],
        "properties": [{"name": "gap", "value": 2.5, "unit": "eV"}, {"property": "colour", "value": "yellow"}, "x"],
    }
    p = answer(spark, full)
    assert p["error"] is None and p["material"].asDict(True) == {"name": "Ag", "composition": None, "size": {"value": 10.0, "unit": "nm"}, "morphology": "round"}
    assert [(x["name"], x["amount"] and tuple(x["amount"]), x["concentration"] and tuple(x["concentration"])) for x in p["precursors"]] == [("AgNO3", None, None), ("PVP", (5.0, "mg"), (2.0, "mM"))]
    assert (p["solvent"], p["synthesis_method"], p["ph"], tuple(p["reaction_time"]), tuple(p["temperature"])) == ("water", "reduction", 7.5, (2.0, "h"), (80.0, "C"))
    assert [tuple(s) for s in p["steps"]] == [(1, "mix"), (2, "heat")] and [tuple(c) for c in p["characterization"]] == [("TEM", None), ("XRD", "fcc")]
    assert [(x["name"], x["value"] and tuple(x["value"]), x["qualitative_value"]) for x in p["properties"]] == [("gap", (2.5, "eV"), None), ("colour", None, "yellow")]
    assert answer(spark, 'so: ```json\n{"solvent": "water"}\n``` ok')["solvent"] == "water"
    assert answer(spark, 'I think {x} but {"solvent": "water"} fits')["solvent"] == "water"
    assert answer(spark, "no idea")["error"].startswith("not valid JSON") and answer(spark, " ")["error"] == "empty response"
    assert answer(spark, [1])["material"] is None and answer(spark, {"material": "Au"})["material"]["name"] == "Au"


@pytest.mark.parametrize(("said", "want"), [("80 °C", (80.0, "C")), ("ca. 2.5 h", (2.5, "h")), ("80", None), ("3.5", None), ("25-30 °C", None), ("2 or 3 h", None), ("25 ± 2 °C", (25.0, "± 2 °C")), ("10 degrees Celsius", (10.0, "C")), ("-5 wt %", (-5.0, "wt%")), ("~ 1e-3M", (0.001, "M")), ("80eV", (80.0, "eV")), ("5. mg", (5.0, "mg")), (".5 mL", (0.5, "mL")), ("1.2.3 h", None), ("5 / 6 h", None), ("5 - 6 h", None), ("about 5 to 6 h", None), ("12 tons", (12.0, "tons")), ("++5 h", None), ("h", None), ("", None), ("Approx 7 min", (7.0, "min"))])
def test_quantity_texts(spark, said, want):
    got = one(spark, answers.quantity_of_text, said)
    assert (got and tuple(got)) == want


def test_evidence(spark):
    b = blocks(spark, "In water, 80.0 °C was kept.", "then 10 mM AgNO3")
    df = spark.createDataFrame([("P", 1, json.dumps({"solvent": "WATER", "temperature": "80 °C", "precursors": [{"name": "AgNO3", "concentration": "10 mM"}, "gold"], "pH": 7}))], "paper_id string, version int, raw_text string")
    rows = {r["field"]: r for r in engine.llm_facts(b, df).collect()}
    assert rows["solvent"]["evidence_text"] == "water" and rows["temperature"]["evidence_text"] == "80.0 °C" and rows["precursors[0].concentration"]["block_ordinal"] == 1
    assert rows["precursors[1].name"]["confidence"] == 0.6 and rows["pH"]["evidence_text"] == tables.UNLOCATED_TEXT and rows["solvent"]["confidence"] == 0.8


def test_general_numbers(spark):
    for x in (80.0, 0.5, 1234567.0, 1e-5, 0.0, 2.50, 123456.7, -3.25, 100000.0):
        assert spark.range(1).select(text.general_number(F.lit(x))).first()[0] == f"{x:g}"


def test_retries():
    said = iter(["no", '{"a": 1}'])
    asked = []
    assert answers.answer_with_retries(lambda p: asked.append(p) or next(said), "ask") == ('{"a": 1}', 2, None)
    assert asked[0] == "ask" and "Reply with one JSON value" in asked[1]
    waits = []

    def fails(_):
        raise OSError("down")

    assert answers.answer_with_retries(fails, "ask", 2, 1.5, waits.append) == (None, 3, "down") and waits == [1.5, 3.0]

    def never(_):
        raise answers.Permanent("bad key")

    assert answers.answer_with_retries(never, "ask") == (None, 1, "bad key")


def fact(spark, *rows):
    ddl = "paper_id string, version int, field string, field_key string, item_idx int, value_num double, value_unit string, value_str string, source string, confidence double, fact_ord long"
    return spark.createDataFrame(rows, ddl)


def test_fusion(spark):
    f = fact(
        spark,
        ("P", 1, "temperature", "temperature", None, 80.0, "C", None, "LLM", 0.99, 0),
        ("P", 1, "temperature", "temperature", None, 70.0, "C", None, "RULE", 0.5, 1),
        ("P", 1, "temperature", "temperature", None, 71.0, "C", None, "RULE", 0.5, 2),
        ("P", 1, "solvent", "solvent", None, None, None, "water", "HUMAN", 1.0, 0),
        ("P", 1, "precursors[0].name", "precursors.name", 0, None, None, "PVP", "LLM", 0.8, 0),
        ("P", 1, "precursors[0].amount", "precursors.amount", 0, 5.0, "mg", None, "LLM", 0.8, 1),
        ("P", 1, "precursors[0].name", "precursors.name", 0, None, None, "pvp", "NER", 1.0, 0),
        ("P", 1, "precursors[1].name", "precursors.name", 1, None, None, "gold", "LLM", 0.8, 2),
    )
    scalars = {r["field"]: r for r in fusion.fuse_scalars(f).collect()}
    assert scalars["temperature"]["value_num"] == 70.0 and scalars["solvent"]["value_str"] == "water"
    got = fusion.fuse_precursors(f).orderBy("fused_idx").collect()
    assert [(r["name"], r["amount"] and r["amount"]["value"]) for r in got] == [("pvp", 5.0), ("gold", None)]


def test_normalization(spark):
    terms = {t.lower() for label, ts in tables.TERMS.items() if label != "CHARACTERIZATION" for t in ts}
    known = {r["alias"] for r in tables.aliases(spark).collect()}
    assert terms <= known and len(tables.ENTITIES) == 22
    q = "struct<value:double,unit:string>"
    rows = spark.createDataFrame([("P", 1, 0, "Silver  nitrate", None, None), ("P", 1, 1, "AgNO3", (10.0, "mM"), None), ("P", 1, 2, "odd", None, None), ("P", 1, 3, "silver nitrate powder", None, None)], f"paper_id string, version int, item_idx int, name string, concentration {q}, amount {q}")
    merged, facts = normalize.merge_precursors(normalize.match_names(rows))
    got = merged.orderBy("merged_idx").collect()
    assert [(r["name"], r["mentions"]) for r in got] == [("Silver nitrate", 3), ("odd", 1)] and got[0]["concentration"]["value"] == 10.0
    assert {(r["item_idx"], r["confidence"] == 1.0) for r in facts.collect()} == {(1, True), (3, False)}
    assert normalize.cas_links(normalize.match_names(rows)).first()["cas_number"] == "7761-88-8"


def test_names_are_computed_once(spark):
    """The fallback reads them a second time; what they come from may be dear."""
    seen = spark.sparkContext.accumulator(0)

    def said(name):
        seen.add(1)
        return name

    rows = spark.createDataFrame([("AgNO3",), ("odd",), ("silver nitrate powder",)], "name string").select(F.udf(said, "string").asNondeterministic()("name").alias("name"))
    got = normalize.match_names(rows).collect()
    assert seen.value == 3 and {(r["name"], r["match_method"]) for r in got} == {("AgNO3", "exact_alias"), ("odd", None), ("silver nitrate powder", "embedding")}


def equal(spark, a, ua, b, ub):
    return spark.range(1).select(evaluation.quantities_equal(F.lit(a).cast("double"), F.lit(ua).cast("string"), F.lit(b).cast("double"), F.lit(ub).cast("string"))).first()[0]


def test_units(spark):
    assert equal(spark, 80.0, "C", 353.15, "K") and equal(spark, 1.0, "h", 60.0, "min") and equal(spark, 212.0, "F", 100.0, "C") and equal(spark, 80.0, "C", 80.3, "C")
    assert equal(spark, 1.0, "nM", 2.0, "nM") and not equal(spark, 1.0, "wt%", 1.0, "wt%") and not equal(spark, 1.0, "g", 1.0, "L") and not equal(spark, None, "g", 1.0, "g")


def test_agreement(spark):
    k = spark.createDataFrame([(True, True), (True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean").agg(*annotation.kappa_parts(F.col("a"), F.col("b"))).select(annotation.kappa()).first()[0]
    assert abs(k - 8 / 13) < 1e-12
    payload = {"paper_id": "P", "solvent": None, "precursors": [{"name": "A", "amount": {"value": 1.5}}, {"name": "B"}], "steps": [], "ok": True}
    df = spark.createDataFrame([("P", json.dumps(payload))], "paper_id string, payload string")
    flat = annotation.flatten(df, ["paper_id"])
    assert {(r["path"], r["value"]) for r in flat.collect()} == {("solvent", None), ("precursors[0].name", '"A"'), ("precursors[0].amount.value", "1.5"), ("precursors[1].name", '"B"'), ("ok", "true")}
    back = json.loads(annotation.unflatten(flat, ["paper_id"]).first()["payload"])
    assert back == {k: v for k, v in payload.items() if k not in ("paper_id", "steps")}
    other = spark.createDataFrame([("P", json.dumps({**{k: v for k, v in payload.items() if k != "solvent"}, "ok": False}))], "paper_id string, payload string")
    pairs = annotation.compare(flat, annotation.flatten(other, ["paper_id"]), ["paper_id"])
    r = annotation.agreement(pairs, ["paper_id"]).first()
    assert (r["paths"], r["agreed"]) == (5, 3)
    none = spark.createDataFrame([], "paper_id string, path string, value string")
    assert [x["path"] for x in annotation.adjudicate(pairs, none, ["paper_id"])[1].collect()] == ["ok"]
    with pytest.raises(ValueError, match="ok"):
        annotation.adjudicate_strictly(pairs, none, ["paper_id"])
    done = annotation.adjudicate_strictly(pairs, spark.createDataFrame([("P", "ok", "true")], none.schema), ["paper_id"])
    assert annotation.gold_facts(done, ["paper_id"], "me").count() == 4


def test_split(spark):
    ids = spark.range(101).select(F.col("id").cast("string").alias("paper_id"))
    a, b = annotation.split(ids.union(ids)).collect(), annotation.split(ids).collect()
    assert sorted(a) == sorted(b) and sum(r["is_test"] for r in a) == 20 and len(a) == 101
    with pytest.raises(ValueError, match="fraction"):
        annotation.split(ids, 1.0)


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "A"), ("a", 2, "A"), ("a", 3, "B"), ("a", 4, "A")], "k string, t int, content string")
    v = store.content_versions(rows, "k", "content", ["t"]).orderBy("t").collect()
    assert [(r["version"], r["is_new"]) for r in v] == [(1, True), (1, False), (2, True), (3, True)]
    log = spark.createDataFrame([(1, "FAIL", i) for i in range(3)] + [(2, "FAIL", 1), (3, "FAIL", 1), (3, "SUCCESS", 2)], "job_id long, event string, event_seq long")
    assert {tuple(r) for r in store.job_states(log).collect()} == {(1, "DEAD_LETTER", 3), (2, "QUEUED", 1), (3, "SUCCESS", 1)}


def test_chunks(spark):
    words = lambda n, w: " ".join([w] * n)
    b = spark.createDataFrame([("P", 1, 0, "paragraph", 1, "A", words(150, "x")), ("P", 1, 1, "paragraph", 2, "A", words(150, "y")), ("P", 1, 2, "paragraph", 3, "B", words(10, "z")), ("P", 1, 3, "paragraph", 4, None, "  "), ("P", 1, 4, "paragraph", 5, None, words(300, "w"))], BLOCK)
    got = retrieval.chunk_blocks(b, 200, 10).orderBy("chunk_ordinal").collect()
    assert [(r["token_count"], r["section"], r["page_start"], r["page_end"]) for r in got] == [(150, "A", 1, 1), (160, "A", 2, 2), (10, "B", 3, 3), (310, None, 5, 5)]
    assert got[1]["text"].startswith("x x") and "\n" in got[1]["text"]
    assert [r["token_count"] for r in retrieval.chunk_blocks(b, 200, 0).orderBy("chunk_ordinal").collect()] == [150, 150, 10, 300]
    e = retrieval.index_document(b.limit(1)).first()["embedding"]
    assert len(e) == 256 and abs(sum(x * x for x in e) - 1) < 1e-9


def test_vector_top_in_blocks(spark):
    v = [(i, [math.sin(i * (j + 1)) for j in range(5)]) for i in range(40)] + [(40, [0.0] * 5), (41, None)]
    d = spark.createDataFrame(v, "id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) * math.hypot(*b)) or 1)
    want = {(q, tuple(sorted((i for i, x in v if x), key=lambda i: (-round(cos(v[i][1], v[q][1]), 6), i))[:4])) for q in range(40)}
    for most in (1000, 3):
        got = retrieval.vector_top(d, d.where("id < 40"), 4, most_queries=most, digits=6).orderBy("query_id", "rank").collect()
        assert {(q, tuple(r["id"] for r in got if r["query_id"] == q)) for q in {r["query_id"] for r in got}} == want
    assert retrieval.vector_top(d, d.where("false")).count() == 0 and retrieval.vector_top(d.where("false"), d).count() == 0


def test_vector_top_of_equal_odd_and_long_vectors(spark, monkeypatch):
    """A third of the vectors are equal; some are null in part, zero, or of another length; slices and parts are small."""
    monkeypatch.setattr(retrieval, "PART", 40)
    v = [(f"e{i:03}", [1.0, 2.0, 3.0]) for i in range(60)] + [(f"r{i:03}", [math.sin(i), math.cos(3 * i), math.sin(5 * i)]) for i in range(120)]
    odd = [("n", None), ("p", [1.0, None, 3.0]), ("z", [0.0] * 3), ("s", [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), ("e000", [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(v + odd, "id string, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) * math.hypot(*b)) or 1)
    every = [x for x in v + odd if x[0] and x[1] and None not in x[1]]
    got = retrieval.vector_top(d, d.where("id in ('e005', 'r007', 'z', 's', 'n')"), 7, most_queries=2).collect()
    for q in ("e005", "r007", "z", "s"):
        own = dict(every)[q]
        want = sorted(((-cos(x, own), i) for i, x in every if len(x) == len(own)), key=lambda t: (round(t[0], 12), t[1]))[:7]
        assert [(r["id"], pytest.approx(r["score"])) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in want]
    assert {r["query_id"] for r in got} == {"e005", "r007", "z", "s"}


def test_vector_top_copies_nothing_for_blocks(spark, monkeypatch):
    """Many shares, blocks and packs: vectors aren't shuffled, queries once; ties and copies lie across shares."""
    monkeypatch.setattr(retrieval, "PART", 16)
    v = [(i, [(i * i * (j + 3)) % 7 - 3 for j in range(6)]) for i in range(300)]
    d = spark.createDataFrame(v, "id long, embedding array<int>").repartition(5)
    top = retrieval.vector_top(d, d.where("id % 10 = 0"), 4, most_queries=7, digits=6)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) * math.hypot(*b)) or 1)
    want = {(q, n + 1, i) for q in range(0, 300, 10) for n, (_, i) in enumerate(sorted((-round(cos(x, v[q][1]), 6), i) for i, x in v)[:4])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in top.collect()} == want
    held = spark.range(100).select("id", F.array(F.col("id").cast("int"), F.lit(1)).alias("embedding"))
    plan = retrieval.vector_top(held, held.where("id < 9"), 4, most_queries=2)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "explode(" not in plan and plan.count("Exchange") == 1


def test_documents(spark):
    b = blocks(spark, "first", "second", "third", section="S")
    r = documents.render(b, spark.createDataFrame([("P", 1, "T", None)], "paper_id string, version int, title string, abstract string")).first()
    assert r["rendered"] == "Title: T\n\n[Page 1]\n\n[Section: S]\n\nfirst\n\nsecond\n\n[Page 2]\n\nthird" and not r["truncated"]
    assert documents.render(b, max_chars=5).first()["truncated"] and documents.full_text(b).first()["full_text"] == "first\nsecond\nthird"
    for pages, chars, want in ((5, 50, True), (5, 5000, False), (1, 0, True), (0, 0, False)):
        assert spark.range(1).select(documents.needs_ocr(F.lit(pages), F.lit(chars))).first()[0] is want
    p = spark.range(1).select(documents.build_prompt(F.lit("D"), F.lit("x {document} y")), documents.build_prompt(F.lit("D"), F.lit("go"))).first()
    assert p[0] == "x D y" and p[1].index("<paper>") < p[1].index("<instructions>")
    s = spark.createDataFrame([("P", 0, "Intro", "all the  second things"), ("P", 1, "Later", "second")], "paper_id string, section_ordinal int, heading string, text string")
    assert {r["text"]: r["section"] for r in documents.assign_sections(b, s).collect()} == {"first": None, "second": "Intro", "third": None}


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  title</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><author><persName><surname>Wu</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short &amp; clear</p></abstract></profileDesc></teiHeader><text><body><div><head>One</head><p>a <hi>b</hi></p><p>c</p></div><div><p>d</p></div><div/></body>
<back><div><listBibl><biblStruct><analytic><title>Ref 1</title></analytic></biblStruct></listBibl></div></back></text></TEI>"""


def test_sources(spark, tmp_path):
    t = readers.parse_tei(spark.createDataFrame([(TEI,)], "xml string")).first()
    assert (t["title"], t["abstract"], t["authors"], t["references"]) == ("A title", "Short & clear", ["Ann Lee", "Wu"], ["Ref 1"])
    assert [tuple(s) for s in t["sections"]] == [("One", "a b\nc"), (None, "d")]
    html = "<html><head><title>T</title><script>p</script></head><body><h1>H</h1><p>a <b>b</b>\n c</p><!-- <p>x</p> --><p> </p></body></html>"
    assert [(r["block_type"], r["text"]) for r in readers.html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("block_ordinal").collect()] == [("heading", "T"), ("heading", "H"), ("paragraph", "a b c")]
    files = spark.createDataFrame([("a.pdf", 4, bytearray(b"%PDF")), ("b.txt", 4, bytearray(b"%PDF")), ("c.pdf", 4, bytearray(b"text")), ("d.pdf", 1 << 40, bytearray(b"%PDF"))], "path string, length long, content binary")
    good, bad = readers.admit(files)
    assert [r["path"] for r in good.collect()] == ["a.pdf"] and {r["reason"] for r in bad.collect()} == {"not a .pdf file", "no PDF content", "too large"}
    parsed = readers.parsed_blocks(good, lambda: lambda content: [{"text": " x ", "page": 1}, {"text": " "}]).collect()
    assert [(r["text"], r["block_ordinal"]) for r in parsed] == [("x", 0)]
    fetched = readers.fetched(good.select("path", "content"), lambda: lambda content: 1 / 0).first()
    assert fetched["xml"] is None and "zero" in fetched["xml_error"]
    (tmp_path / "b.txt").write_text(" two \n")
    (tmp_path / "a.txt").write_text("one")
    assert [tuple(r) for r in readers.read_prompts(spark, str(tmp_path)).collect()] == [("a", "one"), ("b", "two")]
    doc = {"paper_id": "P", "version": 1, "title": "T", "authors": [{"full_name": "A"}], "references": [], "blocks": [{"block_type": "paragraph", "page_number": 1, "text": "x"}], "was_ocred": False, "used_grobid": True}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    d = readers.read_canonical(spark, f"{tmp_path}/c.json")
    both = readers.load_documents(d, readers.canonical_blocks(d).withColumn("paper_id", F.lit("Q")).unionByName(readers.canonical_blocks(d)))
    assert sorted(r["paper_id"] for r in both.collect()) == ["P", "Q"]
    sinks.write_json_lines(d.select("paper_id", "title"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first()["title"] == "T"


def test_strategies(spark):
    b = blocks(spark, "Silver nitrate (10 mM) at 80 C for 2 h in ethanol.")
    a = spark.createDataFrame([("P", 1, '{"temperature": "90 C", "method": "reduction"}')], "paper_id string, version int, raw_text string")
    facts = engine.extract(b, " Hybrid ", a)
    fused = {r["field"]: r["value_num"] or r["value_str"] for r in fusion.fuse_scalars(facts).collect()}
    assert fused == {"temperature": 80.0, "reaction_time": 2.0, "solvent": "ethanol", "synthesis_method": "reduction"}
    assert engine.extract(b, "rule", stored=b).count() == 0 and engine.get_strategy("rag_llm") is engine.llm_facts
    assert [r["canonical_id"] for r in engine.normalized_precursors(facts).collect()] == ["AGNO3"]
    with pytest.raises(ValueError, match="unknown extractor"):
        engine.get_strategy("magic")
