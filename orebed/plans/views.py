"""Deterministic views over the test tables: recipe sentences, gold, recorded answers and annotations by key arithmetic.

Each view is one SQL body for both engines; {S} is the string type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_LINES = "select doc_id, cast(pos as bigint) as ord, line from (select doc_id, posexplode(split(text, '\\\\n')) as (pos, line) from documents)"
DUCK_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents"

PRECURSOR = "case r % 5 when 0 then 'Silver nitrate' when 1 then 'AgNO3' when 2 then 'HAuCl4' when 3 then 'sodium borohydride' else 'zinc acetate' end"
SECOND = "case r % 3 when 0 then 'trisodium citrate' when 1 then 'PVP' else 'sodium citrate' end"
SOLVENT = "case r % 4 when 0 then 'ethanol' when 1 then 'DI water' when 2 then 'deionized water' else 'toluene' end"
MATERIAL = "case r % 2 when 0 then 'silver nanoparticles' else 'AuNPs' end"
TECHNIQUE = "case r % 3 when 0 then 'TEM' when 1 then 'XRD' else 'UV-Vis' end"

#: doc_id, ord, line, r, injected: every line and its number.
INJECTED = "(doc_id + ord) % 3 <> 2"
RECIPE = f"select doc_id, ord, line, (doc_id * 31 + ord * 17) % 997 as r, {INJECTED} as injected from lines"

#: The blocks of a document, a recipe sentence in two of three.
BLOCKS = f"""select doc_id as paper_id, 1 as version, cast(ord as int) as block_ordinal, 'paragraph' as block_type,
  cast(1 + (ord - ord % 4) / 4 as int) as page, case ord % 3 when 0 then 'Introduction' when 1 then 'Experimental' else 'Results' end as section,
  case when injected then line || ' ' || {PRECURSOR} || ' (' || cast(1 + r % 50 as {{S}}) || ' mM) and ' || cast(5 + r % 95 as {{S}}) || ' mg of ' || {SECOND}
    || ' were dissolved in ' || cast(10 + r % 40 as {{S}}) || ' mL of ' || {SOLVENT} || ' and heated at ' || cast(20 + r % 180 as {{S}}) || ' C for '
    || cast(1 + r % 12 as {{S}}) || ' h to give ' || {MATERIAL} || '. ' || {TECHNIQUE} || ' was used.' else line end as text
  from recipe"""

#: The same with the place where the recipe sentence starts; what a document itself says before it isn't of the recipe.
STATED = BLOCKS.replace(" as text\n  from recipe", " as text, case when injected then char_length(line) + 1 end as said_at\n  from recipe")

#: The first recipe sentence of each document, and what it says.
FIRSTS = f"""select doc_id, min(ord) as ord from recipe where injected group by doc_id"""
SAID = f"""select f.doc_id, f.ord, x.r, {PRECURSOR.replace('r %', 'x.r %')} as precursor, {SECOND.replace('r %', 'x.r %')} as second, {SOLVENT.replace('r %', 'x.r %')} as solvent,
  {MATERIAL.replace('r %', 'x.r %')} as material, {TECHNIQUE.replace('r %', 'x.r %')} as technique, cast(20 + x.r % 180 as double) as temp, cast(1 + x.r % 12 as double) as hours,
  cast(1 + x.r % 50 as double) as conc, cast(5 + x.r % 95 as double) as mass
  from firsts f join recipe x on x.doc_id = f.doc_id and x.ord = f.ord"""

#: The same from a text's number of lines, without a row for each; {N}: the tasks that documents are dealt to. What follows is made in
#: as many, where adaptive execution would see only two numbers a document, and put them into one.
FIRSTS_DEALT = f"""select doc_id, min(ord) as ord from (select /*+ repartition({{N}}, doc_id) */ doc_id,
    cast(array_min(filter(sequence(0, octet_length(text) - octet_length(replace(text, chr(10), ''))), ord -> {INJECTED})) as bigint) as ord from documents) group by doc_id having min(ord) is not null"""

#: The same without a second pass over the documents: a line's r follows from its number.
SAID_ONCE = SAID.split("from firsts")[0] + "from (select doc_id, ord, (doc_id * 31 + ord * 17) % 997 as r from firsts) x"
SAID_ONCE = SAID_ONCE.replace("f.doc_id, f.ord", "x.doc_id, x.ord")

#: Gold for labelled documents: kelvin for every fourth, 5 more for every seventh, minutes for every sixth, no solvent for every fifth.
GOLD = """select doc_id as paper_id, (temp + case when doc_id % 7 = 0 then 5 else 0 end) + case when doc_id % 4 = 0 then 273.15 else 0 end as temp_value,
  case when doc_id % 4 = 0 then 'K' else 'C' end as temp_unit, hours * case when doc_id % 6 = 0 then 60 else 1 end as time_value,
  case when doc_id % 6 = 0 then 'min' else 'h' end as time_unit, case when doc_id % 5 <> 0 then solvent end as solvent, material, technique, precursor, second,
  conc + case when doc_id % 9 = 0 then 1 else 0 end as conc, mass
  from said where doc_id in (select doc_id from labels)"""

#: Model answers: another concentration for every third, an upper-case material for every second, fenced for every sixth, no JSON for every fiftieth.
ANSWERS = """select doc_id as paper_id, case when doc_id % 50 = 0 then 'I cannot say.' when doc_id % 6 = 0 then 'Here:' || chr(10) || '```json' || chr(10) || js || chr(10) || '```' else js end as raw_text
  from (select doc_id, '{"material": {"name": "' || case when doc_id % 2 = 0 then upper(material) else material end || '"}, "reagents": [{"name": "' || precursor || '", "concentration": {"value": '
  || cast(cast(conc + case when doc_id % 3 = 0 then 2 else 0 end as int) as {S}) || ', "unit": "mM"}}, "' || second || '"], "solvent": "' || solvent || '", "temperature": "' || cast(cast(temp as int) as {S}) || ' °C", "time": {"value": "'
  || cast(cast(hours as int) as {S}) || '", "units": "hours"}, "method": "reduction", "pH": ' || cast(doc_id % 20 as {S}) || ', "steps": ["dissolve", {"action": "heat"}], "techniques": ["' || technique || '"]}' as js from said)"""

CTES = [("recipe", RECIPE), ("blocks", BLOCKS), ("firsts", FIRSTS), ("said", SAID), ("gold", GOLD), ("answers", ANSWERS)]


def duck(query: str, *more: tuple[str, str]) -> str:
    """A query of the views for DuckDB."""
    parts = [("lines", DUCK_LINES), *((n, b.replace("{S}", "varchar")) for n, b in CTES), *more]
    return "with " + ",\n".join(f"{n} as ({b})" for n, b in parts) + f"\n{query}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only what it needs of the tables is read."""
    own = {"firsts": FIRSTS_DEALT.replace("{N}", spark.conf.get("spark.sql.shuffle.partitions")), "said": SAID_ONCE}
    if name == "gold":  # else the condition on labels sinks to the documents, and whole texts are shuffled to meet them
        own["firsts"] = own["firsts"].replace("select doc_id, min(ord)", "select min(doc_id) as doc_id, min(ord)", 1)
    every = [*((n, own.get(n, b)) for n, b in CTES), ("stated", STATED)]
    needed = [n for n, _ in every[: [n for n, _ in every].index(name) + 1] if n != "gold" or name == "gold"]
    tables = {"documents": "documents", **({"labels": "labels"} if name == "gold" else {})}
    parts = [("lines", SPARK_LINES)] + [(n, b.replace("{S}", "string")) for n, b in every if n in needed]
    text = "with " + ", ".join(f"{n} as ({b})" for n, b in parts) + f" select * from {name}"
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in frames:
        text = text.replace(f"from {t})", f"from {{{t}}})").replace(f"from {t} ", f"from {{{t}}} ")
    body = text.replace("{", "{{").replace("}", "}}")
    for t in frames:
        body = body.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(body, **frames)
