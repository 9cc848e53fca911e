"""Quantities by rule: matches in blocks, facts, and first-in-reading-order predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import RULES, UNITS, look_up
from ..functions.text import FLAGS, let, spans

#: Columns that name a block.
BLOCK = ["paper_id", "version", "block_ordinal"]


#: What classes of a pattern stand for where words, digits and white space are those of ASCII alone.
ASCII = {r"\d": "[0-9]", r"\s": r"[\t\n\f\r ]", r"\b": "(?-i:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"}


def matches(text: Column, rule: str, ascii_only: bool = False) -> Column:
    """All quantities of one kind in a text: array of text, start, end, value, unit, confidence; unknown units go. ascii_only:
    patterns are read as SQL engines read them, whose words end before a letter as ü."""
    pattern, confidence = next((p, c) for n, p, c in RULES if n == rule)
    for sign, plain in ASCII.items() if ascii_only else ():
        pattern = pattern.replace(sign, plain)
    found = spans(text, FLAGS + pattern)
    known = F.transform(
        found,
        lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), m["g1"].cast("double").alias("value"), look_up(UNITS[rule], F.lower(F.trim(m["g2"]))).alias("unit"), F.lit(confidence).alias("confidence")),
    )
    # most blocks hold no digit: the cheap test first
    none = F.array().cast("array<struct<text:string,start:int,end:int,value:double,unit:string,confidence:double>>")
    return F.when(text.rlike(r"(?U)\d"), F.filter(known, lambda m: m["unit"].isNotNull())).otherwise(F.when(text.isNotNull(), none))


def amounts(text: Column) -> Column:
    """What matches gives for concentration and for mass, as {c, m}, in one pass. No match of one lies across one of the
    other: a unit holds no digit and stands right after its number, and no spelling is of both kinds."""
    parts = {n: (p, c) for n, p, c in RULES}
    number, of_c = _split(parts["concentration"][0])
    same, of_m = _split(parts["mass"][0])
    assert number == same
    found = spans(text, f"{FLAGS}{number}(?:{of_c}|{of_m})", 3)

    def of(x: Column, kind: str, group: str) -> Column:
        own = F.filter(x, lambda m: m[group] != "")
        known = F.transform(own, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), m["g1"].cast("double").alias("value"), look_up(UNITS[kind], F.lower(F.trim(m[group]))).alias("unit"), F.lit(parts[kind][1]).alias("confidence")))
        return F.filter(known, lambda m: m["unit"].isNotNull())

    return let(found, lambda x: F.struct(of(x, "concentration", "g2").alias("c"), of(x, "mass", "g3").alias("m")))


def _split(pattern: str) -> tuple[str, str]:
    """The number of a rule with the white space behind it, and its unit."""
    at = pattern.index(r"\s*") + 3
    return pattern[:at], pattern[at:]


def facts(blocks: DataFrame, extractor_version: str = "rule@1", only: list[str] | None = None, since: str | None = None, ascii_only: bool = False) -> DataFrame:
    """A row for each match of each rule (or of those in only) in each block with text, without a shuffle. fact_ord: place among the document's
    facts is (block_ordinal, rule_ord, char_start). since: a column of blocks, the first place whose matches count (null: none).
    ascii_only: see matches."""
    kinds = [(i, name) for i, (name, _, _) in enumerate(RULES) if only is None or name in only]
    one = lambda i, n: F.transform(matches(F.col("text"), n, ascii_only), lambda m: F.struct(F.lit(n).alias("field"), F.lit(i).alias("rule_ord"), m["value"].alias("value_num"), m["unit"].alias("value_unit"), m["text"].alias("evidence_text"), m["start"].alias("char_start"), m["end"].alias("char_end"), m["confidence"].alias("confidence")))
    every = F.concat(*[one(i, n) for i, n in kinds])
    every = every if since is None else F.filter(every, lambda f: f["char_start"] >= F.col(since))
    rows = blocks.where(F.length("text") > 0).select(*BLOCK, "page", "section", F.explode(every).alias("f"))
    return rows.select(*BLOCK, "page", "section", "f.*", F.lit("RULE").alias("source"), F.lit(extractor_version).alias("extractor_version"))


def first_wins(fact_rows: DataFrame) -> DataFrame:
    """paper_id, version, temperature, reaction_time: the first fact of each in reading order. Other kinds stay facts."""
    first = lambda name: F.min_by(F.struct(F.col("value_num").alias("value"), F.col("value_unit").alias("unit")), F.when(F.col("field") == name, F.struct("block_ordinal", "char_start")))
    picked = lambda name: first(name).alias(name)
    return fact_rows.where(F.col("field").isin("temperature", "reaction_time")).groupBy("paper_id", "version").agg(picked("temperature"), picked("reaction_time"))
