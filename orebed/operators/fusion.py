"""Competing facts of several sources: one value each by priority and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import FALLBACK_PRIORITY, FIELD_PRIORITY

DOC = ["paper_id", "version"]
PRECURSORS = ["precursors.name", "precursors.concentration", "precursors.amount"]
TECHNIQUES = ["characterization.technique"]
SCALARS = ["temperature", "reaction_time", "solvent", "synthesis_method", "material.name"]


def priority(field: Column, source: Column, priorities: dict[str, list[str]] = FIELD_PRIORITY, fallback: list[str] = FALLBACK_PRIORITY) -> Column:
    """Rank of a source for a field, from 0; sources without a rank come last, fields without one use the fallback."""
    rank = lambda order: F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    out = rank(fallback)
    for name, order in priorities.items():
        out = F.when(field == name, rank(order)).otherwise(out)
    return out


def source_order(source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(["RULE", "NER", "LLM"])], F.lit(9))


def resolve(candidates: DataFrame, by: list[str], field: Column, **how) -> DataFrame:
    """The winning row of each group: best rank, then confidence, then source and place (fact_ord) in the input."""
    order = [priority(field, F.col("source"), **how), F.desc("confidence"), source_order(F.col("source")), "fact_ord"]
    ranked = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def fuse_scalars(facts: DataFrame, **how) -> DataFrame:
    """paper_id, version, field, source, confidence, value_num, value_unit, value_str of the five scalar fields."""
    rows = facts.where(F.col("field_key").isin(*SCALARS))
    return resolve(rows, [*DOC, "field_key"], F.col("field_key"), **how).select(*DOC, F.col("field_key").alias("field"), "source", "confidence", "value_num", "value_unit", "value_str")


def fuse_precursors(facts: DataFrame, **how) -> DataFrame:
    """A row for each precursor name (lower case) of a document: name, concentration and amount, each from its own winner;
    fused_idx by first appearance (source, then place). Synonyms stay apart."""
    rows = facts.where(F.col("field_key").isin(*PRECURSORS))
    at = [*DOC, "source", "item_idx"]
    names = rows.where("field_key = 'precursors.name'").select(*at, F.lower("value_str").alias("key"), F.struct(source_order(F.col("source")), "fact_ord").alias("seen"))
    keyed = rows.join(names, at)
    suffix = F.substring_index("field_key", ".", -1)
    won = resolve(keyed.withColumn("suffix", suffix), [*DOC, "key", "suffix"], F.when(suffix == "name", F.lit("precursors.name")).otherwise(suffix), **how)
    of = lambda s, c: F.max(F.when(F.col("suffix") == s, F.col(c)))
    quantity = lambda s: F.max(F.when(F.col("suffix") == s, F.struct(F.col("value_num").alias("value"), F.col("value_unit").alias("unit")))).alias(s)
    first = names.groupBy(*DOC, "key").agg(F.min("seen").alias("seen"))
    fused = won.groupBy(*DOC, "key").agg(of("name", "value_str").alias("name"), quantity("concentration"), quantity("amount")).join(first, [*DOC, "key"])
    return fused.withColumn("fused_idx", F.row_number().over(Window.partitionBy(*DOC).orderBy("seen", "key")) - 1).drop("seen")


def union_techniques(facts: DataFrame) -> DataFrame:
    """Each technique (lower case) of a document once, with the finding of the first source that names it."""
    rows = facts.where(F.col("field_key").isin(*TECHNIQUES)).withColumn("key", F.lower("value_str"))
    place = Window.partitionBy(*DOC, "key").orderBy(source_order(F.col("source")), "fact_ord")
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").select(*DOC, "key", F.col("value_str").alias("technique"), "source")


def first_lists(lists: DataFrame) -> DataFrame:
    """Steps or properties of the first source that has any: paper_id, version, source and items in; the winners out."""
    rows = lists.where(F.size("items") > 0).withColumn("__o", source_order(F.col("source")))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*DOC).orderBy("__o"))).where("__n = 1").drop("__n", "__o")


def hybrid_version(rule: Column, ner: Column, llm: Column | None = None) -> Column:
    return F.concat(F.lit("hybrid@"), F.concat_ws("+", rule, ner, *([llm] if llm is not None else [])))
