"""Blocks and documents: text, sections, prompts, metadata, validation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256, strip

DOC = ["paper_id", "version"]
MAX_CHARS = 400_000
TRUNCATED = "\n\n[Document truncated]"
PLACEHOLDER = "{document}"


def blocks_of_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for each line that isn't blank: paper_id, version, block_ordinal, block_type, page, section, text."""
    lines = documents.select(F.col(key).cast("string").alias("paper_id"), F.posexplode(F.split(text, "\n")).alias("block_ordinal", "line"))
    return lines.where(strip(F.col("line")) != "").select("paper_id", F.lit(1).alias("version"), "block_ordinal", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), strip(F.col("line")).alias("text"))


def needs_ocr(pages: Column, chars: Column, least: int = 100) -> Column:
    return F.when(pages <= 0, F.lit(False)).otherwise(chars / pages < least)


def full_text(blocks: DataFrame) -> DataFrame:
    """Each document's blocks with text, in order, joined by newlines."""
    rows = F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("block_ordinal", "text"))))
    return blocks.groupBy(*DOC).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("full_text"))


def render(blocks: DataFrame, heads: DataFrame | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """Text for a model: title and abstract (of heads: paper_id, version, title, abstract), then blocks but references,
    with a mark where page or section changes; cut at max_chars. Returns rendered, truncated."""
    kept = blocks.where((F.col("block_type") != "reference") & (strip(F.col("text")) != ""))
    before = Window.partitionBy(*DOC).orderBy("block_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    section = F.when(F.length("section") > 0, F.col("section"))
    last_page, last_section = F.last("page", True).over(before), F.last(section, True).over(before)
    page_mark = F.when(F.col("page").isNotNull() & ~F.col("page").eqNullSafe(last_page), F.concat(F.lit("[Page "), F.col("page"), F.lit("]")))
    section_mark = F.when(section.isNotNull() & ~section.eqNullSafe(last_section), F.concat(F.lit("[Section: "), section, F.lit("]")))
    parts = kept.select(*DOC, "block_ordinal", F.concat_ws("\n\n", page_mark, section_mark, strip(F.col("text"))).alias("part"))
    body = parts.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ordinal", "part"))), lambda r: r["part"]), "\n\n").alias("body"))
    if heads is not None:
        body = heads.select(*DOC, "title", "abstract").join(body, DOC, "left")
        head = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), F.col(c)))
        body = body.select(*DOC, F.concat_ws("\n\n", head("Title", "title"), head("Abstract", "abstract"), "body").alias("body"))
    long = F.char_length("body") > max_chars
    return body.select(*DOC, F.when(long, F.concat(F.substring("body", 1, max_chars), F.lit(TRUNCATED))).otherwise(F.col("body")).alias("rendered"), long.alias("truncated"))


def build_prompt(document: Column, instructions: Column) -> Column:
    """The instructions with the document in place of {document}, else the document and then the instructions."""
    wrapped = F.concat(F.lit("<paper>\n"), document, F.lit("\n</paper>\n\n<instructions>\n"), instructions, F.lit("\n</instructions>"))
    return F.when(instructions.contains(PLACEHOLDER), F.replace(instructions, F.lit(PLACEHOLDER), document)).otherwise(wrapped)


def prompt_fingerprint(prompt: Column) -> Column:
    return F.substring(sha256(strip(prompt)), 1, 10)


def redact(text: Column, secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("[redacted]"))).otherwise(text)


def evidence_granularity(char_start: Column, char_end: Column, page: Column, section: Column) -> Column:
    return F.when(char_start.isNotNull() & char_end.isNotNull(), "char_span").when(page.isNotNull() | section.isNotNull(), "page_or_section").otherwise("unlocalized")


def metadata(blocks: DataFrame) -> DataFrame:
    """pages (the largest), sections (sorted), blocks and characters of each document."""
    return blocks.groupBy(*DOC).agg(F.max("page").alias("pages"), F.array_sort(F.collect_set("section")).alias("sections"), F.count("*").alias("blocks"), F.sum(F.char_length("text")).alias("chars"))


def assign_sections(blocks: DataFrame, sections: DataFrame, snippet: int = 60, key: list[str] | None = None) -> DataFrame:
    """blocks with the heading of the first section (paper_id, section_ordinal, heading, text) whose text holds the first
    characters of the block, white space collapsed; null without one. Beginnings (60 characters, each once) meet the
    sections of their paper in a join that emits only what a section holds, and that Spark may split for a paper of very
    many blocks; what is found joins the blocks by paper and beginning. Texts of sections move once."""
    key = key or ["paper_id"]
    squash = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    begin = F.substring(squash(F.col("text")), 1, snippet)
    begins = blocks.select(*[F.col(c).alias(f"__{c}") for c in key], begin.alias("__begin")).where("__begin <> ''").distinct()
    s = sections.select(*key, "section_ordinal", "heading", squash("text").alias("__text")).where("__text <> ''")
    same = [F.col(c) == F.col(f"__{c}") for c in key]
    held = s.join(begins, reduce(and_, same) & F.contains("__text", "__begin")).select(*key, "section_ordinal", "heading", "__begin")
    first = held.groupBy(*key, "__begin").agg(F.min_by("heading", "section_ordinal").alias("section"))
    return blocks.drop("section").withColumn("__begin", begin).join(first, [*key, "__begin"], "left").drop("__begin")


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that hold to the schema, and the others with a reason."""
    reason = (
        F.when(F.col("version") < 1, "version")
        .when(F.col("page") < 1, "page")
        .when(F.col("char_start") < 0, "char_start")
        .when(F.col("char_end") < F.col("char_start"), "char_end")
        .when(~F.col("confidence").between(0, 1), "confidence")
    )
    marked = facts.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def as_params(config: DataFrame, prompt: str = "prompt") -> Column:
    """A configuration row as a map of strings, its prompt replaced by its fingerprint."""
    names = [c for c in config.columns if c != prompt]
    out = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    if prompt in config.columns:
        out += [F.lit("prompt_sha"), prompt_fingerprint(F.col(prompt))]
    return F.create_map(*out)


def canonical_strategy(name: Column) -> Column:
    n = F.lower(strip(name))
    return F.when(n.isin("llm", "prompt_llm", "rag_llm"), "llm").when(n.isin("rule", "ner", "hybrid"), n)
