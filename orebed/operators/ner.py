"""Vocabulary entities in blocks, and their links to the nearest quantities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import TERMS, look_up
from ..functions.text import CLOSES, let, parted, running, spans
from .rules import BLOCK, amounts

MAX_DISTANCE = 60


def _pattern(terms: list[str]) -> str:
    """The terms, longest first, between characters that are no letter or digit. Terms that begin alike share that letter,
    so that a place is tried once for each letter; which of them wins is the same."""
    escaped = lambda t: re.sub(r"([^A-Za-z0-9 ])", r"\\\1", t)
    by_letter: dict[str, list[str]] = {}
    for t in sorted(terms, key=len, reverse=True):  # stable: ties keep their order
        by_letter.setdefault(t[0].lower(), []).append(t[1:])
    every = "|".join(f"{escaped(c)}(?:{'|'.join(map(escaped, rest))})" for c, rest in by_letter.items())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])({every})(?![\p{{L}}\p{{N}}])"


def entities(text: Column, terms: dict[str, list[str]] = TERMS) -> Column:
    """Entities in order of place, longest term first: array of text, start, end, label. The one alternation equals the
    greedy choice as long as no term ends as another begins; greedy_entities holds for every vocabulary."""
    labels = {t.lower(): label for label, ts in terms.items() for t in ts}
    found = spans(text, _pattern([t for ts in terms.values() for t in ts]), 1)
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), look_up(labels, F.lower(m["text"])).alias("label")))


def greedy_entities(text: Column, terms: dict[str, list[str]]) -> Column:
    """The same for a vocabulary whose terms overlap: terms by falling length each take all places still free."""
    every = sorted(((t, label) for label, ts in terms.items() for t in ts), key=lambda x: -len(x[0]))

    def hits(term: str, label: str) -> Column:
        return F.transform(spans(text, _pattern([term]), 1), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<text:string,start:int,end:int,label:string>>")
    meets = lambda taken, h: F.exists(taken, lambda t: (t["start"] < h["end"]) & (h["start"] < t["end"]))
    taken = F.aggregate(F.concat(*[hits(*x) for x in every]), none, lambda a, h: F.when(meets(a, h), a).otherwise(F.array_append(a, h)))
    return F.array_sort(taken, lambda a, b: a["start"] - b["start"])


#: Runs of letters and digits; what stands between two of them can't be part of a longer word.
WORD = r"[\p{L}\p{N}]+"
#: Signs that a term of a dictionary may begin or end with, at most.
EDGE = 8
#: Terms of a dictionary that are sent to all executors; a larger one is joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Slots of first_marks, at most; with more first words than that some words pass that no term begins with.
MOST_SLOTS = 1 << 18


def first_marks(terms: DataFrame) -> bytes:
    """For each slot a byte, 1 if the hash of a first word (column first) falls into it: 16 slots or more for each word, and
    MOST_SLOTS at most, so that it can stand in a plan."""
    n = terms.agg(F.count_distinct("first")).first()[0]
    slots = min(MOST_SLOTS, 1 << (16 * n).bit_length())
    part = 1 << 15  # bits of a bitmap
    slot = F.pmod("first", F.lit(slots))
    maps = terms.groupBy(F.floor(slot / part).alias("k")).agg(F.bitmap_construct_agg(slot % part).alias("bits")).collect()
    out = np.zeros(max(slots, part), np.uint8)
    for m in maps:
        out[m["k"] * part : (m["k"] + 1) * part] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), bitorder="little")
    return out[:slots].tobytes()


def places(text: Column, marks: bytes, longest: int) -> Column:
    """Of each word of a text that falls into a marked slot: where it starts, the characters before, and as many words on as a
    term has and one more, each with CLOSES and what follows it; null without any. The other words are hashed and left."""
    slot = lambda x: F.pmod(F.xxhash64(F.lower(F.substring_index(x, CLOSES, 1))), F.lit(len(marks))).cast("int")
    marked = lambda x: F.substring(F.lit(marks), slot(x) + 1, F.lit(1)) == F.lit(b"\x01")

    def every(p: Column) -> Column:
        at = F.filter(F.transform(p, lambda x, i: F.when((i > 0) & marked(x), i)), lambda i: i.isNotNull())

        def since(i: Column, last: Column) -> Column:
            """The text from the place before, or the beginning, up to this one."""
            return F.replace(F.array_join(F.slice(p, last + 1, i - last), ""), F.lit(CLOSES), F.lit(""))

        def of(k: Column) -> Column:
            between = F.transform(k, lambda i, j: since(i, F.coalesce(F.get(k, j - 1), F.lit(0))))
            one = lambda i, j, b, s: F.struct(F.element_at(s, j + 2).alias("start"), F.right(F.element_at(b, j + 1), F.lit(EDGE + 1)).alias("before"), F.array_join(F.slice(p, i + 1, longest + 1), "").alias("next"))
            return let(between, lambda b: let(running(F.transform(b, lambda x: F.char_length(x)), F.lit(0)), lambda s: F.transform(k, lambda i, j: one(i, j, b, s))))

        return let(at, lambda k: F.when(F.size(k) > 0, of(k)))

    return let(parted(text, WORD), every)


def dictionary_entities(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The choice of greedy_entities for a dictionary of any size: a row for each entity of each block, with text, start, end
    and label. dictionary: term, label, ord (of terms of one length the smaller goes first).

    A term that is found begins and ends between words, so it is a row of whole words with what parts them. First words
    that terms have pick the places worth a look, within the block's row (see places), so that other words never become
    rows; there as many words on as the terms of that first word have are met with terms by their hash, and compared. Both
    tables go to all executors if they are small enough (they are counted), else rows of a few words are shuffled. Of a
    block's hits, longest terms first, each takes its place if that is free.

    Terms without a letter or digit, or with over EDGE signs at an end, aren't found. Case plays no part. Blocks without
    text or hits have no rows; null terms none either; repeated terms have the label of the smallest ord."""
    signs = lambda pattern: F.regexp_extract("term", pattern, 0)
    d = dictionary.where(F.col("term").rlike(WORD)).select(
        F.lower("term").alias("whole"), "label", F.col("ord").alias("ord"), F.lower(signs(r"^[^\p{L}\p{N}]*")).alias("lead"), F.lower(signs(r"[^\p{L}\p{N}]*$")).alias("trail"), F.char_length("term").alias("size")
    )
    d = d.where((F.char_length("lead") <= EDGE) & (F.char_length("trail") <= EDGE))
    core = F.substring("whole", F.char_length("lead") + 1, F.col("size") - F.char_length("lead") - F.char_length("trail"))
    d = d.withColumn("core", core).withColumns({"core_hash": F.xxhash64("core"), "first": F.xxhash64(F.regexp_extract("core", WORD, 0)), "words": F.size(F.regexp_extract_all("core", F.lit(WORD), F.lit(0)))})
    firsts = d.groupBy("first").agg(F.collect_set("words").alias("sizes"))
    terms = d.select("core_hash", "core", "label", "ord", "lead", "trail", "size")
    if dictionary.count() <= MOST_BROADCAST:
        firsts, terms = F.broadcast(firsts), F.broadcast(terms)

    where = [*BLOCK, "page", "section"]
    longest = d.agg(F.max("words")).first()[0] or 1

    found = places(F.col("text"), first_marks(d), longest)
    rows = blocks.where(F.length("text") > 0).select(*where, F.explode(found).alias("x")).select(*where, "x.*").withColumn("first", F.xxhash64(F.lower(F.substring_index("next", CLOSES, 1))))
    bare = lambda x: F.replace(x, F.lit(CLOSES), F.lit(""))
    rows = rows.join(firsts, "first").select(*where, "start", "before", "next", F.explode("sizes").alias("n")).where(F.col("n") <= F.char_length("next") - F.char_length(bare(F.col("next"))))
    rows = rows.withColumn("head", F.call_function("substring_index", "next", F.lit(CLOSES), "n"))
    after = bare(F.substring("next", F.char_length("head") + 1, F.lit(1 << 30)))
    rows = rows.select(*where, F.col("start").alias("a"), bare(F.col("head")).alias("said"), "before", F.left(after, F.lit(EDGE + 1)).alias("after"))
    rows = rows.withColumn("b", F.col("a") + F.char_length("said"))
    rows = rows.withColumn("core_hash", F.xxhash64(F.lower("said")))
    met = rows.join(terms, "core_hash").where(F.lower("said") == F.col("core"))
    lead, trail = F.char_length("lead"), F.char_length("trail")
    # what a term begins with stands before the words, and before that no letter or digit
    fits = F.endswith(F.lower("before"), "lead") & F.startswith(F.lower("after"), "trail")
    beyond = F.when(lead > 0, F.when(F.char_length("before") > lead, ~F.substring("before", F.char_length("before") - lead, 1).rlike(WORD)).otherwise(F.lit(True))).otherwise(F.lit(True))
    behind = F.when(trail > 0, ~F.coalesce(F.substring("after", trail + 1, 1), F.lit("")).rlike(WORD)).otherwise(F.lit(True))
    hits = met.where(fits & beyond & behind)
    text = F.concat(F.when(lead > 0, F.substring("before", F.char_length("before") - lead + 1, lead)).otherwise(""), "said", F.substring("after", F.lit(1), trail))
    hit = F.struct((-F.col("size")).alias("minus"), "ord", (F.col("a") - lead).alias("start"), (F.col("b") + trail).alias("end"), text.alias("text"), "label")
    listed = hits.groupBy(*where).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    none = F.array().cast("array<struct<text:string,start:int,end:int,label:string>>")
    meets = lambda taken, h: F.exists(taken, lambda t: (t["start"] < h["end"]) & (h["start"] < t["end"]))
    own = lambda h: F.struct(h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"))
    chosen = F.aggregate("hits", none, lambda a, h: F.when(meets(a, h), a).otherwise(F.array_append(a, own(h))))
    return listed.select(*where, F.explode(chosen).alias("e")).select(*where, "e.*")


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two spans; 0 if they overlap."""
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0))


def nearest(entity: Column, quantities: Column, most: int = MAX_DISTANCE) -> Column:
    """The nearest quantity of the block within `most` characters, the earlier of two; null without one."""
    measured = F.transform(quantities, lambda m: F.struct(distance(entity["start"], entity["end"], m["start"], m["end"]).alias("distance"), m["start"].alias("start"), m["value"].alias("value"), m["unit"].alias("unit"), m["text"].alias("text"), m["end"].alias("end")))
    return F.array_min(F.filter(measured, lambda m: m["distance"] <= most))


ENTITIES = "array<struct<text:string,start:int,end:int,label:string,confidence:double>>"


def model_entities(text: Column, model: Callable[[], Callable[[str], list[dict]]], labels: dict[str, str]) -> Column:
    """Entities by a model plug-in, in Arrow batches: model() makes in each Python worker, once for all its batches, a
    function from a text to dicts of text, start, end, label and score; labels: what of a model's labels counts, and
    as what. Others are dropped; entities come in order of place."""

    @F.pandas_udf(ENTITIES)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = model()

        def one(t: str | None) -> list[dict]:
            found = [e for e in predict(t) if e["label"] in labels] if t else []
            return [{"text": e["text"], "start": int(e["start"]), "end": int(e["end"]), "label": labels[e["label"]], "confidence": float(e.get("score", 1.0))} for e in sorted(found, key=lambda e: (e["start"], e["end"]))]

        for part in parts:
            yield part.map(one, na_action=None)

    return run(text)


def mentions(blocks: DataFrame, terms: dict[str, list[str]] = TERMS, model: Callable[[Column], Column] | None = None, labels: list[str] | None = None, since: str | None = None) -> DataFrame:
    """A row for each entity of each block, precursors with their nearest concentration and mass; quantities are sought
    only in blocks with an entity, within the row. model: a function from the text column to entities in place of the
    vocabulary (entities, greedy_entities or model_entities). labels: those wanted, among the entities that all labels
    give. since: a column of blocks, the first place that counts (null: none)."""
    found = model(F.col("text")) if model else entities(F.col("text"), terms)
    counts = lambda x: F.lit(True) if since is None else x["start"] >= F.col(since)
    if labels is not None or since is not None:
        found = F.filter(found, lambda e: counts(e) & (e["label"].isin(labels) if labels is not None else F.lit(True)))
    linking = labels is None or "PRECURSOR" in labels
    quantities = amounts(F.col("text")) if linking else F.lit(0)
    if linking and since is not None:
        quantities = let(quantities, lambda q: F.struct(F.filter(q["c"], counts).alias("c"), F.filter(q["m"], counts).alias("m")))
    unlinked = F.lit(None).cast("struct<distance:int,start:int,value:double,unit:string,text:string,end:int>")

    def linked(e: Column, q: Column) -> Column:
        link = lambda kind: F.when(e["label"] == "PRECURSOR", nearest(e, q[kind])) if linking else unlinked
        return F.struct(e.alias("e"), link("c").alias("concentration"), link("m").alias("amount"))

    # one expression: as columns, the optimizer would compute entities once for each use
    every = let(found, lambda es: F.when(F.size(es) > 0, let(quantities, lambda q: F.transform(es, lambda e: linked(e, q)))))
    rows = blocks.where(F.length("text") > 0).select(*BLOCK, "page", "section", F.explode(every).alias("x"))
    return rows.select(*BLOCK, "page", "section", "x.e.*", "x.concentration", "x.amount")


def first_mentions(mention_rows: DataFrame) -> DataFrame:
    """Mentions that count: the first material and the first solvent of a document, and of precursors and techniques the
    first of each name (lower case), with item_idx by order of first appearance. Later mentions fill in nothing."""
    name = F.when(F.col("label").isin("MATERIAL", "SOLVENT"), F.lit("")).otherwise(F.lower("text"))
    place = Window.partitionBy("paper_id", "version", "label", name).orderBy("block_ordinal", "start")
    first = mention_rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")
    order = Window.partitionBy("paper_id", "version", "label").orderBy("block_ordinal", "start")
    return first.withColumn("item_idx", F.row_number().over(order) - 1)


#: Which label a fact's key is of.
KEYS = {"precursors.name": "PRECURSOR", "precursors.concentration": "PRECURSOR", "precursors.amount": "PRECURSOR", "characterization.technique": "CHARACTERIZATION", "solvent": "SOLVENT", "material.name": "MATERIAL"}


def facts(first_rows: DataFrame, extractor_version: str = "ner@1") -> DataFrame:
    """Facts of first_mentions: names with confidence 1.0, linked quantities with 0.85."""
    many = F.col("label").isin("PRECURSOR", "CHARACTERIZATION")
    stem = F.when(F.col("label") == "PRECURSOR", "precursors").when(F.col("label") == "CHARACTERIZATION", "characterization").when(F.col("label") == "SOLVENT", "solvent").otherwise("material")
    suffix = F.when(F.col("label").isin("PRECURSOR", "MATERIAL"), ".name").when(F.col("label") == "CHARACTERIZATION", ".technique").otherwise("")
    at = F.when(many, F.concat(F.lit("["), F.col("item_idx"), F.lit("]"))).otherwise(F.lit(""))
    quantity = lambda q: F.when(F.col(q).isNotNull(), F.struct(F.concat(stem, at, F.lit(f".{q}")).alias("field"), F.concat(stem, F.lit(f".{q}")).alias("field_key"), F.col(f"{q}.value").alias("value_num"), F.col(f"{q}.unit").alias("value_unit"), F.lit(None).cast("string").alias("value_str"), F.lit(0.85).alias("confidence"), F.col(f"{q}.text").alias("evidence_text"), F.col(f"{q}.start").alias("char_start"), F.col(f"{q}.end").alias("char_end")))
    named = F.struct(F.concat(stem, at, suffix).alias("field"), F.concat(stem, suffix).alias("field_key"), F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_unit"), F.col("text").alias("value_str"), F.lit(1.0).alias("confidence"), F.col("text").alias("evidence_text"), F.col("start").alias("char_start"), F.col("end").alias("char_end"))
    every = F.array_compact(F.array(named, quantity("concentration"), quantity("amount")))
    rows = first_rows.select(*BLOCK, "page", "section", F.when(many, F.col("item_idx")).alias("item_idx"), F.explode(every).alias("f"))
    return rows.select(*BLOCK, "page", "section", "item_idx", "f.*", F.lit("NER").alias("source"), F.lit(extractor_version).alias("extractor_version"))
