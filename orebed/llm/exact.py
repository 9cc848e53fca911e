"""Exact dedup by progressive refinement: lengths, then hashes of beginnings, then hashes of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Code points of a normalised text that its beginning's hash covers.
PREFIX = 256
#: Numbers of 64 slots each: a filter of groups has a row for each at most, so it can always be broadcast.
FILTER_ROWS = 1 << 20
#: A group with more than this share of the surviving rows is a heavy one; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000


def normalised(text: Column) -> Column:
    """text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\v\f\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _shared_slots(rows: DataFrame, slot: Column) -> DataFrame:
    """Slots that several rows fall into: word (slot div 64) and bits (one for each such slot), FILTER_ROWS rows at most."""
    many = rows.groupBy(slot.alias("slot")).count().where("count > 1")
    return many.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))


def _in_slots(rows: DataFrame, slots: DataFrame, slot: Column, name: str) -> DataFrame:
    """rows with a column `name`: whether slot is one of the slots."""
    word, bits = f"{name}_word", f"{name}_bits"
    known = F.broadcast(slots.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    at = rows.withColumn(name, slot)
    joined = at.join(known, F.expr(f"{name} div 64") == F.col(word), "left")
    return joined.withColumn(name, F.coalesce(F.expr(f"shiftright({bits}, cast({name} % 64 as int)) & 1") == 1, F.lit(False))).drop(word, bits)


def exact_groups(documents: DataFrame, carry: list[str] | None = None, prefix: int = PREFIX) -> DataFrame:
    """Groups of equal texts: a row for each row of documents (doc_id, text), with keep_id, group_size, kept and the
    columns of carry. Texts are equal if their normalised forms are.

    1. One pass over the texts leaves two numbers a row: the normalised length and a hash of its first `prefix` characters.
       Lengths that one row alone has are out, then beginnings (with their length) that one row alone has.
    2. A second pass reads whole texts, to hash them (SHA-256), of the rows whose length and beginning are shared. What is
       shared comes to it as a filter of 2^26 slots in FILTER_ROWS rows, so its broadcast has a fixed bound; a slot may let
       a row pass that is alone, which costs a hash and changes no result (at far more rows than slots most rows pass).
    3. Length, beginning and whole hash group the rows that passed, summed before the shuffle. Groups with over a
       thousandth of these rows (fewer than a thousand groups) are broadcast to their rows; the others meet theirs by
       shuffle, so no task holds a hot group.

    Of a group the row with the most code points in its text stays, then the smallest doc_id (null last), then one of the
    equal rows; repeated rows each have a row. Null texts and texts of white space alone are empty, and equal. Empty
    tables give no rows. Other columns take no part and may have any name."""
    spark = documents.sparkSession
    carry = carry or []
    scratch = Scratch(spark, "exact")
    slots = FILTER_ROWS * 64
    length, begins = F.char_length("norm"), F.xxhash64(F.substring("norm", 1, prefix))
    bare = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("string").alias("carried"))
    texts = bare.withColumn("norm", normalised(F.col("text")))

    keys = scratch.save(texts.select(length.alias("length"), begins.alias("begins")), "keys")
    by_length = F.col("length").cast("long") % slots
    by_begin = F.pmod(F.xxhash64("length", "begins"), F.lit(slots))
    lengths = scratch.save(_shared_slots(keys, by_length), "lengths")
    open_ = _in_slots(keys, lengths, by_length, "same").where("same").drop("same")
    beginnings = scratch.save(_shared_slots(open_, by_begin), "beginnings")
    scratch.drop("keys")

    rows = texts.withColumns({"length": length, "begins": begins, "points": F.coalesce(F.char_length("text"), F.lit(0))})
    rows = _in_slots(_in_slots(rows, lengths, by_length, "same"), beginnings, by_begin, "alike")
    whole = F.when(F.col("same") & F.col("alike"), F.unhex(F.sha2("norm", 256)))
    rows = rows.select("doc_id", "carried", "length", "begins", "points", whole.alias("whole"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    key = ["length", "begins", "whole"]
    passed = rows.where("whole is not null")
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = passed.groupBy(*key).agg(F.count("*").alias("group_size"), first.alias("first")).where("group_size > 1")
    groups = scratch.save(groups.select(*key, "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    heavy = F.col("group_size") > HEAVY * passed.count()
    found = passed.join(F.broadcast(groups.where(heavy)), key, "left")
    light = found.where("group_size is null").drop("group_size", "keep_id", "keep_row").join(groups.where(~heavy), key, "left")

    alone = rows.where("whole is null").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id"), "keep_row": F.col("row")})
    every = alone.unionByName(found.where("group_size is not null")).unionByName(light)
    every = every.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        *[F.col(f"carried.`{c}`").alias(c) for c in carry],
    )
    return every
