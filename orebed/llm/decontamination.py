"""Benchmark decontamination by SimHash fingerprints of item-sized windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, counted_broadcast, let, partitions

#: Shingles of all items up to which their set is part of the plan; beyond, documents are joined with them.
MOST_LITERALS = 100_000
BITS, BLOCKS = 64, 4


def _words(text: Column) -> Column:
    """Letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.array_size(words) - size + 1), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(size)]))
    return F.when(F.array_size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _shingles(text: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order; of the whole if it has fewer words; none without words."""

    def of(w: Column) -> Column:
        out = F.when(F.array_size(w) >= size, _runs(w, size))
        for n in range(1, size):
            out = out.when(F.array_size(w) == n, _runs(w, n))
        return out.otherwise(F.array().cast("array<bigint>"))

    return let(_words(text), of)


def _short(text: Column, size: int) -> Column:
    return let(_words(text), lambda w: _runs(w, size))


def _fingerprint(shingles: Column, weights: Column) -> Column:
    """64-bit SimHash of weighted shingles; weights: a map, 1 for what it lacks."""
    weighted = F.transform(shingles, lambda h: F.struct(h.alias("h"), F.coalesce(F.element_at(weights, h), F.lit(1.0)).alias("w")))
    signs = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(_vote(weighted, b) >= 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.transform(signs, lambda s, i: F.call_function("shiftleft", s, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _vote(weighted: Column, b: Column) -> Column:
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.when(F.call_function("shiftright", x["h"], b).bitwiseAND(F.lit(1).cast("long")) == 1, x["w"]).otherwise(-x["w"]))


def _similarity(a: Column, b: Column, weights: Column) -> Column:
    """Weighted Jaccard similarity of two shingle sets."""
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda t, h: t + F.coalesce(F.element_at(weights, h), F.lit(1.0)))
    return total(F.array_intersect(a, b)) / total(F.array_union(a, b))


def items_of(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, shingles (in order), n (their number), words (in a shingle: fewer than size if the item has fewer), weights:
    a shingle of k items weighs 1 / k."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", _shingles(F.col("text"), size).alias("shingles"), F.least(F.array_size(_words(F.col("text"))), F.lit(size)).alias("words")).where(F.size("shingles") > 0).dropDuplicates()
    held = items.select(F.explode(F.array_distinct("shingles")).alias("h"), "item_id", F.xxhash64("shingles").alias("s"))
    weight = held.groupBy("h").agg((F.lit(1.0) / F.countDistinct("item_id")).alias("w"))
    maps = held.join(weight, "h").groupBy("item_id", "s").agg(F.map_from_entries(F.collect_list(F.struct("h", "w"))).alias("weights"))
    return items.withColumn("s", F.xxhash64("shingles")).join(maps, ["item_id", "s"]).select("item_id", "s", "shingles", F.array_size("shingles").alias("n"), "words", "weights")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that name a row by its id and its text, nulls too."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")]


def found(documents: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """leaks() with the key of the row (k1, k2), in a written table."""
    scratch = Scratch(documents.sparkSession, "leaks")
    items = scratch.save(items_of(benchmark, shingle_words), "items")
    index = scratch.save(items.select("item_id", "s", "n", "words", F.explode("weights").alias("h", "w")), "index")
    known = [r[0] for r in index.select("h").distinct().limit(MOST_LITERALS + 1).collect()]
    sizes = sorted(r[0] for r in items.select("words").distinct().collect())  # shingle_words numbers at most
    rows = None
    for size in sizes or [shingle_words]:
        own = documents.select("doc_id", "text", F.lit(size).alias("words"), _short(F.col("text"), size).alias("own"))
        rows = own if rows is None else rows.unionByName(own)
    # 1. where shingles of items stand
    if len(known) <= MOST_LITERALS:
        hits = F.filter(F.transform("own", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isin(known)) if known else F.array().cast("array<struct<i:int,h:bigint>>")
        hit = rows.withColumn("hits", hits).where(F.size("hits") > 0).select("doc_id", *_row_key(F.col("doc_id"), F.col("text")), "words", F.array_size("own").alias("m"), F.explode("hits").alias("x")).select("doc_id", "k1", "k2", "words", "m", "x.*")
    else:
        hit = rows.select("doc_id", *_row_key(F.col("doc_id"), F.col("text")), "words", F.array_size("own").alias("m"), F.posexplode("own").alias("i", "h"))
    # 2. windows with enough of an item's weight, by votes of the places for all windows that hold them
    total = items.select("item_id", "s", F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x).alias("total"))
    voted = hit.join(counted_broadcast(index), ["words", "h"]).select("doc_id", "k1", "k2", "words", "m", "item_id", "s", "n", "i", "w").distinct()
    by = ["k1", "k2", "words", "item_id", "s"]
    enough = similarity * (1 - 1e-9)
    some = scratch.save(voted, "votes")
    held = some.groupBy(*by).agg(F.sum("w").alias("sum")).join(total, ["item_id", "s"]).where(F.col("sum") >= enough * F.col("total")).select(*by, "total")
    voting = some.join(held, by)
    last = F.greatest(F.col("m") - F.col("n"), F.lit(0))
    spread = voting.select("doc_id", *by, "n", "total", "w", F.explode(F.sequence(F.least(F.greatest(F.col("i") - F.col("n") + 1, F.lit(0)), last), F.least(F.col("i"), last))).alias("start"))
    starts = spread.groupBy(*by, "n", "start").agg(F.first("doc_id").alias("doc_id"), F.sum("w").alias("votes"), F.first("total").alias("total")).where(F.col("votes") >= enough * F.col("total"))
    starts = scratch.save(starts.select("doc_id", *by, "n", "start"), "starts")
    # 3. these windows, from the rows that hold them
    wanted = scratch.save(starts.select("k1", "k2", "words").distinct(), "wanted")
    keyed = documents.select("text", *_row_key(F.col("doc_id"), F.col("text"))).join(counted_broadcast(wanted), ["k1", "k2"]).dropDuplicates(["k1", "k2", "words"])
    of_size = F.array().cast("array<bigint>")
    for size in sizes:
        of_size = F.when(F.col("words") == size, _short(F.col("text"), size)).otherwise(of_size)
    keyed = keyed.select("k1", "k2", "words", of_size.alias("own"))
    cut = keyed.join(starts.select("k1", "k2", "words", "n", "start").distinct(), ["k1", "k2", "words"]).select("k1", "k2", "words", "n", "start", F.expr("slice(own, start + 1, n)").alias("window"))
    windows = scratch.save(cut.withColumn("content", F.xxhash64("window")), "windows")
    # 4. fingerprints in blocks: every pair within the radius, and what only votes have found
    no_weights = F.create_map().cast("map<bigint,double>")
    ones = windows.groupBy("words", "n", "content").agg(F.first("window").alias("window"))
    # few bytes, much work: dealt to all tasks
    prints = scratch.save(ones.repartition(partitions(documents.sparkSession), "content").withColumn("print", _fingerprint(F.col("window"), no_weights)), "prints")
    marks = scratch.save(items.withColumn("item_print", _fingerprint(F.col("shingles"), no_weights)), "marks")
    part = lambda p, b: F.call_function("shiftrightunsigned", p, F.lit(16 * b)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    near = [m for m in range(1 << 16) if m.bit_count() <= radius // BLOCKS]
    masks = F.from_json(F.lit(str(near)), "array<bigint>")
    stored = marks.select("item_id", "s", "words", "n", F.posexplode(F.array(*[part(F.col("item_print"), b) for b in range(BLOCKS)])).alias("block", "value")).select("item_id", "s", "words", "n", "block", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
    probes = prints.select("words", "n", "content", F.posexplode(F.array(*[part(F.col("print"), b) for b in range(BLOCKS)])).alias("block", "value"))
    # many rows for each item: never broadcast
    pairs = probes.join(stored.hint("merge"), ["words", "n", "block", "value"]).select("words", "n", "content", "item_id", "s")
    by_votes = starts.join(windows.select("k1", "k2", "words", "n", "start", "content"), ["k1", "k2", "words", "n", "start"]).select("words", "n", "content", "item_id", "s")
    pairs = scratch.save(pairs.unionByName(by_votes).distinct(), "pairs")
    # 5. full sets decide
    full = pairs.join(prints, ["words", "n", "content"]).join(marks.select("item_id", "s", "shingles", "weights", "item_print"), ["item_id", "s"])
    full = full.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    full = full.withColumn("similarity", _similarity(F.col("window"), F.col("shingles"), F.col("weights"))).where(F.col("similarity") >= similarity)
    sure = scratch.save(full.select("words", "n", "content", "item_id", "distance", "similarity"), "sure")
    at = windows.select("k1", "k2", "words", "n", "start", "content").join(sure, ["words", "n", "content"])
    best = F.max_by(F.struct("similarity", "distance", "start", "n"), F.struct("similarity", -F.col("start"))).alias("b")
    out = at.groupBy("k1", "k2", "item_id").agg(best).join(starts.select("k1", "k2", "doc_id").distinct(), ["k1", "k2"])
    return scratch.save(out.select("k1", "k2", "doc_id", "item_id", "b.similarity", "b.distance", F.col("b.start").alias("first_shingle"), F.col("b.n").alias("n_shingles")), "found")


def leaks(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Items that documents hold, a row for each (doc_id, item_id): similarity (the best window's; of equals the first),
    distance (of its fingerprint), first_shingle (the window's first word, from 0), n_shingles (of the item).

    Windows have as many shingles as the item; a shorter text is one window. All windows of a text that can reach
    `similarity` are taken: each place of an item's shingle votes with its weight for all windows that hold it, and a
    window with less than `similarity` of the item's weight can't reach it. Their 64-bit fingerprints are cut into 4
    blocks of 16 bits; within `radius` bits some block differs in radius // 4 bits at most, so the items' blocks are
    stored with all such changes, and a join on equal blocks finds every pair within the radius. A window and the item
    that it was voted for are a pair too, so that nothing beyond the radius is lost. Pairs are held against
    `similarity` (weighted Jaccard; a shingle of k items weighs 1 / k) on full sets. An item of fewer than
    `shingle_words` words is sought as one shingle of its length. Equal windows are compared once.

    Words are letters and digits, lower case. Null and empty texts, and items without words, have no leaks; whole texts
    count, of any length. Null doc_ids come back as null; an item with a null item_id is no item. Repeated rows (equal
    doc_id and text) give one row; rows of one doc_id with several texts the best window of them all. Empty tables: no
    rows. Other columns take no part."""
    best = F.max_by(F.struct("similarity", "distance", "first_shingle", "n_shingles"), F.struct("similarity", -F.col("first_shingle"))).alias("b")
    return found(documents, benchmark, **how).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """documents without the rows whose text holds an item of the benchmark: with any doc_id, null too, and those rows
    only, whatever else shares their doc_id. All other rows, repeated ones too, and all columns stay as they are."""
    scratch = Scratch(documents.sparkSession, "clean")
    bad = scratch.save(found(documents, benchmark, **how).select("k1", "k2").distinct(), "bad")
    bad = counted_broadcast(bad)
    k1, k2 = (F.xxhash64(F.col("doc_id"), F.col("text")), F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id")))
    return documents.join(bad, (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")
