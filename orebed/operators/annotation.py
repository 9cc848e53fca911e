"""Annotations: paths of nested payloads, agreement, adjudication, splits and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from . import schema

#: Top-level keys of a payload that aren't annotated.
IDENTITY = ("paper_id", "schema_version")
#: Levels that are opened within a row before its parts become rows.
STRIDE = 6


def nesting(payload: Column) -> Column:
    """How deep lists and objects stand in one another in a JSON text; 0 for a value alone."""
    bare = F.regexp_replace(payload, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, m: Column) -> Column:
        now = a["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda a: a["most"])


def flatten(payloads: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """A row for each leaf of a JSON payload (a string): by columns, path (a.b[0].c), value (JSON text), present. A JSON
    null is a leaf with a null value; empty lists and objects vanish; a null payload has no leaves.

    Any depth: a first pass finds the deepest payload (one number comes back). Levels open one after another within the row,
    STRIDE of them before the parts become rows of their own; nothing is shuffled."""

    def children(x: Column, first: bool) -> Column:
        v, path = x["v"], x["path"]
        members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        if first:
            members = F.filter(members, lambda m: ~m["key"].isin(*IDENTITY))
        named = F.transform(members, lambda m: F.struct(F.when(path == "", m["key"]).otherwise(F.concat(path, F.lit("."), m["key"])).alias("path"), m["value"].alias("v")))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda y, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), y.alias("v")))
        return let(F.schema_of_variant(v), lambda t: F.when(t.startswith("OBJECT"), named).when(t.startswith("ARRAY"), listed).otherwise(F.array(x)))

    depth = payloads.agg(F.max(nesting(F.col(payload)))).first()[0] or 0
    rows = payloads.where(F.col(payload).isNotNull()).select(*by, F.struct(F.lit("").alias("path"), F.parse_json(F.col(payload)).alias("v")).alias("leaf"))
    for start in range(0, depth, STRIDE):
        open_ = F.array("leaf")
        for level in range(start, min(depth, start + STRIDE)):
            open_ = F.flatten(F.transform(open_, (lambda x: children(x, True)) if level == 0 else (lambda x: children(x, False))))
        rows = rows.select(*by, F.explode(open_).alias("leaf"))
    text = F.when(~F.schema_of_variant(F.col("leaf.v")).isin("VOID"), F.to_json(F.col("leaf.v")))
    return rows.select(*by, "leaf.path", text.alias("value"), F.lit(True).alias("present"))


def compare(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Both annotators' leaves side by side: by, path, in_a, in_b, value_a, value_b."""
    left = a.select(*by, "path", F.lit(True).alias("in_a"), F.col("value").alias("value_a"))
    right = b.select(*by, "path", F.lit(True).alias("in_b"), F.col("value").alias("value_b"))
    return left.join(right, [*by, "path"], "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_a", "in_b")})


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """paths, agreed, rate and kappa of presence; a missing path and an explicit null disagree."""
    same = F.col("in_a") & F.col("in_b") & F.col("value_a").eqNullSafe(F.col("value_b"))
    counted = pairs.groupBy(*by).agg(F.count("*").alias("paths"), F.sum(same.cast("long")).alias("agreed"), *kappa_parts(F.col("in_a"), F.col("in_b")))
    return counted.withColumn("rate", F.col("agreed") / F.col("paths")).withColumn("kappa", kappa()).drop("po", "pa", "pb")


def kappa_parts(a: Column, b: Column) -> list[Column]:
    share = lambda c: F.avg(c.cast("double"))
    return [share(a == b).alias("po"), share(a).alias("pa"), share(b).alias("pb")]


def kappa() -> Column:
    """Cohen's kappa of two binary raters from po, pa and pb; with expected agreement 1: 1 if all agree, else 0."""
    po, pe = F.col("po"), F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def adjudicate(pairs: DataFrame, overrides: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Resolved leaves (by, path, value) and those left open: an override wins, equal values stay, a missing path equals a
    null. overrides: by, path, value."""
    o = overrides.select(*by, "path", F.col("value").alias("value_o"), F.lit(True).alias("in_o"))
    rows = pairs.join(o, [*by, "path"], "left")
    own, same = F.coalesce("in_o", F.lit(False)), F.col("value_a").eqNullSafe(F.col("value_b"))
    resolved = rows.where(own | same).select(*by, "path", F.when(own, F.col("value_o")).otherwise(F.col("value_a")).alias("value"))
    return resolved, rows.where(~own & ~same).select(*by, "path", "value_a", "value_b")


def adjudicate_strictly(pairs: DataFrame, overrides: DataFrame, by: list[str], shown: int = 100) -> DataFrame:
    """Resolved leaves; an error that names open ones (and how many there are) if any are left."""
    resolved, left = adjudicate(pairs, overrides, by)
    some = left.select(*by, "path").orderBy(*by, "path").limit(shown).collect()
    if some:
        raise ValueError(f"{left.count()} unresolved paths: " + ", ".join("/".join(map(str, r)) for r in some))
    return resolved


def gold_facts(resolved: DataFrame, by: list[str], annotator: str) -> DataFrame:
    """One human fact with confidence 1 for each path with a value; version gold@annotator."""
    return resolved.where("value is not null").select(*by, F.col("path").alias("field"), "value", F.lit("HUMAN").alias("source"), F.lit(1.0).alias("confidence"), F.lit(f"gold@{annotator}").alias("extractor_version"))


def gold_results(pairs: DataFrame, overrides: DataFrame, by: list[str], annotator: str, kind: schema.Kind = schema.SYNTHESIS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adjudicated gold: results (by, extractor HUMAN, extractor_version gold@annotator, payload), their facts, and payloads
    that don't fit the schema, with errors (path, reason). Open disagreements are an error that names them."""
    resolved = adjudicate_strictly(pairs, overrides, by)
    payloads = unflatten(resolved, by).withColumn("errors", schema.faults(F.col("payload"), kind))
    fits = F.size("errors") == 0
    results = payloads.where(fits).select(*by, F.lit("HUMAN").alias("extractor"), F.lit(f"gold@{annotator}").alias("extractor_version"), "payload")
    facts = gold_facts(resolved, by, annotator).join(results.select(*by), by, "left_semi").withColumn("evidence_text", F.lit("human annotation (adjudicated)"))
    return results, facts, payloads.where(~fits)


def unflatten(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Nested payloads (JSON text, keys in order) of flat paths (by, path, value), a row for each group; gaps in lists become
    null, and so does a path without a value.

    The deepest level folds into the one above it, level by level. Rows are dealt by group once; every level's sums keep
    that, so there is one shuffle whatever the depth. A list as long as its largest index is made in its row."""
    names = [F.col(c) for c in by]
    rows = resolved.select(*by, F.regexp_extract_all("path", F.lit(r"[^.\[\]]+|\[\d+\]"), F.lit(0)).alias("steps"), F.coalesce("value", F.lit("null")).alias("text"))
    depth = rows.agg(F.max(F.size("steps"))).first()[0] or 0
    rows = rows.repartition(*names)
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    index = lambda k: F.regexp_extract(k["step"], r"\d+", 0).cast("int")
    for level in range(depth, 0, -1):
        mine = F.size("steps") == level
        key = F.when(mine, F.slice("steps", 1, level - 1)).otherwise(F.col("steps"))
        kid = F.when(mine, F.struct(F.element_at("steps", -1).alias("step"), "text"))
        made = rows.groupBy(*by, key.alias("key")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.max(F.when(~mine, F.col("text"))).alias("own"))
        object_ = F.concat(F.lit("{"), F.array_join(F.transform("kids", lambda k: F.concat(quoted(k["step"]), F.lit(": "), k["text"])), ", "), F.lit("}"))
        placed = F.map_from_entries(F.transform("kids", lambda k: F.struct(index(k), k["text"])))
        longest = F.array_max(F.transform("kids", index))
        list_ = let(placed, lambda m: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), longest), lambda i: F.coalesce(F.try_element_at(m, i), F.lit("null"))), ", "), F.lit("]")))  # noqa: B023
        listed = F.forall("kids", lambda k: k["step"].startswith("["))
        rows = made.select(*by, F.col("key").alias("steps"), F.when(F.size("kids") == 0, F.col("own")).when(listed, list_).otherwise(object_).alias("text"))
    return rows.select(*by, F.col("text").alias("payload"))


def split(papers: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """paper_id and is_test: the first max(1, n * fraction rounded half to even) distinct papers by sha256 of seed and id.
    The threshold comes from counts by hash prefix, so that no task orders all papers."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    ids = papers.select("paper_id").distinct().withColumn("h", F.sha2(F.concat(F.lit(str(seed)), F.col("paper_id").cast("string")).cast("binary"), 256))
    ids = ids.withColumn("prefix", F.substring("h", 1, 3))
    counts = sorted(ids.groupBy("prefix").count().collect())  # 4096 rows at most
    total, before, edge, rest = sum(n for _, n in counts), 0, "", 0
    wanted = max(1, round(total * fraction)) if total else 0
    for prefix, n in counts:
        if before + n >= wanted:
            edge, rest = prefix, wanted - before
            break
        before += n
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("h", "paper_id"))
    at_edge = ids.where(F.col("prefix") == edge).withColumn("n", place).select("paper_id", (F.col("n") <= rest).alias("is_test"))
    return ids.where(F.col("prefix") != edge).select("paper_id", (F.col("prefix") < edge).alias("is_test")).unionByName(at_edge)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key of both tables, by order; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    place = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n", "__new")
