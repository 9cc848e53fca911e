"""Names to canonical entities, merging of synonyms, and links to registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import aliases, entities, normalize_name
from ..functions.text import hashed_index, hashed_sign, tokens
from ..sources.tables import written

DOC = ["paper_id", "version"]
THRESHOLD = 0.6


def sparse_vector(text: Column, dims: int = 256) -> Column:
    """A unit vector as a map of component to value: hashed tokens, signed, summed; empty for a zero vector."""
    parts = F.transform(tokens(text), lambda t: F.struct(hashed_index(t, dims).alias("i"), hashed_sign(t).alias("v")))
    keys = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["i"])))
    values = F.transform(keys, lambda k: F.aggregate(F.filter(parts, lambda p: p["i"] == k), F.lit(0.0), lambda s, p: s + p["v"]))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.map_from_arrays(keys, F.transform(values, lambda v: v / norm))).otherwise(F.create_map().cast("map<int,double>"))


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0)))


def match_names(names: DataFrame, name: str = "name", threshold: float = THRESHOLD, fallback: bool = True, dims: int = 256) -> DataFrame:
    """names with canonical_id, canonical_name, cas_number, match_confidence, match_method: by alias (1.0), else by the
    cosine of hashed tokens with the canonical names, the first of equals, from threshold up. The entity table has a
    fixed size and is broadcast; only distinct names without an alias are compared with it. With the fallback, names are
    read twice; so they are written first, and what they come from is computed once."""
    spark = names.sparkSession
    exact = names.withColumn("__key", normalize_name(F.col(name))).join(F.broadcast(aliases(spark)), F.col("__key") == F.col("alias"), "left")
    exact = exact.withColumn("match_confidence", F.when(F.col("canonical_id").isNotNull(), F.lit(1.0))).withColumn("match_method", F.when(F.col("canonical_id").isNotNull(), F.lit("exact_alias"))).drop("alias")
    if not fallback:
        return exact.drop("__key")
    exact = written(exact, "names")
    vectors = entities(spark).select(F.col("canonical_id").alias("__id"), F.col("canonical_name").alias("__name"), F.col("cas_number").alias("__cas"), sparse_vector(F.col("canonical_name"), dims).alias("__v"))
    order = {e[0]: i for i, e in enumerate(_ids())}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("__id"))
    table = F.broadcast(vectors.agg(F.collect_list(F.struct(rank.alias("__rank"), "__id", "__name", "__cas", "__v")).alias("__all")))  # one row
    rest = exact.where("canonical_id is null and __key is not null").select(F.col("__key").alias("__k")).distinct().join(table)
    scored = rest.withColumn("__own", sparse_vector(F.col("__k"), dims))
    best = F.array_max(F.transform("__all", lambda e: F.struct(sparse_dot(scored["__own"], e["__v"]).alias("__score"), (-e["__rank"]).alias("__minus"), e["__id"].alias("__id"), e["__name"].alias("__n"), e["__cas"].alias("__cas_number"))))
    near = scored.select("__k", best.alias("__b")).where(F.col("__b.__score") >= threshold).select("__k", "__b.*")
    both = exact.join(near, F.col("__key") == F.col("__k"), "left")
    own = [c for c in exact.columns if c not in ("__key", "canonical_id", "canonical_name", "cas_number", "match_confidence", "match_method")]
    hit = F.col("canonical_id").isNull() & F.col("__id").isNotNull()
    return both.select(*own, F.coalesce("canonical_id", "__id").alias("canonical_id"), F.coalesce("canonical_name", "__n").alias("canonical_name"), F.coalesce("cas_number", "__cas_number").alias("cas_number"), F.coalesce("match_confidence", "__score").alias("match_confidence"), F.when(hit, F.lit("embedding")).otherwise(F.col("match_method")).alias("match_method"))


def _ids() -> list[tuple]:
    from ..functions.tables import ENTITIES

    return ENTITIES


def merge_precursors(matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """matched: paper_id, version, item_idx, name, concentration, amount and the columns of match_names. The merged
    precursors, in order of first appearance (merged_idx), and a fact for each row that was merged into an earlier one.
    A later mention fills in quantities that are missing so far."""
    key = F.coalesce("canonical_id", F.lower(F.trim("name")))
    rows = matched.withColumn("key", key)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("item_idx"))).alias(c)
    merged = rows.groupBy(*DOC, "key").agg(
        F.min("item_idx").alias("first_idx"),
        F.min_by(F.coalesce("canonical_name", "name"), "item_idx").alias("name"),
        F.min_by("canonical_id", "item_idx").alias("canonical_id"),
        first("concentration"),
        first("amount"),
        F.count("*").alias("mentions"),
    )
    merged = merged.withColumn("merged_idx", F.row_number().over(Window.partitionBy(*DOC).orderBy("first_idx")) - 1)
    later = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*DOC, "key").orderBy("item_idx"))).where("__n > 1")
    said = later.select(*DOC, "key", "item_idx", F.col("name").alias("merged_name"), F.coalesce("match_confidence", F.lit(0.5)).alias("confidence"))
    return merged, said


def normalize_scalars(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """predictions (a row for each document, with strings material and solvent) with both under their canonical names and
    material_id; a solvent gets no id. Names without a match stay as they are, nulls too."""
    kept = [c for c in predictions.columns if c != "material_id"]
    own = lambda of, name, *more: of.select(*[F.coalesce("canonical_name", name).alias(name) if c == name else F.col(f"`{c}`") for c in kept], *more)
    matched = own(match_names(predictions.select(*[F.col(f"`{c}`") for c in kept]), "material", threshold), "material", F.col("canonical_id").alias("material_id"))
    kept = matched.columns
    return own(match_names(matched, "solvent", threshold), "solvent")


def external_links(names: DataFrame, client: Callable[[], Callable[[str], list[str]]], system: str = "PubChem", name: str = "canonical_name") -> DataFrame:
    """Each different name once, with system, identifier (the first that the service has; null without one) and link_error.
    client() makes in each Python worker a function from a name to identifiers; a failed call leaves its name unlinked."""

    def run(frames):
        import pandas as pd

        call = client()
        for f in frames:
            got = []
            for n in f[name]:
                try:
                    ids = call(n)
                    got.append((str(ids[0]) if ids else None, None))
                except Exception as e:
                    got.append((None, str(e)))
            yield pd.DataFrame({name: f[name], "system": system, "identifier": [g[0] for g in got], "link_error": [g[1] for g in got]})

    rows = names.select(name).where(F.col(name).isNotNull()).distinct()
    return rows.mapInPandas(run, f"`{name}` string, system string, identifier string, link_error string")


def cas_links(matched: DataFrame) -> DataFrame:
    """paper_id, version, canonical_id, cas_number: once for each entity of a document that has a number."""
    return matched.where("canonical_id is not null and cas_number is not null").groupBy(*DOC, "canonical_id").agg(F.min("cas_number").alias("cas_number"), F.min("item_idx").alias("first_idx"))


def normalized_version(version: Column) -> Column:
    return F.concat(version, F.lit("+normalized"))
