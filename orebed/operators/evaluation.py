"""Predictions against gold: units, statuses, precision and recall at three levels, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import CANONICAL, look_up

SCALARS = ["solvent", "synthesis_method", "material.name", "temperature", "reaction_time", "pH"]


def dimension(unit: Column) -> Column:
    return F.when(unit.isin("C", "K", "F"), F.lit("temperature")).otherwise(look_up({u: d for u, d, _ in CANONICAL}, unit))


def to_canonical(value: Column, unit: Column) -> Column:
    """The value in kelvin, seconds, molar, grams or litres; null for other units."""
    out = F.when(unit == "C", value + 273.15).when(unit == "K", value).when(unit == "F", (value - 32) * 5 / 9 + 273.15)
    return out.otherwise(value * look_up({u: repr(f) for u, _, f in CANONICAL}, unit).cast("double"))


def quantities_equal(value_a: Column, unit_a: Column, value_b: Column, unit_b: Column, relative: float = 1e-3, absolute: float = 1e-9) -> Column:
    """Equal in one dimension within max(relative * the larger, absolute); never with an unknown unit or a null."""
    a, b = to_canonical(value_a, unit_a), to_canonical(value_b, unit_b)
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))
    return F.coalesce((dimension(unit_a) == dimension(unit_b)) & near, F.lit(False))


def status(pred_present: Column, gold_present: Column, equal: Column) -> Column:
    return F.when(~pred_present & ~gold_present, "both_absent").when(~gold_present, "spurious").when(~pred_present, "missing").when(equal, "correct").otherwise("incorrect")


def _pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """paper_id and the scalar parts of both sides, p and g, for papers on both."""
    side = lambda rows, name: rows.select("paper_id", F.struct("solvent", "synthesis_method", F.col("material.name").alias("name"), "temperature", "reaction_time", "ph").alias(name))
    return side(pred, "p").join(side(gold, "g"), "paper_id")


def scalar_status(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """paper_id, field, status for papers on both sides: strings exactly, quantities by unit, pH exactly and only if
    either side has it. A paper's sides meet in one row, which gives a row for each field."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def one(field: str, s: str | None = None, q: str | None = None, n: str | None = None) -> Column:
        of = lambda side: [(F.col(f"{side}.{q}.value") if q else F.col(f"{side}.{n}") if n else none_d).cast("double").alias(f"{side}v"), (F.col(f"{side}.{q}.unit") if q else none_s).alias(f"{side}u"), (F.col(f"{side}.{s}") if s else none_s).alias(f"{side}s")]
        return F.struct(F.lit(field).alias("field"), *of("p"), *of("g"))

    every = F.array(one("solvent", "solvent"), one("synthesis_method", "synthesis_method"), one("material.name", "name"), one("temperature", q="temperature"), one("reaction_time", q="reaction_time"), one("pH", n="ph"))
    both = _pairs(pred, gold).select("paper_id", F.explode(every).alias("x")).select("paper_id", "x.*")
    quantity, ph = F.col("field").isin("temperature", "reaction_time"), F.col("field") == "pH"
    here = lambda side: F.when(quantity | ph, F.col(f"{side}v").isNotNull()).otherwise(F.col(f"{side}s").isNotNull())
    equal = F.when(quantity, quantities_equal(F.col("pv"), F.col("pu"), F.col("gv"), F.col("gu"))).when(ph, F.coalesce(F.col("pv") == F.col("gv"), F.lit(False))).otherwise(F.coalesce(F.col("ps") == F.col("gs"), F.lit(False)))
    rows = both.where(~ph | F.col("pv").isNotNull() | F.col("gv").isNotNull())
    return rows.select("paper_id", "field", status(here("p"), here("g"), equal).alias("status"))


def match_precursors(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """pred and gold: paper_id, item_idx, name, canonical_id, concentration, amount. Matched by canonical id, else lower
    name; of gold's rows with one key the last counts, a key is used once, further predictions are spurious."""
    key = F.coalesce("canonical_id", F.lower("name"))
    g = gold.withColumn("key", key).withColumn("__n", F.row_number().over(Window.partitionBy("paper_id", "key").orderBy(F.desc("item_idx")))).where("__n = 1")
    p = pred.withColumn("key", key).withColumn("turn", F.row_number().over(Window.partitionBy("paper_id", "key").orderBy("item_idx")))
    g = g.select("paper_id", "key", F.lit(1).alias("turn"), *[F.col(c).alias(f"gold_{c}") for c in ("name", "concentration", "amount")], F.lit(True).alias("in_gold"))
    p = p.select("paper_id", "key", "turn", *[F.col(c).alias(f"pred_{c}") for c in ("name", "concentration", "amount")], F.lit(True).alias("in_pred"))
    return p.join(g, ["paper_id", "key", "turn"], "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_gold", "in_pred")})


def _count(level: str, rows: DataFrame, tp: Column, fp: Column, fn: Column) -> DataFrame:
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    return rows.groupBy("paper_id").agg(total(tp, "tp"), total(fp, "fp"), total(fn, "fn")).withColumn("level", F.lit(level))


def entity_counts(matches: DataFrame, statuses: DataFrame, techniques: DataFrame) -> DataFrame:
    """tp, fp, fn of entities by paper: precursors, material and solvent (lower case), techniques (paper_id, in_pred,
    in_gold by distinct lower name). statuses: paper_id, in_pred, in_gold, equal of material and solvent."""
    p = matches.select("paper_id", (F.col("in_pred") & F.col("in_gold")).alias("tp"), (F.col("in_pred") & ~F.col("in_gold")).alias("fp"), (~F.col("in_pred") & F.col("in_gold")).alias("fn"))
    t = techniques.select("paper_id", (F.col("in_pred") & F.col("in_gold")).alias("tp"), (F.col("in_pred") & ~F.col("in_gold")).alias("fp"), (~F.col("in_pred") & F.col("in_gold")).alias("fn"))
    hit = F.coalesce("equal", F.lit(False))
    s = statuses.select("paper_id", hit.alias("tp"), (F.col("in_pred") & ~hit).alias("fp"), (F.col("in_gold") & ~hit).alias("fn"))
    return _count("entity", p.unionByName(t).unionByName(s), F.col("tp"), F.col("fp"), F.col("fn"))


def named_scalars(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """paper_id, in_pred, in_gold, equal (lower case) of material and solvent."""
    one = lambda name: F.struct(F.lower(f"p.{name}").alias("p"), F.lower(f"g.{name}").alias("g"))
    rows = _pairs(pred, gold).select(F.col("paper_id"), F.explode(F.array(one("name"), one("solvent"))).alias("x"))
    return rows.select("paper_id", F.col("x.p").isNotNull().alias("in_pred"), F.col("x.g").isNotNull().alias("in_gold"), (F.col("x.p") == F.col("x.g")).alias("equal"))


def technique_sets(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """paper_id, technique (lower case), in_pred, in_gold; both in: paper_id, technique."""
    p = pred.select("paper_id", F.lower("technique").alias("technique")).distinct().withColumn("in_pred", F.lit(True))
    g = gold.select("paper_id", F.lower("technique").alias("technique")).distinct().withColumn("in_gold", F.lit(True))
    return p.join(g, ["paper_id", "technique"], "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_pred", "in_gold")})


def relations(matches: DataFrame) -> DataFrame:
    """paper_id, key, attribute, in_pred, in_gold, equal of concentration and amount of matched precursors."""
    one = lambda c: F.struct(F.lit(c).alias("attribute"), F.col(f"pred_{c}").isNotNull().alias("in_pred"), F.col(f"gold_{c}").isNotNull().alias("in_gold"), quantities_equal(F.col(f"pred_{c}.value"), F.col(f"pred_{c}.unit"), F.col(f"gold_{c}.value"), F.col(f"gold_{c}.unit")).alias("equal"))
    return matches.where("in_pred and in_gold").select("paper_id", "key", F.explode(F.array(one("concentration"), one("amount"))).alias("r")).select("paper_id", "key", "r.*")


def relation_counts(relation_rows: DataFrame) -> DataFrame:
    return _count("relation", relation_rows, F.col("equal"), F.col("in_pred") & ~F.col("equal"), F.col("in_gold") & ~F.col("equal"))


def field_counts(status_rows: DataFrame) -> DataFrame:
    s = F.col("status")
    return _count("field", status_rows, s == "correct", s.isin("incorrect", "spurious"), s.isin("incorrect", "missing"))


def with_scores(counts: DataFrame) -> DataFrame:
    """precision, recall and f1; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def ablation(reports: DataFrame) -> DataFrame:
    """Micro averages by extractor and level; reports: extractor, level, tp, fp, fn."""
    return with_scores(reports.groupBy("extractor", "level").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).orderBy(F.concat("extractor", F.lit(":"), "level"))


def errors(status_rows: DataFrame, matches: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """paper_id, error_type, field: wrong, missing and spurious fields, missing and spurious precursors, and wrong
    relations where gold has a value."""
    s = status_rows.where(F.col("status").isin("incorrect", "missing", "spurious"))
    s = s.select("paper_id", F.when(F.col("status") == "incorrect", "WRONG_VALUE").when(F.col("status") == "missing", "MISSING_FIELD").otherwise("SPURIOUS_FIELD").alias("error_type"), "field")
    m = matches.where("in_pred <> in_gold").select("paper_id", F.when(F.col("in_gold"), "MISSING_ENTITY").otherwise("SPURIOUS_ENTITY").alias("error_type"), F.concat(F.lit("precursors:"), "key").alias("field"))
    r = relation_rows.where("in_gold and not equal").select("paper_id", F.lit("WRONG_RELATION").alias("error_type"), F.concat(F.lit("precursors:"), "key", F.lit("."), "attribute").alias("field"))
    return s.unionByName(m).unionByName(r)
