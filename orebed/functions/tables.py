"""Units, vocabulary, entities and priorities that results depend on."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units as written (lower case) and as reported, by kind of quantity.
UNITS = {
    "temperature": {"c": "C", "°c": "C", "celsius": "C", "k": "K", "kelvin": "K", "f": "F", "fahrenheit": "F"},
    "reaction_time": {"s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s", "min": "min", "mins": "min", "minute": "min", "minutes": "min", "h": "h", "hr": "h", "hrs": "h", "hour": "h", "hours": "h"},
    "concentration": {"mm": "mM", "µm": "uM", "um": "uM", "nm": "nM", "m": "M", "mg/ml": "mg/mL", "mg/l": "mg/L", "wt%": "wt%"},
    "volume": {"ml": "mL", "µl": "uL", "ul": "uL", "l": "L"},
    "mass": {"mg": "mg", "g": "g", "kg": "kg", "µg": "ug", "ug": "ug"},
}

# Patterns and confidences of the quantity rules, in the order in which they apply.
RULES = [
    ("temperature", r"(-?\d+(?:\.\d+)?)\s*\x{B0}?\s*(Celsius|Fahrenheit|Kelvin|C|K|F)\b", 0.97),
    ("reaction_time", r"(\d+(?:\.\d+)?)\s*(hours|hour|hrs|hr|h|minutes|minute|mins|min|seconds|second|secs|sec|s)\b", 0.95),
    ("concentration", r"(\d+(?:\.\d+)?)\s*(mg/mL|mg/L|mM|\x{B5}M|uM|nM|M|wt%)(?![A-Za-z0-9])", 0.90),
    ("volume", r"(\d+(?:\.\d+)?)\s*(mL|\x{B5}L|uL|L)\b", 0.93),
    ("mass", r"(\d+(?:\.\d+)?)\s*(mg|kg|g|\x{B5}g|ug)\b(?!\s*/)", 0.93),
]

# The vocabulary, by label.
TERMS = {
    "PRECURSOR": ["silver nitrate", "AgNO3", "gold chloride", "chloroauric acid", "HAuCl4", "sodium borohydride", "NaBH4", "ferric chloride", "FeCl3", "zinc acetate", "copper sulfate", "CuSO4", "trisodium citrate", "sodium citrate", "polyvinylpyrrolidone", "PVP"],
    "SOLVENT": ["deionized water", "DI water", "distilled water", "ethanol", "methanol", "isopropanol", "acetone", "dimethylformamide", "DMF", "dimethyl sulfoxide", "DMSO", "toluene", "chloroform", "water"],
    "MATERIAL": ["silver nanoparticles", "AgNPs", "gold nanoparticles", "AuNPs", "zinc oxide nanoparticles", "ZnO nanoparticles", "iron oxide nanoparticles", "copper nanoparticles"],
    "CHARACTERIZATION": ["TEM", "SEM", "XRD", "UV-Vis", "FTIR", "DLS", "XPS", "EDX", "zeta potential"],
}

# Canonical entities with synonyms and CAS numbers.
ENTITIES = [
    ("AGNO3", "Silver nitrate", ["silver nitrate", "agno3"], "7761-88-8"),
    ("NABH4", "Sodium borohydride", ["sodium borohydride", "nabh4"], "16940-66-2"),
    ("HAUCL4", "Chloroauric acid", ["chloroauric acid", "gold chloride", "haucl4"], "16903-35-8"),
    ("FECL3", "Ferric chloride", ["ferric chloride", "fecl3"], "7705-08-0"),
    ("ZNOAC", "Zinc acetate", ["zinc acetate"], "557-34-6"),
    ("CUSO4", "Copper sulfate", ["copper sulfate", "cuso4"], "7758-98-7"),
    ("NA3CIT", "Trisodium citrate", ["trisodium citrate", "sodium citrate"], "6132-04-3"),
    ("PVP", "Polyvinylpyrrolidone", ["polyvinylpyrrolidone", "pvp"], "9003-39-8"),
    ("ETOH", "Ethanol", ["ethanol"], "64-17-5"),
    ("MEOH", "Methanol", ["methanol"], "67-56-1"),
    ("H2O", "Deionized water", ["deionized water", "di water", "distilled water", "water"], "7732-18-5"),
    ("ISOPROP", "Isopropanol", ["isopropanol"], "67-63-0"),
    ("ACETONE", "Acetone", ["acetone"], "67-64-1"),
    ("DMF", "Dimethylformamide", ["dimethylformamide", "dmf"], "68-12-2"),
    ("DMSO", "Dimethyl sulfoxide", ["dimethyl sulfoxide", "dmso"], "67-68-5"),
    ("TOLUENE", "Toluene", ["toluene"], "108-88-3"),
    ("CHLOROFORM", "Chloroform", ["chloroform"], "67-66-3"),
    ("AGNP", "Silver nanoparticles", ["silver nanoparticles", "agnps"], None),
    ("AUNP", "Gold nanoparticles", ["gold nanoparticles", "aunps"], None),
    ("ZNONP", "Zinc oxide nanoparticles", ["zinc oxide nanoparticles", "zno nanoparticles"], None),
    ("FEOXNP", "Iron oxide nanoparticles", ["iron oxide nanoparticles"], None),
    ("CUNP", "Copper nanoparticles", ["copper nanoparticles"], None),
]

# Which source is believed first, by field; and for fields without an entry.
FIELD_PRIORITY = {
    "temperature": ["RULE", "NER", "LLM"],
    "reaction_time": ["RULE", "NER", "LLM"],
    "concentration": ["RULE", "NER", "LLM"],
    "amount": ["RULE", "NER", "LLM"],
    "solvent": ["NER", "LLM"],
    "material.name": ["NER", "LLM"],
    "synthesis_method": ["LLM", "NER"],
    "pH": ["RULE", "LLM"],
}
FALLBACK_PRIORITY = ["RULE", "NER", "LLM", "HYBRID", "HUMAN"]

# Unit, dimension, factor to the base unit (K, s, M, g, L).
CANONICAL = [
    ("s", "time", 1.0), ("min", "time", 60.0), ("h", "time", 3600.0),
    ("M", "concentration", 1.0), ("mM", "concentration", 1e-3), ("uM", "concentration", 1e-6), ("nM", "concentration", 1e-9),
    ("g", "mass", 1.0), ("mg", "mass", 1e-3), ("kg", "mass", 1e3), ("ug", "mass", 1e-6),
    ("L", "volume", 1.0), ("mL", "volume", 1e-3), ("uL", "volume", 1e-6),
]

# Strings that stand for nothing, and unit spellings in model answers.
MISSING = ["", "null", "none", "n/a", "na", "not stated", "not reported", "not mentioned", "unknown", "-"]
ANSWER_UNITS = {
    "°C": "C", "ºC": "C", "℃": "C", "C": "C", "degC": "C", "K": "K", "°F": "F", "F": "F",
    "s": "s", "sec": "s", "secs": "s", "min": "min", "mins": "min", "h": "h", "hr": "h", "hrs": "h",
    "M": "M", "mM": "mM", "µM": "uM", "μM": "uM", "uM": "uM", "nM": "nM",
    "mL": "mL", "ml": "mL", "µL": "uL", "μL": "uL", "uL": "uL", "ul": "uL", "L": "L",
    "mg": "mg", "g": "g", "kg": "kg", "µg": "ug", "μg": "ug", "ug": "ug",
    "nm": "nm", "µm": "um", "μm": "um", "mm": "mm",
    "mol": "mol", "mmol": "mmol", "µmol": "umol", "μmol": "umol", "umol": "umol",
    "wt%": "wt%", "wt.%": "wt%", "%": "%",
    "mg/mL": "mg/mL", "mg/ml": "mg/mL", "mg/L": "mg/L", "mg/l": "mg/L",
    "rpm": "rpm", "eV": "eV", "mV": "mV",
}
ANSWER_UNIT_WORDS = {
    "celsius": "C", "degrees celsius": "C", "degree celsius": "C", "deg c": "C", "degrees c": "C",
    "kelvin": "K", "fahrenheit": "F",
    "second": "s", "seconds": "s", "minute": "min", "minutes": "min", "hour": "h", "hours": "h",
    "molar": "M", "millimolar": "mM", "micromolar": "uM", "nanomolar": "nM",
    "milliliter": "mL", "milliliters": "mL", "millilitre": "mL", "microliter": "uL", "microliters": "uL",
    "nanometer": "nm", "nanometers": "nm", "nanometre": "nm",
}

# Degree signs, and what a number consists of, inside brackets of a pattern.
DEGREES = "°º"
NUMERALS = r"0-9+.eE\-"
NUMBER_SIGNS = r"\d."

# What may stand before a number that isn't exact, and between two numbers.
VAGUE_SIGNS = ["~", "≈"]
VAGUE_WORDS = ["ca.", "ca", "approx.", "approx", "about"]
RANGE_SIGNS = ["-", "–", "—", "to", "or", "and", "/"]

# How sure a model's fact is, with its text found in the document or not.
LOCATED, UNLOCATED = 0.8, 0.6
UNLOCATED_TEXT = "Reported by the LLM; no verbatim match was found in the document text."


def map_of(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "map<string,string>")  # folded into one literal


def look_up(values: dict[str, str], key: Column) -> Column:
    return F.element_at(map_of(values), key)


def entities(spark: SparkSession) -> DataFrame:
    """canonical_id, canonical_name, synonyms, cas_number: 22 rows."""
    return spark.createDataFrame(ENTITIES, "canonical_id string, canonical_name string, synonyms array<string>, cas_number string")


def aliases(spark: SparkSession, entity_rows: DataFrame | None = None) -> DataFrame:
    """alias (normalised), canonical_id, canonical_name, cas_number; of a doubled alias the last entity's."""
    rows = (entity_rows or entities(spark)).select("canonical_id", "canonical_name", "cas_number", F.explode(F.concat(F.array("canonical_name"), "synonyms")).alias("a"))
    named = rows.select(normalize_name(F.col("a")).alias("alias"), "canonical_id", "canonical_name", "cas_number")
    return named.groupBy("alias").agg(F.max(F.struct("canonical_id", "canonical_name", "cas_number")).alias("e")).select("alias", "e.*")


def normalize_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))
