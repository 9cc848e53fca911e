"""Schemas of nested payloads, and validators made of them: one expression over a VARIANT, walked by path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

VIOLATION = "array<struct<path:string,reason:string>>"


@dataclass(frozen=True)
class Kind:
    """What a member of a payload may be. required: it must be there and not be null. Members that a schema doesn't name are
    allowed, as are nulls in place of what isn't required."""

    required: bool = False

    def faults(self, v: Column, path: Column) -> Column:
        """Violations (path, reason) of a VARIANT that is there and not null."""
        raise NotImplementedError


def _fault(when: Column, path: Column, reason: str) -> Column:
    return F.when(when, F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))).otherwise(F.array().cast(VIOLATION))


@dataclass(frozen=True)
class Text(Kind):
    def faults(self, v, path):
        return _fault(F.schema_of_variant(v) != "STRING", path, "not a text")


@dataclass(frozen=True)
class Number(Kind):
    """A number, a truth value (1 or 0), or a text that is a number."""

    least: float | None = None
    most: float | None = None
    what = "number"

    def value(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "double")

    def faults(self, v, path):
        def of(x: Column) -> Column:
            bad = [_fault(x.isNull(), path, f"not a {self.what}")]
            if self.least is not None:
                bad.append(_fault(x < self.least, path, f"below {self.least}"))
            if self.most is not None:
                bad.append(_fault(x > self.most, path, f"above {self.most}"))
            return F.concat(*bad)

        return let(self.value(v), of)


@dataclass(frozen=True)
class Whole(Number):
    """A number without a fraction, as above."""

    what = "whole number"

    def value(self, v: Column) -> Column:
        x = F.try_variant_get(v, "$", "double")
        return F.when(x == F.floor(x), x)


@dataclass(frozen=True)
class Object(Kind):
    members: dict[str, Kind] = field(default_factory=dict)

    def faults(self, v, path):
        def of(m: Column) -> Column:
            found = []
            for name, kind in self.members.items():
                at = F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
                found.append(_member(kind, F.try_element_at(m, F.lit(name)), at))
            return F.concat(*found) if found else F.array().cast(VIOLATION)

        return let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.when(m.isNull() | (~F.schema_of_variant(v).startswith("OBJECT")), _fault(F.lit(True), path, "not an object")).otherwise(of(m)))


@dataclass(frozen=True)
class List(Kind):
    """A list; null in its place is a fault, unlike its absence."""

    item: Kind = field(default_factory=Text)

    def faults(self, v, path):
        items = F.try_variant_get(v, "$", "array<variant>")

        def of(xs: Column) -> Column:
            return F.flatten(F.transform(xs, lambda x, i: _checked(self.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), True)))

        return let(items, lambda xs: F.when(xs.isNull(), _fault(F.lit(True), path, "not a list")).otherwise(of(xs)))


def _checked(kind: Kind, v: Column, path: Column, needed: bool) -> Column:
    """Violations of what stands at path; v is null where nothing does."""
    absent = v.isNull()
    null = F.coalesce(F.is_variant_null(v), F.lit(False))
    missing = _fault(F.lit(True), path, "missing") if kind.required else F.array().cast(VIOLATION)
    no_null = _fault(F.lit(True), path, "null") if needed or kind.required or isinstance(kind, List) else F.array().cast(VIOLATION)
    return F.when(absent, missing).when(null, no_null).otherwise(kind.faults(v, path))


def _member(kind: Kind, there: Column, at: Column) -> Column:
    def of(x: Column) -> Column:
        return _checked(kind, x["v"], x["at"], False)

    return let(F.struct(there.alias("v"), at.alias("at")), of)


def quantity(required: bool = False) -> Object:
    return Object(required, {"value": Number(True), "unit": Text(True)})


#: A prediction or a gold record without its identity.
SYNTHESIS = Object(
    True,
    {
        "material": Object(False, {"name": Text(), "composition": Text(), "size": quantity(), "morphology": Text(), "canonical_id": Text()}),
        "precursors": List(False, Object(True, {"name": Text(True), "amount": quantity(), "concentration": quantity(), "canonical_id": Text()})),
        "solvent": Text(),
        "temperature": quantity(),
        "reaction_time": quantity(),
        "pH": Number(),
        "synthesis_method": Text(),
        "steps": List(False, Object(True, {"order": Whole(True, 1), "description": Text(True)})),
        "characterization": List(False, Object(True, {"technique": Text(True), "finding": Text()})),
        "properties": List(False, Object(True, {"name": Text(True), "value": quantity(), "qualitative_value": Text()})),
    },
)
#: With what names it.
RECORD = Object(True, {"paper_id": Text(True), "schema_version": Text(), **SYNTHESIS.members})


def faults(payload: Column, schema: Kind = SYNTHESIS) -> Column:
    """Violations of a JSON text, an array of (path, reason) in the schema's order; the path of the whole is empty. A null
    text, one that isn't JSON, and a JSON null are no object."""
    whole = _fault(F.lit(True), F.lit(""), "not an object")
    return let(F.try_parse_json(payload), lambda v: F.when(v.isNull() | F.is_variant_null(v), whole).otherwise(schema.faults(v, F.lit(""))))


def violations(payloads: DataFrame, by: list[str], payload: str = "payload", schema: Kind = SYNTHESIS) -> DataFrame:
    """A row for each violation: by, path, reason. Payloads that fit have none; repeated payloads have theirs each."""
    return payloads.select(*by, F.explode(faults(F.col(payload), schema)).alias("f")).select(*by, "f.path", "f.reason")
