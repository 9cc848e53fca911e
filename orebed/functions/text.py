"""Column builders over text: matches with offsets, words, numbers, hashes, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags for Unicode case folding and classes.
FLAGS = "(?iuU)"


#: Noncharacters, which no text is meant to hold, around each match; where one does, it counts as U+FFFD.
OPENS, CLOSES = "\ufdd0", "\ufdd1"


def running(sizes: Column, start: Column, stride: int = 256) -> Column:
    """start, start + the first size, start + the first two, ...: one number more than sizes. Sums within strides, then of
    strides, so that long arrays aren't copied for each element."""
    append = lambda a, n: F.array_append(a, (F.element_at(a, -1) + n).cast("int"))

    def of(x: Column) -> Column:
        many, first = x["sizes"], x["start"]
        strides = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(many) / stride).cast("int") - 1, F.lit(0)))
        part = lambda k: F.slice(many, k * stride + 1, stride)
        bases = F.aggregate(F.transform(strides, lambda k: F.aggregate(part(k), F.lit(0), lambda a, n: a + n)), F.array(first), append)
        sums = let(bases, lambda b: F.flatten(F.transform(strides, lambda k: F.slice(F.aggregate(part(k), F.array(F.element_at(b, k + 1)), append), 1, stride))))
        return F.when(F.size(many) == 0, F.array(first)).otherwise(F.concat(F.slice(sums, 1, F.size(many)), F.array(F.element_at(bases, -1))))

    return let(F.struct(sizes.alias("sizes"), start.cast("int").alias("start")), of)


def parted(text: Column, pattern: str) -> Column:
    """What stands before the first match, then for each match an element: it, CLOSES, and what follows up to the next."""
    held = F.contains(text, F.lit(OPENS)) | F.contains(text, F.lit(CLOSES))
    bare = F.when(held, F.translate(text, OPENS + CLOSES, "\ufffd\ufffd")).otherwise(text)
    return F.split(F.regexp_replace(bare, F.lit(pattern), F.lit(f"{OPENS}$0{CLOSES}")), OPENS, -1)


def spans(text: Column, pattern: str, groups: int = 2) -> Column:
    """All matches, left to right: array of text, start, end (code points, end exclusive) and g1, g2, ... The text is gone
    through once, for matches; their marks part it, and groups are taken from the matches alone, which match by
    themselves too."""

    def every(p: Column) -> Column:
        rest = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))  # a match, its mark, what follows it
        starts = running(F.transform(rest, lambda x: F.char_length(x) - 1), F.char_length(F.element_at(p, 1)))

        def one(x: Column, i: Column, at: Column) -> Column:
            start, hit = F.element_at(at, i + 1), F.substring_index(x, CLOSES, 1)
            return let(hit, lambda h: F.struct(h.alias("text"), start.alias("start"), (start + F.char_length(h)).cast("int").alias("end"), *[F.regexp_extract(h, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]))

        return F.when(F.size(p) > 1, let(starts, lambda at: F.transform(rest, lambda x, i: one(x, i, at)))).otherwise(F.transform(F.slice(p, 1, 0), lambda x: one(x, F.lit(0), F.array(F.lit(0)))))

    return let(parted(text, pattern), every)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is written and computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words by white space."""
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.size(F.split(strip(text), r"(?U)\s+")))


# Fixed value: what a token of an embedding consists of.
TOKEN = r"[A-Za-z0-9\x{B0}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and the degree sign."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hashed_index(token: Column, dims: int) -> Column:
    """The vector component of a token: the first four bytes of its sha256, modulo dims."""
    return (F.conv(F.substring(sha256(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def hashed_sign(token: Column) -> Column:
    """1 if the fifth byte is even, else -1."""
    return F.when(F.conv(F.substring(sha256(token), 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def general_number(x: Column) -> Column:
    """A number in the general form with six significant digits and no trailing zeros, for magnitudes from 1e-4 to 1e6;
    others in scientific form."""
    digits = F.when(x == 0, F.lit(5)).otherwise(F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int"))
    fixed = F.format_string("%.10f", F.round(x, 0))
    for d in range(0, 11):
        fixed = F.when(digits == d, F.format_string(f"%.{d}f", x)).otherwise(fixed)
    plain = F.when(fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")).otherwise(fixed)
    power = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when((x != 0) & ((F.abs(x) < 1e-4) | (F.abs(x) >= 1e6)), power).otherwise(plain)


def quote(text: Column) -> Column:
    """A text as a literal part of a pattern."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}-])", r"\\$1")
