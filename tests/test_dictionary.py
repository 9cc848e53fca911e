"""Dictionary entities and matches with offsets against plain search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebed.functions.tables import TERMS
from orebed.functions.text import CLOSES, running, spans
from orebed.operators import ner, rules

BLOCK = "paper_id string, version int, block_ordinal int, page int, section string, text string"
SAID = [
    "Silver nitrate and silver nitrate solution in DI water; water-based, waterfall.",
    "NaBH4/AgNO3 (sodium  borohydride) UV-Vis TEM, systems XRD_DLS",
    "zinc oxide nanoparticles, ZnO nanoparticles and oxide",
    "+ag+ and ++ag+, -ag+ (R)-lactic acid, x(R)-lactic acid (r)-Lactic acid.",
    "été ÉTÉ étés a b c a b c d",
    "",
    None,
    "water " * 3000 + "end",
    "﷐water﷑ and ﷐ ethanol",
]


def greedy(text, terms):
    """Terms by falling length take their places, left to right, where nothing stands yet and no letter or digit is beside."""
    taken = []
    for t, label, _ in sorted(terms, key=lambda x: (-len(x[0]), x[2])):
        for m in re.finditer(f"(?={re.escape(t.lower())})", text.lower()):
            a, b = m.start(), m.start() + len(t)
            word = lambda c: c.isalnum()
            if (a and word(text[a - 1])) or (b < len(text) and word(text[b])):
                continue
            if all(b <= s or e <= a for s, e, _, _ in taken):
                taken.append((a, b, text[a:b], label))
    return sorted(taken)


def found(spark, said, terms):
    blocks = spark.createDataFrame([("P", 1, k, 1, None, t) for k, t in enumerate(said)], BLOCK)
    d = spark.createDataFrame(terms, "term string, label string, ord int")
    got = ner.dictionary_entities(blocks, d).collect()
    return sorted((r["block_ordinal"], r["start"], r["end"], r["text"], r["label"]) for r in got)


def wanted(said, terms):
    clean = [(t or "").replace("﷐", "�").replace("﷑", "�") for t in said]
    return sorted((k, *x) for k, t in enumerate(clean) for x in greedy(t, terms))


@pytest.mark.parametrize("most", [10**6, 0])
def test_dictionary(spark, monkeypatch, most):
    monkeypatch.setattr(ner, "MOST_BROADCAST", most)
    terms = [(t, label, k) for k, (label, t) in enumerate((label, t) for label, ts in TERMS.items() for t in ts)]
    terms += [("+ag+", "ION", 100), ("(R)-lactic acid", "ACID", 101), ("a b c", "X", 102), ("b c d", "Y", 103), ("c a b", "Z", 104), ("été", "E", 105), ("nitrate solution", "S", 106), ("water", "AGAIN", 107)]
    assert found(spark, SAID, terms) == wanted(SAID, terms)
    assert found(spark, [None], terms) == []


def test_against_the_alternation(spark):
    """On the vocabulary, the dictionary, the greedy fold and the one alternation choose the same."""
    blocks = spark.createDataFrame([("P", 1, k, 1, None, t) for k, t in enumerate(SAID[:5])], BLOCK)
    as_rows = lambda c: sorted((r["block_ordinal"], e["start"], e["end"], e["text"], e["label"]) for r in blocks.select("block_ordinal", c.alias("es")).collect() for e in r["es"])
    terms = [(t, label, k) for k, (label, t) in enumerate((label, t) for label, ts in TERMS.items() for t in ts)]
    got = found(spark, SAID[:5], terms)
    assert got == as_rows(ner.entities(F.col("text"))) == as_rows(ner.greedy_entities(F.col("text"), TERMS)) and len(got) > 9


def test_random_vocabularies(spark):
    rng = np.random.default_rng(3)
    words = ["a", "b", "ab", "c1"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "  ", ". "]) for _ in range(n))
    said = [say(int(rng.integers(1, 40))) for _ in range(40)]
    terms = [(say(int(rng.integers(1, 4))).strip(" .-") + ("" if rng.random() < 0.8 else "-"), f"L{k}", k) for k in range(30)]
    assert found(spark, said, terms) == wanted(said, terms)


def test_spans_and_running_sums(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for n in (0, 1, 255, 256, 257, 1000):
        sizes = list(range(n))
        assert one(running(F.lit(sizes).cast("array<int>") if n else F.array().cast("array<int>"), F.lit(5))) == [5 + sum(sizes[:k]) for k in range(n + 1)]
    text = "ab1 𝒳2\n\nc33"
    got = one(spans(F.lit(text), r"[a-z]?(\d)\d*", 1))
    assert [(m["text"], m["start"], m["end"], m["g1"]) for m in got] == [(m.group(), m.start(), m.end(), m.group(1)) for m in re.finditer(r"[a-z]?(\d)\d*", text)]
    assert one(spans(F.lit("none"), r"\d", 0)) == [] and one(spans(F.lit(""), r"\d", 0)) == []
    assert one(spans(F.lit(None).cast("string"), r"\d", 0)) in (None, [])


def test_only_first_words_of_terms_become_places(spark):
    """A block's other words stay in its row: with a row for each word, a table of 0.1 GB took 452 s of CPU."""
    firsts = spark.createDataFrame([("silver",), ("di",), ("di",)], "w string").select(F.xxhash64("w").alias("first"))
    marks = ner.first_marks(firsts)
    assert sum(marks) == 2 and len(marks) >= 32
    many = ner.first_marks(spark.range(1 << 15).select(F.xxhash64("id").alias("first")))
    assert len(many) == ner.MOST_SLOTS and 28_000 < sum(many) <= 1 << 15
    text = "water " * 3000 + "(Silver  nitrate, DI"
    got = spark.createDataFrame([(text,), ("water",), ("",), (None,)], "text string").select(ner.places(F.col("text"), marks, 2).alias("p")).collect()
    assert [(x["start"], x["before"], x["next"].split(CLOSES)) for x in got[0]["p"]] == [(18001, "er water ("[-9:], ["Silver", "  nitrate", ", DI", ""]), (18018, " nitrate, "[-9:], ["DI", ""])]
    assert [r["p"] for r in got[1:]] == [None] * 3


def test_amounts_in_one_pass(spark):
    """Concentrations and masses found together are those that each rule finds by itself."""
    rng = np.random.default_rng(5)
    parts = ["1", "2.5", "10", ".", "-", " ", "  ", "mg", "g", "kg", "ug", "µg", "mM", "M", "nM", "wt%", "mg/mL", "mg/L", "mg /L", "m", "\u00b5M", "mL", "é", "s", "K", ",", "7"]
    said = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(400)] + ["", "none", "5 mg of AgNO3 (10 mM) and 3 mg/mL, 4 g/L", None]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    kinds = {"c": "concentration", "m": "mass"}
    got = rows.select(rules.amounts(F.col("text")).alias("q"), *[rules.matches(F.col("text"), k).alias(n) for n, k in kinds.items()]).collect()
    assert all((r["q"][n] or []) == (r[n] or []) for r in got for n in kinds)
    assert sum(len(r["c"] or []) for r in got) > 50 and sum(len(r["m"] or []) for r in got) > 50
