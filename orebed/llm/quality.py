"""Text quality by a sparse rule ensemble over statistics of whole texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .shared import let

#: Names of the statistics, in the order of statistics().
STATISTICS = ("chars", "words", "upper", "symbols", "bars", "bangs", "digits", "stops", "distinct", "word_chars", "line_chars", "spaces")


def statistics(text: Column) -> Column:
    """A struct of numbers (double, never null or infinite) of a text; a null text counts as empty. What several numbers
    need is computed once, in the row, wherever the struct ends up in a plan."""

    def of(p: Column) -> Column:
        t, chars, n = p["t"], p["chars"], p["n"]
        some = F.greatest(chars, F.lit(1.0))
        share = lambda pattern: F.char_length(F.regexp_replace(t, pattern, "")) / some
        times = lambda sign: chars - F.char_length(F.replace(t, F.lit(sign), F.lit("")))
        every = [
            chars,
            n,
            share("[^\\p{Lu}]+"),
            share("[\\p{L}\\p{N}\\s.,;:'\"()?-]+"),
            times("|") / some,
            times("!") / some,
            share("[^0-9]+"),
            times(".") / some,
            F.array_size(F.array_distinct(p["words"])) / n,
            chars / n,
            chars / (times("\n") + 1),
            times(" ") / some,
        ]
        return F.struct(*[c.alias(name) for c, name in zip(every, STATISTICS, strict=True)])

    def parts(t: Column) -> Column:
        words = let(F.split(t, "\\s+"), lambda w: F.struct(t.alias("t"), F.char_length(t).cast("double").alias("chars"), w.alias("words"), F.array_size(w).cast("double").alias("n")))
        return let(words, of)

    return let(F.coalesce(text, F.lit("")), parts)


@dataclass
class RuleEnsemble:
    """A logistic model of conjunctive rules; rules with weight 0 are gone."""

    intercept: float
    rules: list[tuple[tuple[trees.Condition, ...], float]]

    def column(self, features: list[Column]) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(trees.rule_column(rule, features), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * trees.holds(rule, x)
        return trees.sigmoid(z)

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'>' if a else '<='} {t:.6g}" for f, a, t in r) for r, w in self.rules]


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2, most_rules: int = 400, seed: int = 0) -> RuleEnsemble:
    """Boosted trees give the rules; the lasso's penalty is the one with the least loss on a fifth of the rows.

    Without rows, or with one class only, the ensemble is the intercept of the share of ones (a half without rows)."""
    if len(y) < 20 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), [])
    rng, grower = np.random.default_rng(seed), trees.Grower(x)
    mean = y.mean()
    z, found = np.full(len(y), np.log(mean / (1 - mean))), {}
    balance = np.where(y > 0.5, 0.5 / mean, 0.5 / (1 - mean))
    for _ in range(n_trees):
        w = balance * (rng.random(len(y)) < 0.7)
        tree = grower.grow(y - trees.sigmoid(z), w, depth, least=max(3.0, 0.002 * len(y)))
        z = z + rate * 4 * trees.predict(tree, x)
        found.update(dict.fromkeys(trees.rules(tree)))
        if len(found) >= most_rules:
            break
    kept, seen = [], set()
    for rule in found:
        key = (h := trees.holds(rule, x)).tobytes()
        if 0 < h.sum() < len(y) and key not in seen:
            seen.add(key)
            kept.append((rule, h))
    if not kept:
        return RuleEnsemble(float(np.log(mean / (1 - mean))), [])
    m = np.stack([h for _, h in kept], axis=1).astype(float)
    sd = np.sqrt(m.mean(0) * (1 - m.mean(0)))
    scaled, test = m / sd, rng.random(len(y)) < 0.2
    best = None
    for penalty in (0.02, 0.007, 0.002, 0.0007):
        b, w = trees.lasso_logistic(scaled[~test], y[~test], penalty)
        p = np.clip(trees.sigmoid(scaled[test] @ w + b), 1e-6, 1 - 1e-6)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean() if test.any() else 0.0
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = trees.lasso_logistic(scaled, y, best[1])
    return RuleEnsemble(b, [(rule, float(v)) for (rule, _), v in zip(kept, w / sd, strict=True) if abs(v) > 1e-9])


def training_row(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, seed: int = 0) -> RuleEnsemble:
    """Fits on at most most_rows labelled training rows, those first by a hash of their id.

    Labels other than 0 and 1 take no part; a document with several labels has their mean, at least a half (a tie) being 1.
    A null doc_id has no label. Null texts count as empty; repeated rows each count. Without labelled rows, or tables, the
    model scores every text alike (a half without any label). Columns but doc_id, text and quality take no part."""
    known = labels.where(F.col("quality").isin(0, 1) & training_row(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # most_rows small rows at most
    got = rows.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"), statistics(F.col("text")).alias("s")).select("doc_id", "y", "s.*").toPandas()
    got = got.sort_values(["doc_id", *STATISTICS])
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float), seed=seed)


def score(documents: DataFrame, model: RuleEnsemble, text: str = "text", name: str = "score") -> DataFrame:
    """documents with the model's score (0 to 1; higher: better) of each whole text, in Spark columns only.

    A column called `name` that is there already is replaced; all other columns and repeated rows stay. Null and empty
    texts have the score of an empty text; whole texts count, of any length; equal texts have equal scores. An empty table
    gives no rows."""
    return documents.withColumn(name, let(statistics(F.col(text)), lambda x: model.column([x[n] for n in STATISTICS])))
