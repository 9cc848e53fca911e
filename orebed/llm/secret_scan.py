"""Secret scans: candidates by pattern, false positives removed by a random forest compiled into Spark columns.

The forest sees a candidate's length and make, its letter transitions and the share of it that dictionary words cover (both
counted in a corpus), paths, and what the words before it said in labelled findings."""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .shared import Scratch, let, literal_table

#: A candidate: a run of 16 or more key characters, not all of them small letters and signs, with two signs of padding at
#: most; or 6 to 64 characters of any kind that a secret word is set to.
RUN = "(?<![A-Za-z0-9+/_-])(?=[a-z/_-]*+[A-Z0-9+])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])"
SET_TO = "(?<=[=: \"'])(?<=(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\\s?[=:]\\s?[\"']?)[^\\s\"'<>]{6,64}+"
CANDIDATE = f"{RUN}|{SET_TO}"
#: Texts without this have no candidates of the second kind; looking behind at every word is left to the others. The sign is
#: matched before looking behind it, not the other way round: that would be tried at every character.
SETS = "[=:](?<=(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\\s?[=:])"
#: Characters before a candidate in which its neighbouring words are sought, and how many of these count.
BESIDE, NEIGHBOURS = 48, 3

FEATURES = ("length", "digit", "upper", "hex", "runs", "distinct", "transitions", "dictionary", "separators", "path", "words_for", "words_against", "assigned", "quoted")


@dataclass(frozen=True)
class Context:
    """What a candidate is compared with: frequent words of a corpus, log10 probabilities of its letter transitions (26 x 26,
    row by row), and log odds of the words that stand before secrets."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]
    odds: tuple[tuple[str, float], ...]


def _transitions(pairs: dict[str, int]) -> tuple[float, ...]:
    letters = string.ascii_lowercase
    total = {a: sum(pairs.get(a + b, 0) for b in letters) + len(letters) for a in letters}
    return tuple(math.log10((pairs.get(a + b, 0) + 1) / total[a]) for a in letters for b in letters)


def _odds(found: list[tuple[list[str], int]], least: int = 4, most: int = 500) -> tuple[tuple[str, float], ...]:
    """Log odds of words before candidates (with labels), smoothed; at most `most` that occur `least` times."""
    n = [2 + sum(y == k for _, y in found) for k in (0, 1)]
    seen = [Counter(w for ws, y in found if y == k for w in set(ws)) for k in (0, 1)]
    every = {w: math.log((seen[1][w] + 1) / n[1]) - math.log((seen[0][w] + 1) / n[0]) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= least}
    return tuple(sorted(every.items(), key=lambda x: (-abs(x[1]), x[0]))[:most])


def _before(text: str) -> list[str]:
    return re.findall("[a-z]+", text[-BESIDE:].lower())[-NEIGHBOURS:]


def corpus_language(documents: DataFrame, most_words: int = 5000) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """The most_words most frequent words of 4 to 20 small letters (ties by the word), and the letter transitions of all words
    of up to 20, over all documents. Words are counted before the shuffle; numbers of a fixed size come to the driver."""
    split = documents.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w"))
    counted = Scratch(documents.sparkSession, "words").save(split.where(F.length("w").between(2, 20)).groupBy("w").count(), "words")
    top = counted.where(F.length("w") >= 4).orderBy(F.desc("count"), "w").limit(most_words).collect()
    places = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")
    pairs = counted.select("w", "count", places).groupBy(F.expr("substr(w, i, 2)").alias("pair")).agg(F.sum("count").alias("n")).collect()  # 676 at most
    return tuple(r["w"] for r in top), _transitions({r["pair"]: r["n"] for r in pairs})


@cache
def plain_context() -> Context:
    """The context of labelled_findings() alone, for scans without a corpus."""
    words, pairs, found = Counter(), Counter(), []
    for f in labelled_findings():
        for w in re.findall("[a-z]{2,20}", f["text"].lower()):
            words[w] += 1
            pairs.update(a + b for a, b in zip(w, w[1:], strict=False))
        hit = re.search(_python(CANDIDATE), f["text"])
        if hit:
            found.append((_before(f["text"][: hit.start()]), f["label"]))
    top = sorted((w for w in words if len(w) >= 4), key=lambda w: (-words[w], w))[:2000]
    return Context(tuple(top), _transitions(pairs), _odds(found))


def _python(pattern: str) -> str:
    """The pattern without the look-behind of varying width, which Python lacks: what follows a quote or an equals sign."""
    return pattern.replace(SET_TO, "(?<=[=: \"'])[^\\s\"'<>]{6,64}+(?=[\"'#]|$)") if SET_TO in pattern else pattern


def features(token: Column, before: Column, after: Column, context: Context) -> list[Column]:
    """Numbers (double) of a candidate; before and after: the text beside it, of any length."""
    n = F.char_length(token).cast("double")
    near = F.right(before, F.lit(BESIDE))
    table = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)

    def share(pattern: str) -> Column:
        return (n - F.char_length(F.regexp_replace(token, pattern, ""))) / n

    def flag(cond: Column) -> Column:
        return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))

    def follow(codes: Column) -> Column:
        """The mean log probability of letters side by side; -1.5 without any."""
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1))), lambda i: (i < F.size(codes)) & F.element_at(codes, i).between(0, 25) & F.element_at(codes, F.least(i + 1, F.size(codes))).between(0, 25))
        logs = F.transform(at, lambda i: F.element_at(table(context.transitions, "array<double>"), F.element_at(codes, i) * 26 + F.element_at(codes, i + 1) + 1))
        return let(logs, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).otherwise(F.lit(-1.5)))

    by_length = table([sorted(w for w in context.words if len(w) == k) for k in range(4, 21)], "array<array<string>>")  # no name for each word

    def known(p: Column) -> Column:
        return F.length(p).between(4, 20) & F.array_contains(F.element_at(by_length, F.least(F.greatest(F.length(p) - 3, F.lit(1)), F.lit(17))), F.lower(p))

    pieces = F.filter(F.regexp_extract_all(token, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), known)
    said = F.regexp_extract_all(F.lower(near), F.lit("[a-z]+"), F.lit(0))
    said = F.slice(said, F.greatest(F.size(said) - NEIGHBOURS, F.lit(0)) + 1, F.lit(NEIGHBOURS))
    odds = F.transform(said, lambda w: F.coalesce(F.element_at(table(dict(context.odds), "map<string,double>"), w), F.lit(0.0)))
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[0-9a-fA-F]"),
        F.regexp_count(token, F.lit("[0-9]+|[a-z]+|[A-Z]+")) / n,
        F.array_size(F.array_distinct(F.split(token, ""))) / F.least(n, F.lit(24.0)),
        let(F.transform(F.split(F.lower(token), ""), lambda c: F.ascii(c) - 97), follow),
        F.aggregate(pieces, F.lit(0.0), lambda a, p: a + F.length(p)) / n,
        share("[^A-Za-z0-9]"),
        flag(near.rlike("[/.@\\\\]$") | token.rlike("^/|/.*/") | after.rlike("^[/.@]")),
        F.coalesce(F.array_max(odds), F.lit(0.0)),
        F.coalesce(F.array_min(odds), F.lit(0.0)),
        flag(near.rlike("[=:] ?[\"']?$")),
        flag(near.rlike("[\"'`]$")),
    ]


def labelled_findings(n: int = 2400, seed: int = 0) -> list[dict]:
    """Labelled findings (text, label) made by rule: secrets and look-alikes in many wordings, half each."""
    r = random.Random(seed)
    hexa, b62 = "0123456789abcdef", string.ascii_letters + string.digits
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = "tion er an the re on in st ou ha ver lich sch ung ment que ado cion bo mi ra file img user page doc item report".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda k: " ".join(word() for _ in range(k))

    def secret() -> str:
        body = r.choice([lambda: draw(hexa, r.choice([32, 40, 40, 64])), lambda: draw(b62, r.randint(24, 48)), lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + draw(b62, 36), lambda: draw(b62 + "+/", 40), lambda: draw(b62 + "-_", 43)])()
        if r.random() < 0.15:
            body = body.upper()
        if r.random() < 0.12:  # a password of any make, or a key of letters alone
            body = r.choice([lambda: draw(b62, r.randint(8, 14)) + r.choice("!$%&*?"), lambda: draw(string.ascii_letters, r.randint(20, 32)), lambda: word() + draw("!@#$%", 1) + draw(string.digits, 3)])()
            return r.choice(['password = "{s}"', "passwd={s}", "pwd: {s}", 'secret = "{s}"', "{{'token': '{s}'}}"]).format(s=body)
        lead = r.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "client_secret", "Bearer", "TOKEN", "private key", "SECRET_KEY"])
        form = r.choice(['{k} = "{s}"', "{k}={s}", "{k}: {s}", "{k} = '{s}'", '"{k}": "{s}"', "{k} {s}", '{k} = "{s}"###'])
        if r.random() < 0.12:
            form = '"{s}"'
        return form.format(k=lead, s=body)

    def other() -> str:
        return r.choice(
            [
                lambda: draw(string.digits, r.choice([16, 16, 18, 20])),
                lambda: f"commit {draw(hexa, 40)}",
                lambda: f"sha256 checksum {draw(hexa, 64)}",
                lambda: f"md5: {draw(hexa, 32)}",
                lambda: f"https://www.example.com/{word()}/{word()}-{draw(string.digits, 5)}/{word()}",
                lambda: f"/{word()}/{word()}/{word()}_{draw(string.digits, 4)}.html",
                lambda: f"{word()}{word()}{word()}{draw(string.digits, r.randint(1, 4))}{word()}",
                lambda: f"{word()}_{word()}_{word()}_{draw(string.digits, 2)}-{word()}",
                lambda: f"20{draw(string.digits, 2)}-0{draw('123456789', 1)}-1{draw(string.digits, 1)}T10-22-33",
                lambda: f"order {draw(string.digits, 17)}",
                lambda: f"uuid {draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}",
                lambda: f"token {word()}{word()}{word()}{word()}{draw(string.digits, 1)}",
                lambda: f"name={word()}-{word()}-{word()}-{draw(string.digits, 3)}",
                lambda: (word() * 6)[:24] + draw(string.digits, 1),
                lambda: f"the key {draw('01', 20)}",
                lambda: f"card: {draw(string.digits, 16)}",
                lambda: f"{r.choice(['password', 'token', 'secret'])}: {r.choice(['required', 'optional', 'string', 'undefined', 'process.env', 'changes', 'see ' + word()])}",
                lambda: f"{r.choice(['password', 'token', 'api_key'])} = {r.choice(['get_', 'config.', 'self.', 'read_'])}{word()}()",
                lambda: "".join(word().title() for _ in range(3)) + r.choice(["Factory", "Exception", "ServiceImpl"]),
                lambda: " ".join([(word() * 5)[:18].upper()]),
            ]
        )()

    out = []
    for i in range(n):
        label = i % 2
        middle = secret() if label else other()
        if r.random() < 0.1:
            middle = middle.upper()
        out.append({"text": f"{some(4)} {middle} {some(4)}", "label": label})
    return out


def with_hits(df: DataFrame, text: str, name: str, context: Context | None = None) -> DataFrame:
    """df with an array of its candidates: start (in characters from 0), token, feature numbers; and the gaps between.
    Starts are summed up in blocks of BLOCK candidates, so that a text of many copies no long array for each."""
    context = context or plain_context()
    t, empty = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    sets, runs = t.rlike(SETS), t.rlike(RUN)
    gaps = F.when(sets, F.split(t, CANDIDATE, -1)).when(runs, F.split(t, RUN, -1)).otherwise(F.array(t))
    tokens = F.when(sets, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).when(runs, F.regexp_extract_all(t, F.lit(RUN), F.lit(0))).otherwise(empty)
    out = df.withColumn("__gaps", gaps).withColumn("__tokens", tokens)

    def placed(p: Column) -> Column:
        """Bound to names, so that nothing here is computed anew for each candidate."""
        moved = lambda i: F.char_length(F.element_at(p["gaps"], i)) + F.char_length(F.element_at(p["tokens"], i))
        size = F.array_size(p["tokens"])

        def block(k: Column, begin: Column) -> Column:
            """Where the candidates of a block end; the first follows `begin`."""
            own = F.sequence(k * BLOCK + 1, F.least((k + 1) * BLOCK, size))
            return F.aggregate(own, F.array(begin), lambda a, i: F.array_append(a, (F.element_at(a, -1) + moved(i)).cast("int")))

        blocks = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda a, k: let(block(k, F.element_at(a, -1)), lambda e: F.concat(a, F.slice(e, F.lit(2), F.size(e)))))

        def one(token: Column, i: Column, ends: Column) -> Column:
            before, after = F.element_at(p["gaps"], i + 1), F.element_at(p["gaps"], i + 2)
            return F.struct((F.element_at(ends, i + 1) + F.char_length(before)).cast("int").alias("start"), token.alias("token"), F.array(*features(token, before, after, context)).alias("f"))

        return let(ends, lambda e: F.transform(p["tokens"], lambda token, i: one(token, i, e)))

    hits = let(F.struct(F.col("__gaps").alias("gaps"), F.col("__tokens").alias("tokens")), placed)
    none = F.array().cast("array<struct<start:int,token:string,f:array<double>>>")
    return out.withColumn(name, F.when(F.array_size("__tokens") > 0, hits).otherwise(none)).drop("__tokens")


#: Candidates of a text whose places are summed up together.
BLOCK = 64


@dataclass
class Forest:
    nodes: list[trees.Node]
    context: Context | None = None

    def sql(self, numbers: str) -> str:
        """The score, as SQL over the array of feature numbers by that name."""
        return f"({' + '.join(trees.tree_sql(node, numbers) for node in self.nodes)}) / {len(self.nodes)}D"

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([trees.predict(n, x) for n in self.nodes], axis=0)


def fit_forest(x: np.ndarray, y: np.ndarray, n_trees: int = 15, depth: int = 6, seed: int = 0) -> Forest:
    """Bootstrap samples of the rows, features drawn at each split; one class or no rows: its share."""
    if not len(y):
        return Forest([trees.Node(0.5)])
    rng, grower = np.random.default_rng(seed), trees.Grower(x)
    draws = [np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) for _ in range(n_trees)]
    return Forest([grower.grow(y, w, depth, least=3, features=5, rng=rng) for w in draws])


def train(spark: SparkSession, findings: DataFrame | None = None, corpus: DataFrame | None = None, most_rows: int = 20_000, seed: int = 0) -> Forest:
    """findings: text with one candidate or more and label (1: secret), at most most_rows of them, first by a hash of
    the text; the rows of labelled_findings() if None. corpus: documents in which words and letter transitions are counted,
    all of them; without it they are those of labelled_findings(). Null texts and labels take no part; ties of the hash go
    by the text. Without findings the forest says a half."""
    rows = literal_table(spark, labelled_findings(seed=seed), "text:string,label:int") if findings is None else findings
    rows = rows.select("text", "label").where("text is not null and label is not null").orderBy(F.xxhash64("text", F.lit(seed)), "text", "label").limit(most_rows)
    context = plain_context()
    if corpus is not None or findings is not None:
        gaps = with_hits(rows, "text", "__hits", context).select("label", F.transform(F.slice("__gaps", 1, F.size("__hits")), lambda g: F.right(g, F.lit(BESIDE))).alias("g"))
        said = [(_before(g), r["label"]) for r in gaps.collect() for g in r["g"]]  # most_rows short texts
        words, transitions = (context.words, context.transitions) if corpus is None else corpus_language(corpus)
        context = Context(words, transitions, _odds(sorted(said)))
    got = with_hits(rows, "text", "__hits", context).select("label", F.explode("__hits.f").alias("f")).collect()
    got.sort(key=lambda r: (list(r["f"]), r["label"]))
    forest = fit_forest(np.array([r["f"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], float), seed=seed)
    forest.context = context
    return forest


def scan(documents: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Every candidate of every whole text: doc_id, start and length (characters), token_sha256, score, is_secret.

    Null and empty texts have none; repeated rows give their findings again, equal tokens in equal surroundings equal
    scores; a score equal to threshold is a secret; other columns take no part; an empty table gives no rows. The secrets
    themselves are not returned."""
    rows = documents.select("doc_id", "text").where(F.col("text").rlike(SETS) | F.col("text").rlike(RUN))
    # outer: Spark would compute all candidates once more to leave rows without any out beforehand
    hits = with_hits(rows, "text", "__hits", forest.context).select("doc_id", F.explode_outer("__hits").alias("h")).where("h is not null")
    scored = hits.select("doc_id", "h.start", F.char_length("h.token").alias("length"), F.sha2(F.col("h.token").cast("binary"), 256).alias("token_sha256"), F.expr(forest.sql("h.f")).alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def redact(documents: DataFrame, forest: Forest, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """documents with each secret in text replaced by mark; all else, nulls, empty texts and repeated rows too, stays as it
    is, whatever other columns are called. An empty table gives no rows."""
    columns, held = documents.columns, documents.select(F.struct("*").alias("row"), "text")
    out = with_hits(held, "text", "__hits", forest.context)
    scores = F.expr(f"transform(__hits, h -> {forest.sql('h.f')})")
    said = F.zip_with("__hits", scores, lambda h, s: F.when(s >= threshold, F.lit(mark)).otherwise(h["token"]))
    n = F.array_size("__gaps")
    pieces = lambda s: F.transform("__gaps", lambda g, i: F.concat(g, F.when(i < n - 1, F.element_at(s, i + 1)).otherwise(F.lit(""))))
    text = F.when(F.array_size("__hits") > 0, let(said, lambda s: F.array_join(pieces(s), ""))).otherwise(F.col("text"))
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])
