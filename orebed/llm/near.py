"""Near-duplicate documents by one-permutation MinHash, with every link confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .shared import Scratch

SIGNED_DDL = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
#: Members that meet a star's centre in one task, and centres that meet them in the exact pass over what stars leave.
CHUNK, CENTRES = 128, 64


def shingle_set(text: bytes | None, size: int) -> tuple[np.ndarray, int, int]:
    """The ascending hashes of a text's different shingles (A-Z lower-cased), and two hashes of its word sequence."""
    import xxhash

    words = (text or b"").translate(shared.UPPER).split()
    if not words:
        return np.zeros(0, np.uint64), 0, 0
    line = b" ".join(words)
    k1, k2 = (xxhash.xxh3_64_intdigest(line, s) - (1 << 63) for s in (1, 2))
    if len(words) < size:  # one shingle, of a kind of its own
        return np.array([xxhash.xxh3_64_intdigest(line, 3)], np.uint64), k1, k2
    code = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, 17) for w in code), np.uint64, len(code))[codes]
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(shared.mix(out)), k1, k2


def probes(bins: int, seed: int = 7) -> np.ndarray:
    """For each bin an order of all bins of its own, in which an empty bin seeks one to copy."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One-permutation signature: the least hash in each of `bins` equal ranges; an empty bin copies the first that is
    not empty in its own order (optimal densification)."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    at, first = np.unique(at.astype(np.int64), return_index=True)
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at], full[at] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        seek = order[empty]
        out[empty] = out[seek[np.arange(len(empty)), full[seek].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(1, len(sig) // rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(rows):
            keys = shared.mix(keys * np.uint64(31) + sig[j::rows])
    return keys.view(np.int64)


def sign(documents: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probes(bands * rows)
        for part in shared.few_rows(parts):
            out = {k: [] for k in ("n_shingles", "k1", "k2", "bands")}
            for text in part.column(1).cast(pa.binary()).to_pylist():
                s, k1, k2 = shingle_set(text, size)
                out["n_shingles"].append(len(s))
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["bands"].append(band_keys(signature(s, bands * rows, order), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_shingles", "k1", "k2")), pa.array(out["bands"], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED_DDL)


def near_duplicates(
    documents: DataFrame, shingle_words: int = 5, least: tuple[int, int] = (80, 100), bands: int = 30, rows: int = 4
) -> DataFrame:
    """Components of documents linked by shingle sets with intersection / union >= least[0] / least[1]: doc_id,
    n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), a row for each row.

    1. Each text gets a one-permutation signature in bands; texts with one word sequence are one from here on.
    2. In each bucket one text, drawn by hash, is the centre of a star to all others; so a bucket gives a pair for each
       text at most. A centre's pairs are cut into chunks and confirmed on full sets, and linked texts joined.
    3. A bucket that still holds several components is compared exactly: all its texts, in chunks, meet the texts
       outside its most frequent component, in blocks, but those of one component and those whose numbers of shingles
       differ too much for a link; no other pair is left out.

    A pair at the threshold t misses all buckets with probability (1 - t^rows)^bands: 1e-7 as set here.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words than a shingle is one shingle, which
    equals no shingle of longer texts. Null and empty texts have no shingles and no links. Whole texts count, of any
    length. Rows of one doc_id are one document, linked by any of its texts; equal rows have equal results. Rows with a
    null doc_id link with nothing: component_id null, kept. Ties (equal texts): the smallest doc_id is kept. An empty
    table gives no rows. Columns other than doc_id and text take no part."""
    scratch = Scratch(documents.sparkSession, "near")
    signed = scratch.save(sign(documents, shingle_words, bands, rows), "signed")
    alike = signed.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    reps = scratch.save(alike, "reps")
    placed = reps.select("rep", "k1", "k2", "size", F.explode("bands").alias("bucket"))
    drawn = F.min(F.struct(F.xxhash64("rep", "bucket").alias("by"), "rep", "k1", "k2"))
    # written tables on both sides of a join by bucket, so that Spark can split the rows of a bucket that many texts share
    stars = scratch.save(placed.groupBy("bucket").agg(drawn.alias("c"), F.count("*").alias("n")).where("n > 1"), "stars")
    members = scratch.save(placed.join(stars, "bucket").select("bucket", "n", "rep", "k1", "k2", "size", F.col("c.rep").alias("centre"), F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2")), "members")
    # texts that any pair needs, by document and word sequence
    wanted = members.select("rep", "k1", "k2").distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    raw = docs.join(wanted.select("rep").distinct(), "rep", "left_semi").where("text is not null").dropDuplicates(["rep", "text"])
    size = shingle_words

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in shared.few_rows(parts):
            texts = p.column(1).cast(pa.binary()).to_pylist()
            keys = [shingle_set(t, size)[1:] for t in texts]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([shared.squeeze(t) for t in texts], pa.binary())], names=["rep", "k1", "k2", "text"])

    texts = raw.mapInArrow(keyed, "rep long, k1 long, k2 long, text binary").join(wanted, ["rep", "k1", "k2"], "left_semi")
    texts = scratch.save(texts.dropDuplicates(["rep", "k1", "k2"]), "texts")

    num, den = least

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        if den * min(len(a), len(b)) < num * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return den * both >= num * (len(a) + len(b) - both)

    def star(key, centre: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for c in centre.column("text_").to_pylist()[:1]:
            own = shingle_set(shared.expand(c), size)[0]
            for m, t in zip(others.column("rep").to_pylist(), others.column("text").to_pylist(), strict=True):
                if linked(own, shingle_set(shared.expand(t), size)[0]):
                    out.append(m)
        return pa.table({"a": pa.array([key[0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    pairs = members.where("not (rep = centre and k1 = c1 and k2 = c2)").select("centre", "c1", "c2", "rep", "k1", "k2").distinct()
    pairs = scratch.save(pairs, "pairs")
    chunks = scratch.save(pairs.groupBy("centre", "c1", "c2").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    salted = pairs.join(chunks, ["centre", "c1", "c2"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "k1"), F.col("chunks")).cast("int"))
    tested = salted.join(texts, ["rep", "k1", "k2"]).select("centre", "c1", "c2", "chunk", "rep", "text")
    of_centres = chunks.select("centre", "c1", "c2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    of_centres = of_centres.join(texts.select(F.col("rep").alias("centre"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "text"), ["centre", "c1", "c2"])
    by = ["centre", "c1", "c2", "chunk"]
    of_centres = of_centres.select(*[F.col(c).alias(f"{c}_") for c in (*by, "text")])
    links = of_centres.groupBy([f"{c}_" for c in by]).cogroup(tested.groupBy(by)).applyInArrow(star, "a long, b long")
    links = scratch.save(links, "links")
    first = components(links, scratch, "first")

    # buckets of three texts or more that still hold several components, once for each set of texts
    held = scratch.save(members.where("n > 2").select("bucket", "rep", "k1", "k2", "size").join(first, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "k1", "k2", "size", F.coalesce("component", "rep").alias("component")), "held")
    sums = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("rep", "k1").cast("decimal(38,0)")).alias("sum"))
    open_ = scratch.save(sums.where("lo < hi").groupBy("n", "sum").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")
    left = scratch.save(held.join(open_, "bucket"), "left")
    main = left.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    main = scratch.save(main, "main")
    # linked sets differ in size by the threshold at most: a set meets those of its own class of sizes and of the next ones
    of_size = F.floor(F.log(F.col("size").cast("double")) / (math.log(least[1] / least[0]) * (1 + 1e-9))).cast("int") if least[0] < least[1] else F.col("size").cast("int")
    marked = scratch.save(left.join(main, "bucket").withColumn("class", of_size), "marked")
    outside = marked.where("component <> main").groupBy("bucket", "class").agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("blocks"))
    around = marked.groupBy("bucket", F.col("class").alias("of")).count()
    around = around.select("bucket", "count", F.explode(F.array(*[F.col("of") + d for d in (-1, 0, 1)])).alias("class")).groupBy("bucket", "class").agg(F.ceil(F.sum("count") / CHUNK).cast("int").alias("chunks"))
    plan = scratch.save(outside.join(around, ["bucket", "class"]), "plan")
    with_text = marked.join(texts, ["rep", "k1", "k2"])
    block = F.pmod(F.xxhash64("k2", "rep"), F.col("blocks")).cast("int").alias("block")
    all_chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    centres = with_text.where("component <> main").join(plan, ["bucket", "class"]).select("bucket", "class", "rep", "component", "text", block, all_chunks)
    others = with_text.withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)]))).join(plan, ["bucket", "class"])
    others = others.select("bucket", "class", "rep", "component", "text", F.pmod(F.xxhash64("k1", "rep"), F.col("chunks")).cast("int").alias("chunk"), all_blocks)

    def exact(key, some: pa.Table, rest: pa.Table) -> pa.Table:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        a, b = [], []
        rows = lambda t, end="": list(zip(*(t.column(c + end).to_pylist() for c in ("rep", "component", "text")), strict=True))
        sets = [(r, c, shingle_set(shared.expand(t), size)[0]) for r, c, t in rows(some, "_")]
        for r, c, t in rows(rest):
            own = None
            for r2, c2, s2 in sets:
                if find(c) != find(c2):
                    own = shingle_set(shared.expand(t), size)[0] if own is None else own
                    if linked(own, s2):
                        a.append(r)
                        b.append(r2)
                        root[find(c)] = find(c2)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ["bucket", "class", "block", "chunk"]
    centres = centres.select(*[F.col(c).alias(f"{c}_") for c in (*by, "rep", "component", "text")])
    more = scratch.save(centres.groupBy([f"{c}_" for c in by]).cogroup(others.groupBy(by)).applyInArrow(exact, "a long, b long"), "more")
    # rows of one document with different texts are linked too, through the document
    same = signed.where("n_shingles > 0 and doc_id is not null").join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    own = same.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("n > 1 and lo < hi")
    through = same.join(own.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(through)
    last = components(joined, scratch, "last") if more.limit(1).count() or through.limit(1).count() else first
    at = signed.join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(last, F.coalesce("rep", "doc_id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.least(component, F.col("doc_id")))
    return at.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
