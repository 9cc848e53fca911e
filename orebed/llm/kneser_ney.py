"""Interpolated modified Kneser-Ney language model of word pairs, kept as sorted hash arrays in shards."""

from __future__ import annotations

import mmap
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import NULL_ID, Scratch, pack, pack_planes, pack_sorted, unpack, unpack_planes, unpack_sorted

CODED_DDL = "batch long, ids binary, lens binary, hashes binary, codes binary"
SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Hashes of the marks that no word is: the begin of a text as a context, and its end as a token.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def trains(doc_id: int) -> bool:
    """Documents to learn from: crc32 of the id as text, modulo 7, is not 2; none with a null id."""
    return doc_id != NULL_ID and zlib.crc32(str(doc_id).encode()) % 7 != 2


def coded_batches(documents: DataFrame, most_words: int = 1_000_000) -> DataFrame:
    """Whole texts as codes of words (A-Z lower-cased), in batches of about most_words words: ids, lens (words by
    document), hashes (of the words by code, ascending; END and BEGIN among them), codes. A longer text is a batch of
    its own. Must be saved before two steps read it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq, ids, lens, words = TaskContext.get().partitionId() << 32, 0, [], [], []

        def flush():
            h, code = shared.word_hashes(words)
            del code
            hashes, codes = np.unique(np.concatenate([h, np.array([BEGIN, END], np.uint64)]), return_inverse=True)
            return pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([first + seq], pa.int64()),
                    "ids": pa.array([pack(np.array(ids, np.int64))], pa.binary()),
                    "lens": pa.array([pack(np.array(lens, np.int64))], pa.binary()),
                    "hashes": pa.array([pack_sorted(hashes)], pa.binary()),
                    "codes": pa.array([pack(np.ascontiguousarray(codes[:-2].astype(np.uint32)).view(np.uint8).reshape(-1, 4).T)], pa.binary()),
                }
            )

        for part in shared.few_rows(parts):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = (t or b"").translate(shared.UPPER).split()
                ids.append(NULL_ID if i is None else i)
                lens.append(len(own))
                words += own
                if len(words) >= most_words:
                    yield flush()
                    seq, ids, lens, words = seq + 1, [], [], []
        if ids:
            yield flush()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CODED_DDL)


def open_coded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, tokens by document, hashes by code, and the codes of each token and of the one before it."""
    ids, lens, hashes = unpack(row["ids"], np.int64), unpack(row["lens"], np.int64), unpack_sorted(row["hashes"])
    codes = np.ascontiguousarray(unpack(row["codes"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    now = np.insert(codes, at[1:], np.searchsorted(hashes, END))
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[at[:-1] + np.arange(len(lens))] = np.searchsorted(hashes, BEGIN)
    return ids, lens + 1, hashes, now, before


def pair_hash(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return shared.mix(before * np.uint64(0x9E3779B97F4A7C15) + now)


def pair_buckets(before: np.ndarray, pairs: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The shard of each pair: by the range that its context's hash is in; of a hot context, by the pair's own hash."""
    by = np.where(np.isin(before, hot), pairs, before) if len(hot) else before
    return np.searchsorted(_edges(buckets), by, side="right")


def in_turn(hashes: np.ndarray, before: np.ndarray, hot: np.ndarray, buckets: int, first: int, end: int) -> np.ndarray:
    """Which tokens have a context (a code of ascending hashes) whose pairs may lie in the shards from first to end."""
    lo, hi = np.searchsorted(hashes, _range_begin(first, buckets)), np.searchsorted(hashes, _range_begin(end, buckets)) if end < buckets else len(hashes)
    takes = np.zeros(len(hashes), bool)
    takes[lo:hi] = True
    takes[np.searchsorted(hashes, hot[np.isin(hot, hashes)])] = True
    return takes[before]


def _range_begin(bucket: int, buckets: int) -> np.uint64:
    return np.uint64(-(-(bucket << 64) // buckets))


def turn_ranges(buckets: int, turns: int) -> list[tuple[int, int]]:
    turns = min(turns, buckets)
    return [(buckets * t // turns, buckets * (t + 1) // turns) for t in range(turns)]


def _edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many things have counts 1 to 4."""
    n1, n2, n3, n4 = (max(0, x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file without a name, memory-mapped; the file goes with the last of them."""
    with tempfile.TemporaryFile() as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
        f.flush()
        size = sum(a.nbytes for a in arrays)
        if not size:
            return arrays
        m = mmap.mmap(f.fileno(), size, access=mmap.ACCESS_READ)
    out, at = [], 0
    for a in arrays:
        out.append(np.frombuffer(m, a.dtype, len(a), at))
        at += a.nbytes
    return out


def look_up(keys: np.ndarray, values: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    """The values of ascending keys for what is asked, 0 where it isn't among them."""
    if not len(keys):
        return [np.zeros(len(asked), np.int64) for _ in values]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return [np.where(hit, v[at], 0) for v in values]


@dataclass
class Model:
    """Shards (bucket, and packed arrays, in two rows: pairs with counts and contexts with four sums; words with counts and
    continuation counts), a table for each range of buckets from first to end, and what all of them share."""

    shards: list[tuple[int, int, DataFrame]]
    buckets: int
    tokens: int
    vocabulary: int
    pairs: int
    word_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_rest: float
    hot: dict[int, tuple[int, int, int, int]]


#: Contexts at most whose pairs lie in all shards; their list goes to the driver and to all tasks.
MOST_HOT = 4096


def train(coded: DataFrame, scratch: Scratch, turns: int = 4) -> Model:
    """Counts all pairs of tokens of the training documents. Batches count before they send; a context with more than
    1 / (2 * shards) of the tokens has its pairs in all shards. There are at most MOST_HOT such contexts: with more shards
    than half of that, a context needs 1 / MOST_HOT of the tokens, and those with fewer fill a shard alone at worst.
    Ranges of shards take turns, so that not all pairs lie on disk at once; a turn handles only its own tokens."""
    spark = coded.sparkSession
    buckets = max(shared.partitions(spark), coded.count() // 4)
    words_ddl = "bucket long, hashes binary, counts binary"

    def by_range(h: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
        cut = shared.bucket_bounds(h, buckets)
        for b in np.flatnonzero(cut[1:] > cut[:-1]):
            yield (int(b), pack_sorted(h[cut[b] : cut[b + 1]]), *(pack_planes(v[cut[b] : cut[b + 1]]) for v in values))

    def rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = {n: pa.int64() if n == "bucket" else pa.binary() for n in names}
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)})

    def training(row: dict):
        ids, lens, hashes, now, before = open_coded(row)
        keep = np.repeat(np.fromiter(map(trains, ids.tolist()), bool, len(ids)), lens)
        return hashes, now[keep], before[keep]

    def send_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                hashes, now, _ = training(row)
                n = np.bincount(now, minlength=len(hashes))
                some = n > 0
                yield rows_of(list(by_range(hashes[some], n[some])), ["bucket", "hashes", "counts"])

    def merged(table: pa.Table, keys: str = "hashes", values: str = "counts"):
        return _sum_by(np.concatenate([unpack_sorted(x) for x in table.column(keys).to_pylist()]), np.concatenate([unpack_planes(x) for x in table.column(values).to_pylist()]))

    def sum_words(table: pa.Table) -> pa.Table:
        h, n = merged(table)
        return pa.table({"bucket": table.column("bucket")[:1], "hashes": [pack_sorted(h)], "counts": [pack_planes(n)], "tokens": [int(n.sum())], "kinds": [len(h)]})

    words = coded.mapInArrow(send_words, words_ddl).groupBy("bucket").applyInArrow(sum_words, f"{words_ddl}, tokens long, kinds long")
    words = scratch.save(words, "words")
    tokens, vocabulary = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("kinds")).first())
    limit = max(1000, tokens // min(2 * buckets, MOST_HOT - 1))

    def frequent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for h, n in zip(part.column("hashes").to_pylist(), part.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"h": pa.array(unpack_sorted(h)[unpack_planes(n) > limit].view(np.int64), pa.int64())})

    # MOST_HOT - 1 words at most have so many tokens; BEGIN is a context of every text
    hot = np.array(sorted({r[0] for r in words.select("hashes", "counts").mapInArrow(frequent, "h long").collect()} | {int(BEGIN.view(np.int64))}), np.int64).view(np.uint64)

    def send_pairs(parts: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                hashes, now, before = training(row)
                mine = in_turn(hashes, before, hot, buckets, lo, hi)
                now, before = now[mine], before[mine]
                pair, n = np.unique(before * len(hashes) + now, return_counts=True)
                a, b = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
                where = pair_buckets(a, pair_hash(a, b), hot, buckets)
                order = np.argsort(where, kind="stable")  # contexts ascend within a bucket
                a, b, n = a[order], b[order], n[order]
                cut = np.searchsorted(where[order], np.arange(buckets + 1))
                some = np.arange(lo, hi)
                some = some[cut[some + 1] > cut[some]]
                yield rows_of([(int(k), pack_sorted(a[cut[k] : cut[k + 1]]), pack_planes(b[cut[k] : cut[k + 1]].view(np.int64)), pack_planes(n[cut[k] : cut[k + 1]])) for k in some], ["bucket", "a", "b", "counts"])

    pair_ddl = (
        "bucket long, pairs binary, pair_counts binary, contexts binary, context_sums binary, kinds long, n1 long, n2 long, n3 long, n4 long, "
        "hot array<struct<a:long,c:long,n1:long,n2:long,n3:long>>, follows array<struct<bucket:long,hashes:binary,counts:binary>>"
    )

    def sum_pairs(table: pa.Table) -> pa.Table:
        a = np.concatenate([unpack_sorted(x) for x in table.column("a").to_pylist()])
        b = np.concatenate([unpack_planes(x) for x in table.column("b").to_pylist()]).view(np.uint64)
        n = np.concatenate([unpack_planes(x) for x in table.column("counts").to_pylist()])
        g = pair_hash(a, b)
        order = np.argsort(g, kind="stable")
        a, b, n, g = a[order], b[order], n[order], g[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        a, b, g, n = a[first], b[first], g[first], np.add.reduceat(n, first)
        one, two, more = ((n == k if k < 3 else n >= 3).astype(np.int64) for k in (1, 2, 3))
        ctx, c, n1, n2, n3 = _sum_by(a, n, one, two, more)
        is_hot = np.isin(ctx, hot)
        spread = [{"a": int(x.view(np.int64)), "c": int(p), "n1": int(q), "n2": int(r), "n3": int(s)} for x, p, q, r, s in zip(*(v[is_hot] for v in (ctx, c, n1, n2, n3)), strict=True)]
        word, follows = _sum_by(b, np.ones(len(b), np.int64))
        sums = np.concatenate([v[~is_hot] for v in (c, n1, n2, n3)])
        return pa.table(
            {
                "bucket": table.column("bucket")[:1],
                "pairs": pa.array([pack_sorted(g)], pa.binary()),
                "pair_counts": pa.array([pack_planes(n)], pa.binary()),
                "contexts": pa.array([pack_sorted(ctx[~is_hot])], pa.binary()),
                "context_sums": pa.array([pack_planes(sums)], pa.binary()),
                "kinds": [len(g)],
                **{f"n{k}": [int((n == k).sum())] for k in (1, 2, 3, 4)},
                "hot": pa.array([spread], pa.list_(pa.struct([(k, pa.int64()) for k in ("a", "c", "n1", "n2", "n3")]))),
                "follows": pa.array([[{"bucket": k, "hashes": h, "counts": v} for k, h, v in by_range(word, follows)]], pa.list_(pa.struct([("bucket", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))),
            }
        )

    ranges, halves = turn_ranges(buckets, turns), []
    for turn, (lo, hi) in enumerate(ranges):
        sent = coded.mapInArrow(lambda parts, lo=lo, hi=hi: send_pairs(parts, lo, hi), "bucket long, a binary, b binary, counts binary")
        halves.append(scratch.save(sent.groupBy("bucket").applyInArrow(sum_pairs, pair_ddl), f"pairs-{turn}"))
        del sent
    counted = reduce(DataFrame.unionByName, halves)
    got = counted.agg(*[F.sum(c) for c in ("kinds", "n1", "n2", "n3", "n4")]).first()
    pairs, pair_d = int(got[0] or 0), discounts([int(x or 0) for x in got[1:]])
    spread = counted.select(F.explode("hot").alias("h")).groupBy("h.a").agg(*[F.sum(f"h.{k}") for k in ("c", "n1", "n2", "n3")]).collect()
    hot_sums = {r[0]: tuple(r[1:]) for r in spread}

    def join_words(key, own: pa.Table, follows: pa.Table) -> pa.Table:
        """Continuation counts beside the counts: the words are the same, as every token follows something."""
        out = {"bucket": pa.array([key[0].as_py()], pa.int64())}
        h, n = merged(own)
        k, cont = merged(follows)
        cont = look_up(k, [cont], h)[0]
        out |= {"words": pa.array([pack_sorted(h)], pa.binary()), "word_counts": pa.array([pack_planes(n)], pa.binary()), "conts": pa.array([pack_planes(cont)], pa.binary())}
        out |= {f"m{i}": pa.array([int((cont == i).sum())], pa.int64()) for i in (1, 2, 3, 4)} | {"m5": pa.array([int((cont >= 3).sum())], pa.int64())}
        return pa.table(out)

    follows = counted.select(F.explode("follows").alias("f")).select(F.col("f.bucket").alias("to"), F.col("f.hashes").alias("hashes"), F.col("f.counts").alias("counts"))
    level = words.select("bucket", "hashes", "counts").groupBy("bucket").cogroup(follows.groupBy("to"))
    level = scratch.save(level.applyInArrow(join_words, "bucket long, words binary, word_counts binary, conts binary, m1 long, m2 long, m3 long, m4 long, m5 long"), "level")
    m = [int(x or 0) for x in level.agg(*[F.sum(f"m{i}") for i in (1, 2, 3, 4, 5)]).first()]
    word_d = discounts(m[:4])
    rest = (word_d[0] * m[0] + word_d[1] * m[1] + word_d[2] * m[4]) / pairs if pairs else 1.0
    scratch.drop("words")
    # a shard's pairs and words are two rows, which the answers put together: no join moves them before
    shards = []
    for (lo, hi), own in zip(ranges, halves, strict=True):
        pair_rows = own.select("bucket", "pairs", "pair_counts", "contexts", "context_sums", *[F.lit(None).cast("binary").alias(c) for c in ("words", "word_counts", "conts")])
        word_rows = level.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).select("bucket", "words", "word_counts", "conts")
        shards.append((lo, hi, pair_rows.unionByName(word_rows, allowMissingColumns=True)))
    return Model(shards, buckets, tokens, vocabulary, pairs, word_d, pair_d, rest, hot_sums)


def score(coded: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Each document's sums; see score_documents. Batches ask each shard once for all that they need of it; workers
    memory-map a shard's arrays while they answer. Ranges of shards take turns, so that not all questions lie on disk at once."""
    buckets, hot = model.buckets, np.array(sorted(model.hot), np.int64).view(np.uint64)

    def asks(row: dict):
        ids, lens, hashes, now, before = open_coded(row)
        pair, inverse = np.unique(before * len(hashes) + now, return_inverse=True)
        a, b = pair // len(hashes), pair % len(hashes)
        g = pair_hash(hashes[a], hashes[b])
        where = pair_buckets(hashes[a], g, hot, buckets)
        order = np.lexsort((g, where))
        return ids, lens, hashes, now, inverse, a, b, g, where, order

    def send(parts: Iterator[pa.RecordBatch], lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                _, _, hashes, now, before = open_coded(row)
                mine = in_turn(hashes, before, hot, buckets, lo, hi)
                pair = np.unique(before[mine] * len(hashes) + now[mine])
                a = hashes[pair // len(hashes)]
                g = pair_hash(a, hashes[pair % len(hashes)])
                where = pair_buckets(a, g, hot, buckets)
                order = np.lexsort((g, where))
                cut, pairs = shared.bucket_bounds(hashes, buckets), g[order]
                to = np.searchsorted(where[order], np.arange(buckets + 1))
                some = [k for k in range(lo, hi) if cut[k + 1] > cut[k] or to[k + 1] > to[k]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(some, pa.int64()),
                        "batch": pa.array([row["batch"]] * len(some), pa.int64()),
                        "words": pa.array([pack_sorted(hashes[cut[k] : cut[k + 1]]) for k in some], pa.binary()),
                        "pairs": pa.array([pack_sorted(pairs[to[k] : to[k + 1]]) for k in some], pa.binary()),
                    }
                )

    def answer(key, shard: pa.Table, asked: pa.Table) -> pa.Table:
        own = {k: v for r in shard.to_pylist() for k, v in r.items() if v is not None}
        opened = lambda name, f: f(own[name]) if own.get(name) else f(EMPTY[f])
        EMPTY = {unpack_sorted: pack_sorted(np.zeros(0, np.uint64)), unpack_planes: pack_planes(np.zeros(0, np.int64))}
        arrays = [opened(*x) for x in (("words", unpack_sorted), ("word_counts", unpack_planes), ("conts", unpack_planes), ("pairs", unpack_sorted), ("pair_counts", unpack_planes), ("contexts", unpack_sorted), ("context_sums", unpack_planes))]
        words, counts, conts, pairs, pair_counts, contexts, sums = mapped(arrays)
        del arrays, own
        out: dict[str, list] = {"batch": [], "bucket": [], "counts": [], "pairs": []}
        for batch, w, p in zip(asked.column("batch").to_pylist(), asked.column("words").to_pylist(), asked.column("pairs").to_pylist(), strict=True):
            w, p = unpack_sorted(w), unpack_sorted(p)
            of_words = look_up(words, [counts, conts], w) + look_up(contexts, list(sums.reshape(4, -1)) if len(sums) else [sums] * 4, w)
            out["batch"].append(batch)
            out["bucket"].append(key[0].as_py())
            out["counts"].append(pack_planes(np.concatenate(of_words)))
            out["pairs"].append(pack_planes(look_up(pairs, [pair_counts], p)[0]))
        kinds = {"counts": pa.binary(), "pairs": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    n_all, v_all, d2 = model.tokens, model.vocabulary, model.pair_discounts

    def combine(key, own: pa.Table, told: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for row in own.to_pylist():
            ids, lens, hashes, now, inverse, a, b, g, where, order = asks(row)
            replies = sorted(zip(told.column("bucket").to_pylist(), told.column("counts").to_pylist(), told.column("pairs").to_pylist(), strict=True))
            c, cont, ctx, n1, n2, n3 = np.concatenate([unpack_planes(r[1]).reshape(6, -1) for r in replies], axis=1)
            for h, s in model_hot.items():
                at = np.searchsorted(hashes, h)
                if at < len(hashes) and hashes[at] == h:
                    ctx[at], n1[at], n2[at], n3[at] = s
            of_pair = np.empty(len(g), np.int64)
            of_pair[order] = np.concatenate([unpack_planes(r[2]) for r in replies])
            low = (cont - _discount(cont, model_d1)) / max(1, model_pairs) + model_rest / (v_all + 1)
            total = np.maximum(ctx, 1)
            back = np.where(ctx > 0, (d2[0] * n1 + d2[1] * n2 + d2[2] * n3) / total, 1.0)
            p = np.maximum(of_pair - _discount(of_pair, d2), 0) / total[a] + back[a] * low[b]
            logs, base = np.log10(p)[inverse], np.log10((c + 1) / (n_all + v_all + 1))[now]
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            out["doc_id"] += [None if i == NULL_ID else i for i in ids.tolist()]
            out["held_out"] += [not trains(i) for i in ids.tolist()]
            out["n_tokens"] += lens.tolist()
            out["n_known"] += np.add.reduceat((c > 0)[now].astype(np.int64), at).tolist()
            out["train_tokens"] += [n_all] * len(ids)
            out["base_score"] += np.add.reduceat(base, at).tolist()
            out["score"] += np.add.reduceat(logs, at).tolist()
        kinds = {"held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    model_hot = {np.int64(k).view(np.uint64): v for k, v in model.hot.items()}
    model_d1, model_rest, model_pairs = model.word_discounts, model.word_rest, model.pairs
    told = []
    for turn, (lo, hi, shards) in enumerate(model.shards):
        asked = coded.mapInArrow(lambda parts, lo=lo, hi=hi: send(parts, lo, hi), "bucket long, batch long, words binary, pairs binary")
        answers = shards.withColumnRenamed("bucket", "shard").groupBy("shard").cogroup(asked.groupBy("bucket"))
        told.append(scratch.save(answers.applyInArrow(answer, "batch long, bucket long, counts binary, pairs binary"), f"replies-{turn}"))
        del asked, answers
    replies = reduce(DataFrame.unionByName, told).withColumnRenamed("batch", "of")
    return coded.groupBy("batch").cogroup(replies.groupBy("of")).applyInArrow(combine, SCORED_DDL)


def score_documents(documents: DataFrame) -> DataFrame:
    """Trains on the documents that trains() names and scores all: doc_id, held_out, n_tokens, n_known (tokens met in
    training), train_tokens, base_score (add-one unigrams, log10) and score (the model's log10 probability of the text).

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end for each text. Null and empty texts are the
    end alone; a null doc_id is scored but not learned from (held_out). Repeated rows count each. Words are known by
    64-bit hashes. An empty table gives no rows; without training documents every token has one probability."""
    scratch = Scratch(documents.sparkSession, "kneser-ney")
    coded = scratch.save(coded_batches(documents), "coded")
    scored = score(coded, train(coded, scratch), scratch)
    for name in ("level", *(f"pairs-{t}" for t in range(4))):  # the answers are stored
        scratch.drop(name)
    scratch.free()
    return scored
