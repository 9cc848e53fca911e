"""Substring dedup: recurring passages are confirmed in Spark, then located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import NULL_ID, Scratch

#: Patterns in one automaton.
SHARD_PATTERNS = 200_000
#: Words to each side of a block up to which a run is followed at once; longer runs have more blocks.
REACH = 48
#: Requests (a window for a batch) that one task answers for an owner, about.
MOST_REQUESTS = 2_000_000
OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>, kept string"


def window_hashes(words: list[bytes], at: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words within one document with an id, and the words where they begin."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, _ = shared.word_hashes(words)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    inside = np.zeros(n, bool)
    for k in np.flatnonzero(np.diff(at) >= size):
        inside[at[k] : at[k + 1] - size + 1] = ids[k] != NULL_ID
    starts = np.flatnonzero(inside)
    return shared.mix(out[starts]), starts


def _flat(column) -> list:
    return column.to_pylist()


def locate(texts: list[list[bytes]], ids: list[int], passages: list[tuple[int, list[bytes]]], size: int) -> list[bytearray]:
    """For each text (words) a mask of the words in runs of `size` or more that a passage of an earlier document holds:
    passages are (doc_id, words).

    The automata's patterns are a passage's blocks of (size + 1) // 2 words side by side: any run of `size` words holds
    one whole. A word is three letters, of an alphabet for each place, so that the nodes of an automaton have few children
    and blocks begin where words do. Where a block occurs, the run is followed to both sides, up to REACH words from the
    block, unless the mask already has all that a run through the block of `size` words could add."""
    import ahocorasick

    masks = [bytearray(len(ws)) for ws in texts]
    block, k = (size + 1) // 2, 0
    beside = (size - block + 1) // 2
    base, other = 64, "\1\1\1"
    while k < len(passages):
        letters: dict[bytes, str] = {}
        patterns: dict[str, list[tuple[int, int]]] = {}
        lines: list[tuple[int, list[bytes]]] = []
        while k < len(passages) and len(patterns) < SHARD_PATTERNS and len(letters) < base**3 - 2 * len(passages[k][1]):
            doc, ws = passages[k]
            for w in ws:
                if w not in letters:
                    c = len(letters)
                    letters[w] = chr(32 + c % base) + chr(32 + base + c // base % base) + chr(32 + 2 * base + c // base**2)
            s = "".join([letters[w] for w in ws])
            for i in range(0, len(ws) - block + 1, block):
                patterns.setdefault(s[3 * i : 3 * (i + block)], []).append((len(lines), i))
            lines.append((doc, ws))
            k += 1
        if not lines:  # one passage with more words than letters: in halves that overlap by a run
            doc, ws = passages[k]
            half = len(ws) // 2
            passages = [*passages[:k], (doc, ws[: half + size - 1]), (doc, ws[half:]), *passages[k + 1 :]]
            continue
        machine = ahocorasick.Automaton()
        for p, where in patterns.items():
            # a run of `size` words goes on from the block by `beside` words to one side at least: of a block that many
            # passages hold, only those with the same words there can match
            sides: dict[tuple, list[tuple[int, int]]] | None = None
            if len(where) > 4:
                sides = {}
                for line, i in where:
                    ws = lines[line][1]
                    if i >= beside:
                        sides.setdefault((0, *ws[i - beside : i]), []).append((line, i))
                    if i + block + beside <= len(ws):
                        sides.setdefault((1, *ws[i + block : i + block + beside]), []).append((line, i))
            machine.add_word(p, (where, sides))
        machine.make_automaton()
        get = letters.get
        for t, text in enumerate(texts):
            if len(text) < size or ids[t] == NULL_ID:
                continue
            own, n, mask = ids[t], len(text), masks[t]
            for stop, (where, sides) in machine.iter("".join([get(w, other) for w in text])):
                end = stop // 3
                at = end - block + 1
                lo, hi = max(0, end - size + 1), min(n, at + size)
                if mask.find(0, lo, hi) < 0:  # all that a run of this block could remove is gone
                    continue
                if sides is not None:
                    where = sides.get((0, *text[max(0, at - beside) : at]), []) + sides.get((1, *text[end + 1 : end + 1 + beside]), [])
                for line, i in where:
                    doc, ws = lines[line]
                    if doc >= own:
                        continue
                    a, x, least = at, i, max(0, at - REACH)
                    while a > least and x and text[a - 1] == ws[x - 1]:
                        a, x = a - 1, x - 1
                    b, y, most, m = end + 1, i + block, min(n, end + REACH), len(ws)
                    while b < most and y < m and text[b] == ws[y]:
                        b, y = b + 1, y + 1
                    if b - a >= size:
                        mask[a:b] = b"\1" * (b - a)
                        if mask.find(0, lo, hi) < 0:
                            break
    return masks


def remove_repeats(documents: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Words covered by a window of `window` consecutive words whose sequence also starts in a document with a smaller
    doc_id: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), spans (runs of removed
    words, first and last), kept (the kept words, if with_text). Windows are judged on the input.

    1. Whole texts are written in batches, which later steps read again.
    2. Confirm: each batch sends every different window once, as a hash with its first document; what occurs in two
       documents is recurring, its owner being the one with the smallest id. A passage that a third of all documents
       hold sends a row for each batch at most.
    3. Owners' batches send the recurring passages, as text, to the batches that hold them; a batch that many ask goes to
       several tasks, each for a part of those that ask.
    4. Each batch compiles its passages into automata and streams its documents through them. Texts decide, not hashes;
       64-bit hashes that meet by chance could at worst hide an owner, once in about 10^10 windows at 10^10 windows.

    Words are [^\\x20\\x09-\\x0D]+. Null and empty texts: no words. Whole texts count, of any length; a text of more than
    a batch is a batch. Other columns take no part. Rows with equal doc_id don't remove from each other;
    each is judged alone. A null doc_id neither removes nor loses words. An empty table: no rows."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "repeats")
    batches = scratch.save(shared.text_batches(documents), "batches")
    buckets = max(shared.partitions(spark), batches.count() // 4)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, texts = shared.open_batch(row["ids"], row["lens"], row["texts"])
                words, at = shared.words_of(texts)
                h, starts = window_hashes(words, at, ids, window)
                del words, texts
                if not len(h):
                    continue
                doc = ids[np.searchsorted(at, starts, side="right") - 1]  # a document without words begins where the next does
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                last = np.concatenate([first[1:], [len(h)]]) - 1
                one, more = doc[first], (doc[last] > doc[first])  # ids ascend within a batch
                h = h[first]
                cut = shared.bucket_bounds(h, buckets)
                some = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(some, pa.int64()),
                        "batch": pa.array([row["batch"]] * len(some), pa.int64()),
                        "hashes": pa.array([shared.pack_sorted(h[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                        "docs": pa.array([shared.pack_planes(one[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                        "more": pa.array([shared.pack(np.packbits(more[cut[b] : cut[b + 1]])) for b in some], pa.binary()),
                    }
                )

    def confirm(table: pa.Table) -> pa.Table:
        of = table.column("batch").to_pylist()
        hs = [shared.unpack_sorted(x) for x in _flat(table.column("hashes"))]
        n = [len(x) for x in hs]
        h = np.concatenate(hs)
        doc = np.concatenate([shared.unpack_planes(x) for x in _flat(table.column("docs"))])
        more = np.concatenate([np.unpackbits(shared.unpack(x, np.uint8), count=k) for x, k in zip(_flat(table.column("more")), n, strict=True)]).astype(bool)
        src = np.repeat(np.arange(len(n)), n)
        order = np.argsort(h, kind="stable")
        h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        doc, more, src = doc[order], more[order], src[order]
        least = np.repeat(np.minimum.reduceat(doc, starts), sizes)
        hit = (doc > least) | more
        group = np.repeat(np.arange(len(starts)), sizes)
        owner = np.zeros(len(starts), np.int64)
        mine = np.flatnonzero(doc == least)[::-1]
        owner[group[mine]] = src[mine]
        rows = np.flatnonzero(hit)
        out = {"owner": [], "n": [], "hashes": [], "targets": []}
        if len(rows):
            who = owner[group[rows]]
            by = np.argsort(who, kind="stable")
            rows, who = rows[by], who[by]
            cut = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(rows)]
            names = np.array(of, np.int64)
            for a, b in zip(cut, cut[1:], strict=False):
                out["owner"].append(of[who[a]])
                out["n"].append(b - a)
                out["hashes"].append(shared.pack_sorted(h[rows[a:b]]))
                out["targets"].append(shared.pack_planes(names[src[rows[a:b]]]))
        return pa.table({"owner": pa.array(out["owner"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "hashes": pa.array(out["hashes"], pa.binary()), "targets": pa.array(out["targets"], pa.binary())})

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Requests to an owner in as many parts as it has, by target: what one target asks for stays together."""
        for part in parts:
            out = {"owner": [], "part": [], "hashes": [], "targets": []}
            for row in part.to_pylist():
                h, t = shared.unpack_sorted(row["hashes"]), shared.unpack_planes(row["targets"])
                to = shared.mix(t.view(np.uint64)) % np.uint64(row["parts"])
                for k in np.unique(to):
                    out["owner"].append(row["owner"])
                    out["part"].append(int(k))
                    out["hashes"].append(shared.pack_sorted(h[to == k]))
                    out["targets"].append(shared.pack_planes(t[to == k]))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k in ("hashes", "targets") else pa.int64()) for k, v in out.items()})

    def passages(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"target": [], "docs": [], "texts": []}
        for row in own.to_pylist() if asked.num_rows else []:
            ids, texts = shared.open_batch(row["ids"], row["lens"], row["texts"])
            words, at = shared.words_of(texts)
            h, starts = window_hashes(words, at, ids, window)
            uniq, first = np.unique(h, return_index=True)  # in order of ids: the owner's
            wanted = np.concatenate([shared.unpack_sorted(x) for x in _flat(asked.column("hashes"))])
            target = np.concatenate([shared.unpack_planes(x) for x in _flat(asked.column("targets"))])
            place = starts[first[np.searchsorted(uniq, wanted)]]
            order = np.lexsort((place, target))
            place, target = place[order], target[order]
            doc = np.searchsorted(at, place, side="right") - 1
            new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (target[1:] != target[:-1]) | (doc[1:] != doc[:-1])])
            runs = np.flatnonzero(new)
            ends = np.concatenate([runs[1:], [len(place)]]) - 1
            for t in np.unique(target):
                mine = runs[target[runs] == t] if len(runs) < 64 else runs[np.searchsorted(target[runs], t) : np.searchsorted(target[runs], t, side="right")]
                upto = ends[np.searchsorted(runs, mine)]
                out["target"].append(int(t))
                out["docs"].append(shared.pack_planes(ids[doc[mine]]))
                raw = b"\n".join(b" ".join(words[place[a] : place[b] + window]) for a, b in zip(mine, upto, strict=True))
                out["texts"].append(shared.squeeze(raw))
        return pa.table({"target": pa.array(out["target"], pa.int64()), "docs": pa.array(out["docs"], pa.binary()), "texts": pa.array(out["texts"], pa.binary())})

    def judge(key, own: pa.Table, sent: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept")}
        for row in own.to_pylist():
            ids, texts = shared.open_batch(row["ids"], row["lens"], row["texts"])
            split, ids = [(t or b"").split() for t in texts], ids.tolist()
            del texts
            found: list[tuple[int, list[bytes]]] = []
            for docs, raw in zip(_flat(sent.column("docs")), _flat(sent.column("texts")), strict=True):
                found += zip(shared.unpack_planes(docs).tolist(), (x.split(b" ") for x in shared.expand(raw).split(b"\n")), strict=True)
            for doc, ws, mask in zip(ids, split, locate(split, ids, found, window), strict=True):
                spans, at = [], mask.find(1)
                while at >= 0:
                    stop = mask.find(0, at)
                    stop = len(mask) if stop < 0 else stop
                    spans.append((at, stop - 1))
                    at = mask.find(1, stop)
                kept, begin = [], 0
                for a, b in spans:
                    kept += ws[begin:a]
                    begin = b + 1
                raw = b" ".join(kept + ws[begin:] if spans else ws)
                out["doc_id"].append(None if doc == NULL_ID else doc)
                out["n_words"].append(len(ws))
                out["n_removed"].append(sum(b - a + 1 for a, b in spans))
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["spans"].append([{"first": a, "last": b} for a, b in spans])
                out["kept"].append(raw.decode() if with_text else None)
        kinds = {"kept_sha256": pa.string(), "kept": pa.string(), "spans": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    sent = batches.mapInArrow(send, "bucket long, batch long, hashes binary, docs binary, more binary")
    asked = scratch.save(sent.groupBy("bucket").applyInArrow(confirm, "owner long, n long, hashes binary, targets binary"), "asked")
    # an owner with more requests than a task should hold goes to several, each with a part of the targets
    loads = asked.groupBy("owner").agg(F.ceil(F.sum("n") / MOST_REQUESTS).cast("int").alias("parts"))
    loads = shared.counted_broadcast(scratch.save(loads, "loads"))  # a row for each batch at most
    own = batches.join(loads, F.col("batch") == F.col("owner")).select(*batches.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    few = asked.join(loads, "owner")
    whole = few.where("parts = 1").select("owner", F.lit(0).cast("long").alias("part"), "hashes", "targets")
    split = few.where("parts > 1").select("owner", "parts", "hashes", "targets").mapInArrow(deal, "owner long, part long, hashes binary, targets binary")
    dealt = whole.unionByName(split).withColumnRenamed("part", "of")
    found = own.groupBy("batch", "part").cogroup(dealt.groupBy("owner", "of")).applyInArrow(passages, "target long, docs binary, texts binary")
    found = scratch.save(found, "found")
    scratch.drop("asked")
    return batches.groupBy("batch").cogroup(found.groupBy("target")).applyInArrow(judge, OUT_DDL)
