"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_rows, give_back

PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit. Open bins are kept by free space, with a bitset of the sizes that occur: the
    lowest set bit from an item's size up is the fullest bin that takes it. With `most_open` bins open and none that
    takes the item, the fullest closes first."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.by_free: dict[int, list[int]] = {}
        self.bits, self.open, self.bins = 0, 0, 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_ = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """The bin that takes an item of this size (1 to capacity), and where in it the item begins."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.bins
            self.bins += 1
        if free > size:
            self.by_free.setdefault(free - size, []).append(bin_)
            self.bits |= 1 << (free - size)
            self.open += 1
        return bin_, self.capacity - free


#: Bytes of words of letters up to U+00FF (UTF-8), and of those in lower case, which normalising leaves as they are.
LETTERS = string.ascii_letters.encode() + bytes([0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])
PLAIN = string.ascii_lowercase.encode() + bytes([0xC3, 0x9F, *(b for b in range(0xA0, 0xC0) if b != 0xB7)])


def _model_alone(path: str):
    """The tokenizer's model parted at white space alone, and the letters it has for bytes; (None, {}) if it isn't a
    byte-level model. It gives words of plain letters the same ids for less work."""
    import json

    from tokenizers import Tokenizer

    with open(path) as f:
        spec = json.load(f)
    if "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")):
        return None, {}
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    del letters[32]
    return Tokenizer.from_str(json.dumps(spec)), letters


class Words:
    """A tokenizer in a worker, with the ids of words met: two generations of cache_words at most."""

    #: The one that this worker process has, by name: its next tasks go on with it.
    kept: dict[str, Words] = {}

    def __init__(self, name: str):
        import os

        import public_tokenizers

        give_back()  # what the worker's earlier steps have left
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self.parting = self.encode(" \0 ")
        assert len(self.parting) == 1, "the tokenizer has no token of its own for the character 0"
        # words of ASCII letters, then signs, can be looked up in lower case and in two parts if the tokenizer parts them
        self.parted = all(np.array_equal(self.encode(a + b), np.concatenate([self.encode(a.lower()), self.encode(b)])) for a in ("Word", "tHe", "X") for b in (".", ",", "!!", "###", ".%&|", ":;?$*"))
        self.quick, self.byte_letters = _model_alone(public_tokenizers.path(name))
        same = ("the", "ment", "überß", "ñçéàÿ", "elleaux")
        if not (self.quick and self.parted and all(self.quick.encode(w.encode().decode("latin-1").translate(self.byte_letters)).ids == self.encode(w).tolist() for w in same)):
            self.quick = None

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @classmethod
    def of(cls, name: str) -> Words:
        if name not in cls.kept:
            cls.kept.clear()
            cls.kept[name] = cls(name)
        return cls.kept[name]


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 1, with_ids: bool = False, cache_words: int = 400_000
) -> DataFrame:
    """Each document's token ids and end_id, cut into pieces of max_len (the last may be shorter).

    tokenizer: name of a public_tokenizers file whose tokens never cross white space, with one token for the character
    0 between spaces, which parts the words that are encoded together. Words met before take their ids from a cache of
    two generations of cache_words at most, which a worker's next tasks go on with. A null or empty text is the end_id alone. ids: little-endian
    unsigned 32-bit ids, if with_ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the module that the worker has, not of a copy that came with the task
        words = import_module("orebed.llm.packing").Words.of(tokenizer)
        encode, parting, parted, quick, byte_letters = words.encode, words.parting, words.parted, words.quick, words.byte_letters
        end, step, known, old = np.array([end_id], "<u4").tobytes(), 4 * max_len, words.known, words.old
        for part in few_rows(parts):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            split = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
            here = set().union(*split)
            if len(known) + len(here) > cache_words:
                known, old = {}, known
                words.known, words.old = known, old
            new, parts_of = set(), {}
            for w in here.difference(known):
                if w in old:
                    known[w] = old[w]
                    continue
                core = w.rstrip(b".,;:!?#*$%&|") if parted else w
                letters = parted and not core.translate(None, LETTERS)
                if letters and core != w and core:
                    low, signs = core.lower(), w[len(core) :]
                    parts_of[w] = (low, signs)
                    if low not in known:
                        new.add(low)
                    if signs not in known:
                        new.add(signs)
                elif letters and (low := core.lower()) != core:
                    parts_of[w] = (low, b"")
                    if low not in known:
                        new.add(low)
                else:
                    new.add(w)
            for w in [w for w in new if w in old]:
                known[w] = old[w]
                new.discard(w)
            for w in [w for w in new if b"\0" in w]:
                known[w] = encode(w.decode()).tobytes()
                new.discard(w)
            plain = [w for w in new if not w.translate(None, PLAIN)] if quick else []
            new = list(new.difference(plain))
            todo = [(new[k : k + 1024], False) for k in range(0, len(new), 1024)] + [(plain[k : k + 1024], True) for k in range(0, len(plain), 1024)]
            for some, of_letters in todo:
                line = b" \0 ".join(some)
                ids = np.array(quick.encode_batch_fast([line.decode("latin-1").translate(byte_letters)], add_special_tokens=False)[0].ids, "<u4") if of_letters else encode(line.decode())
                cut, raw = np.flatnonzero(ids == parting[0]) * 4, ids.tobytes()
                known.update(zip(some, (raw[i:j] for i, j in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True)), strict=True))
            known[b""] = b""
            for w, (a, b) in parts_of.items():
                known[w] = known[a] + known[b]
            for doc, ws in zip(part.column(0).to_pylist(), split, strict=True):
                ids = b"".join(map(known.__getitem__, ws)) + end
                for k in range(0, len(ids), step):
                    own = ids[k : k + step]
                    out["doc_id"].append(doc)
                    out["piece"].append(k // step)
                    out["start"].append(k // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
                    out["ids"].append(own if with_ids else None)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.int32() if k == "piece" else pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()}
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES_DDL)


def pack(pieces: DataFrame, max_len: int = 4096, most_open: int = 2048) -> DataFrame:
    """sequence_id and offset of each piece (doc_id, piece, start, length, ids_crc32; lengths 1 to max_len).

    Pieces are dealt by a hash of their place, not of their document alone, so that no document or source fills a task;
    each task packs its own, in hash order, with at most most_open open bins. A task's sequence ids hold its number, so
    a task that runs again gives the same sequences."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, BestFit(max_len, most_open)
        for part in parts:
            placed = [bins.put(n) for n in part.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(place)
    return dealt.sortWithinPartitions(place, "doc_id", "piece").mapInArrow(run, PACKED_DDL)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_len: int = 4096, end_id: int = 1, most_open: int = 2048, cache_words: int = 400_000) -> DataFrame:
    """Whole documents as pieces in sequences of at most max_len tokens; see tokenize_pieces and pack.

    Nulls and empty texts: one piece with the end id. Repeated rows: each packed on its own. An empty table: no rows.
    Other columns of docs take no part."""
    return pack(tokenize_pieces(docs, tokenizer, max_len, end_id, cache_words=cache_words), max_len, most_open)
