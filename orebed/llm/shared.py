"""What the operators of this subpackage share: scratch tables, text batches and packed arrays."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: a batch of the longest texts still fits a Python worker.
ARROW_ROWS = 256


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or SparkContext.setCheckpointDir's. Where neither
    is set, a folder of this machine if Spark runs in this process alone (tests), else an error: on a cluster no other
    folder is shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='orebed-')}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def few_rows(parts: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows: what a step makes of texts takes many times their memory."""
    for p in parts:
        for at in range(0, p.num_rows, rows):
            yield p.slice(at, rows)


def give_back() -> None:
    """Returns memory that this process has freed to the machine, where the C library can."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Scratch:
    """Tables written to the shared folder. They cut lineage, so that a lost executor costs one step, and let Spark
    free the shuffle files of the steps before. They go with drop(), drop_scratch() or the driver's end."""

    #: Folders of the tables that are there.
    live: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/orebed-{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, self.root)
        Scratch.live.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, key = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        self.free()  # what the step before still held while it was saved
        rows = self.spark.conf.get(key)
        self.spark.conf.set(key, str(min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS))  # for this step alone
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, rows)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.free()
        return out

    def drop(self, name: str) -> None:
        _remove(f"{self.root}/{name}")

    def free(self) -> None:
        """Lets Spark's cleaner see which shuffles nothing needs any more: it removes their files."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _remove(path: str) -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is None or spark.sparkContext._jvm is None:
            return
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended; the folder is scratch
        pass


def drop_scratch(keep: Iterable[str] = ()) -> None:
    """Removes the scratch tables of all operators called so far, but the folders of `keep`. For long sessions, once the
    results that were asked for are written: a result that isn't can't be computed afterwards."""
    held = list(keep)
    for root in Scratch.live:
        if root not in held:
            _remove(root)
    Scratch.live[:] = held


#: Rows of keys (two numbers each) that are sent to all executors; more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def counted_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, a written table of a few numbers a row, marked for broadcast if it has at most `most` rows: this counts them."""
    return F.broadcast(df) if df.count() <= most else df


def literal_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of fixed size, as a literal of the plan."""
    import json

    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is written and computed once, however often body names it and wherever the optimizer puts it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- packed arrays -----------------------------------------------------------------------------------------------

def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences, byte plane by byte plane, compressed."""
    d = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view(np.uint64).ravel(), dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        a = a ^ (a >> np.uint64(30))
        a = a * np.uint64(0xBF58476D1CE4E5B9)
        a = a ^ (a >> np.uint64(27))
        a = a * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


def bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of 64-bit numbers begins in ascending hashes, and the end."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64)) // buckets
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, dtype=np.uint64)), [len(hashes)]]).astype(np.int64)


# -- batches of whole texts ----------------------------------------------------------------------------------------

BATCH_DDL = "batch long, n_docs int, ids binary, lens binary, texts binary"


def text_batches(docs: DataFrame, most_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, text) in batches of about most_bytes of whole texts (a longer text is a batch of its own), compressed.

    Columns: batch (unique), n_docs, ids (int64; the smallest int64 stands for null), lens (int64 bytes, -1 for a null
    text), texts. The batches of one task follow its rows, so the table must be saved before two steps read it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def flush():
            order = sorted(range(len(ids)), key=ids.__getitem__)
            raw = [texts[i] for i in order]
            return pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([first + seq], pa.int64()),
                    "n_docs": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([pack(np.array([ids[i] for i in order], np.int64))], pa.binary()),
                    "lens": pa.array([pack(np.array([-1 if x is None else len(x) for x in raw], np.int64))], pa.binary()),
                    "texts": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(x or b"" for x in raw))], pa.binary()),
                }
            )

        for part in few_rows(parts):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(NULL_ID if i is None else i)
                texts.append(t)
                held += len(t or b"") + 64
                if held >= most_bytes:
                    yield flush()
                    seq += 1
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BATCH_DDL)


NULL_ID = -(1 << 63)


def open_batch(ids: bytes, lens: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes | None]]:
    lens, raw = unpack(lens, np.int64), zstandard.ZstdDecompressor().decompress(texts)
    out, at = [], 0
    for n in lens.tolist():
        out.append(None if n < 0 else raw[at : at + n])
        at += max(0, n)
    return unpack(ids, np.int64), out


UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def words_of(texts: Iterable[bytes | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and where each text's begin (and the end)."""
    words, at = [], [0]
    for t in texts:
        if t:
            words += (t.translate(UPPER) if lower else t).split()
        at.append(len(words))
    return words, np.array(at, np.int64)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """A 64-bit hash of each word, and the words' codes from 0 in order of first sight."""
    from collections import defaultdict
    from itertools import count

    import xxhash

    code: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    of = np.fromiter((xxhash.xxh3_64_intdigest(w, 17) for w in code), np.uint64, len(code))
    return (of[codes] if len(words) else np.zeros(0, np.uint64)), code


def pack_planes(a: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane, compressed: for numbers of few bytes in any order."""
    return pack(np.ascontiguousarray(a.astype(np.int64)).view(np.uint8).reshape(-1, 8).T)


def unpack_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)

