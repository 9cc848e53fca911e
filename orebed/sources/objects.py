"""Objects by key under a root that Hadoop's file systems reach (a folder, a bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def original_key(paper_id: str, version: int) -> str:
    return f"papers/{paper_id}/v{version}/original.pdf"


def canonical_key(paper_id: str, version: int) -> str:
    return f"processed/{paper_id}/v{version}/canonical.json"


class ObjectStore:
    """Single objects, from the driver; read() is for many, from all executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm

    def _at(self, key: str):
        if not key or any(part in ("", ".", "..") for part in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, key: str, data: bytes) -> None:
        path, files = self._at(key)
        out = files.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        path, files = self._at(key)
        size, held = files.getFileStatus(path).getLen(), files.open(path)
        try:
            return bytes(held.readNBytes(size))
        finally:
            held.close()

    def exists(self, key: str) -> bool:
        path, files = self._at(key)
        return files.exists(path)

    def delete(self, key: str) -> None:
        """A key that isn't there does no harm."""
        path, files = self._at(key)
        files.delete(path, False)

    def read(self, pattern: str) -> DataFrame:
        """key, length and content of all objects whose keys match a glob pattern."""
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{pattern}")
        depth = pattern.count("/") + 1
        return rows.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("key"), "length", "content")
