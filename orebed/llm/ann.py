"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, few_rows, literal_table, partitions

#: Vectors of one cell in one row group of the index.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """A vector that takes part: not null, no null or non-finite component, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class MultiIndex:
    """Centroids of the two halves of a lifted vector; a vector's cell is the pair of its halves' nearest centroids."""

    half: int
    first: np.ndarray
    second: np.ndarray
    longest: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = _lifted(x, self.longest)
        a, b = _nearest(x[:, : self.half], self.first), _nearest(x[:, self.half :], self.second)
        return a * len(self.second) + b

    def traverse(self, q: np.ndarray, occupied: list[np.ndarray], counts: np.ndarray, least: int) -> dict[int, list[int]]:
        """Occupied cells by rising summed distance of q to their two centroids, until they hold least vectors: second
        centroids by first. occupied: for each first centroid the seconds that it has vectors with. A heap has the next
        cell of each first centroid, its seconds in order of distance. The length of q changes no inner product's place,
        so q is lifted at the longest length."""
        peak = np.abs(q).max()
        q = np.append(q / peak * (self.longest / np.sqrt(((q / peak) ** 2).sum())), self.longest)
        da, db = (self.first**2).sum(1) - 2 * self.first @ q[: self.half], (self.second**2).sum(1) - 2 * self.second @ q[self.half :]
        order = np.argsort(db, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        seconds = [order[np.sort(place[o])].tolist() for o in occupied]
        near, width = db.tolist(), len(self.second)
        heap = [(float(d) + near[s[0]], a, 0) for a, (d, s) in enumerate(zip(da, seconds, strict=True)) if s]
        heapq.heapify(heap)
        out, held = {}, 0
        while heap and held < least:
            d, a, j = heap[0]
            own = seconds[a]
            out.setdefault(a, []).append(own[j])
            held += int(counts[a * width + own[j]])
            if j + 1 < len(own):
                heapq.heapreplace(heap, (d - near[own[j]] + near[own[j + 1]], a, j + 1))
            else:
                heapq.heappop(heap)
        return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with one more component, by which all have one distance `longest` from a common point: then the largest inner
    product with a query is the smallest distance, whatever the lengths. It is longest - sqrt(longest^2 - |x|^2)."""
    n = (x**2).sum(1)
    return np.column_stack([x, n / (longest + np.sqrt(np.maximum(longest**2 - n, 0)))])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        for j in np.flatnonzero(n):
            c[j] = x[near == j].mean(0)
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()), replace=False)]
    return c


def fit(vectors: DataFrame, centroids: int = 32, most_rows: int = 20_000, seed: int = 0) -> MultiIndex | None:
    """Centroids of each half, fitted on at most most_rows usable vectors, first by a hash of vec_id, and the
    length of the longest of all usable vectors; None without any."""
    every = vectors.where(usable(F.col("embedding")))
    longest = every.agg(F.sqrt(F.max(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    rows = every.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(most_rows)
    got = [r[0] for r in rows.select(F.col("embedding").cast("array<double>")).collect()]
    if not got:
        return None
    x, rng = np.array(got), np.random.default_rng(seed)
    half = (x.shape[1] + 1) // 2
    x = _lifted(x[np.lexsort(x.T)], longest)
    return MultiIndex(half, _kmeans(x[:, :half], centroids, 15, rng), _kmeans(x[:, half:], centroids, 15, rng), longest)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int = 256, probe: float = 0.28, least: int = 2000, seed: int = 0) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) found for each query (the same columns), its own vec_id left out:
    query_id, rank (from 1), vec_id, score (inner product in double precision), ties to the smaller vec_id.

    Every usable vector is indexed by its cell, lifted so that inner products are distances (`_lifted`). A query visits
    the cells by rising summed distance until they hold a share `probe` of the vectors, `least` at least; all their
    entries are reranked by their original vectors. The cells of one first centroid lie together, in blocks of about BLOCK
    vectors dealt by a hash of vec_id, so that equal vectors don't fill a task; a query goes once to each block with a cell
    that it visits, and gets its k best there.

    Unusable vectors (null, empty, zero, or with a null or non-finite component) take no part, nor do those of another
    length than the usable vector with the smallest vec_id has. Repeated rows are one candidate; several vectors of one
    vec_id are candidates each. A null vec_id takes no part. Without vectors or queries: no rows. Other columns take no
    part."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    size = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).agg(F.min(F.struct("vec_id", F.size("embedding").alias("n"))).alias("m")).first()["m"]
    if size is None:
        return spark.createDataFrame([], empty)

    def ready(df: DataFrame) -> DataFrame:
        fits = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == size["n"])
        return df.where(fits).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).dropDuplicates()

    index = fit(ready(vectors), centroids, seed=seed)

    def celled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            if p.num_rows:
                x = np.array(p.column(1).flatten()).reshape(p.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(x), pa.int32()), *p.columns], names=["cell", "vec_id", "embedding"])

    scratch = Scratch(spark, "ann")
    entries = scratch.save(ready(vectors).mapInArrow(celled, "cell int, vec_id long, embedding array<double>"), "entries")
    n_cells = len(index.first) * len(index.second)
    counts = np.zeros(n_cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row for each pair of centroids at most
        counts[r[0]] = r[1]
    target = max(least, int(np.ceil(probe * counts.sum())))
    width = len(index.second)
    blocks = np.maximum(1, -(-counts.reshape(-1, width).sum(1) // BLOCK))

    occupied = [np.flatnonzero(c) for c in counts.reshape(-1, width)]

    def visits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in few_rows(parts):
            x = np.array(p.column(1).flatten()).reshape(p.num_rows, -1)
            ids, rows, groups, seconds = p.column(0).to_pylist(), [], [], []
            for i, q in enumerate(x):
                for a, bs in index.traverse(q, occupied, counts, target).items():
                    rows.append(i)
                    groups.append(a)
                    seconds.append(bs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in rows], pa.int64()), p.column(1).take(pa.array(rows, pa.int64())), pa.array(groups, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))],
                names=["query_id", "query", "first", "seconds"],
            )

    n = F.broadcast(literal_table(spark, [{"first": a, "n": int(b)} for a, b in enumerate(blocks)], "first:int,n:int"))
    # every task walks some queries, however few bytes they have
    asked = ready(queries).repartition(partitions(spark), "vec_id").mapInArrow(visits, "query_id long, query array<double>, first int, seconds array<int>").join(n, "first")
    asked = asked.select("query_id", "query", "first", "seconds", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    held = entries.select("vec_id", "embedding", F.expr(f"cell div {width}").cast("int").alias("first"), (F.col("cell") % width).alias("second")).join(n, "first")
    held = held.select("vec_id", "embedding", "first", "second", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int").alias("block"))

    def rerank(key, asks: pa.Table, owned: pa.Table) -> pa.Table:
        ids, qids = owned.column("vec_id").to_numpy(), asks.column("query_id").to_numpy()
        out_q, out_v, out_s = [], [], []
        if len(ids) and len(qids):
            e = np.array(owned.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, e, second = ids[order], np.ascontiguousarray(e[order]), owned.column("second").to_numpy()[order]
            seconds = asks.column("seconds").to_pylist()
            q = np.array(asks.column("query").combine_chunks().flatten()).reshape(len(qids), -1)
            for i in range(len(qids)):
                visited = np.zeros(width, bool)
                visited[seconds[i]] = True
                own = np.flatnonzero(visited[second] & (ids != qids[i]))
                s = np.zeros(len(ids))
                s[own] = (e[own] * q[i]).sum(axis=1)  # each row alone, in one order: equal vectors have equal scores
                if len(own) > k:
                    edge = np.partition(s[own], len(own) - k)[len(own) - k]
                    sure, tied = own[s[own] > edge], own[s[own] == edge]
                    own = np.concatenate([sure, tied[: k - len(sure)]])
                out_q.append(np.full(len(own), qids[i]))
                out_v.append(ids[own])
                out_s.append(s[own])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": pa.array(cat(out_q, np.int64), pa.int64()), "vec_id": pa.array(cat(out_v, np.int64), pa.int64()), "score": pa.array(cat(out_s, float), pa.float64())})

    best = asked.groupBy("first", "block").cogroup(held.groupBy("first", "block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # limited to k before the shuffle, by Spark's window group limit
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
