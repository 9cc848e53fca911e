"""Centroid clustering by dual-tree Lloyd rounds: cover trees over blocks of vectors against a tree over the centroids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, few_rows, literal_table, pack, unpack

#: Vectors of one cover tree.
BLOCK = 2048
#: Vectors in a leaf, about: no level gets more nodes than vectors / LEAF.
LEAF = 16
#: Below this size of components all squared distances of 64 of them fit 64 bits; beyond it numbers are Python's.
SAFE = 1 << 27
#: Bits of a limb, in which components are summed where they don't fit.
LIMB = 32
#: Bounds are of rounded distances: a pair is pruned if it is farther by this share at least.
SLACK = 1e-9
MOST_LONG = (1 << 63) - 1


@dataclass
class CoverTree:
    """A cover tree with levels below its last cut off: nodes in preorder, the points of each in a row.

    Levels halve in distance. A level's centres contain those of the level above, are farther apart than its distance, and
    each new one is within twice that distance of its parent's centre. A centre that has no new child at a level has no node
    of its own there. order: points by place; lo, hi: the places of a node's points; centre: a point; radius: the
    distance of the centre's farthest point (true, not the level's bound); kids: a node's children."""

    order: np.ndarray
    lo: list[int]
    hi: list[int]
    centre: list[int]
    radius: list[float]
    kids: list[list[int]]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=-1))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree over the rows of x (float64)."""
    n = len(x)
    born: list[tuple[int, int, int]] = []  # level, centre, parent's centre
    near, own = _distances(x, x[0]), np.zeros(n, np.int64)
    most, level, reach = n // leaf, 0, near.max()
    while reach > 0 and len(born) + 1 < most:
        above = own.copy()
        while near.max() > reach / 2 and len(born) + 1 < most:
            c = int(near.argmax())
            born.append((level, c, int(above[c])))
            d = _distances(x, x[c])
            closer = d < near
            near[closer], own[closer] = d[closer], c
        level, reach = level + 1, reach / 2
        if near.max() == 0:
            break
    rows: dict[int, list[int]] = {}
    for i, c in enumerate(own.tolist()):
        rows.setdefault(c, []).append(i)
    newborn: dict[tuple[int, int], list[int]] = {}
    at: dict[int, list[int]] = {}
    for lv, c, parent in born:
        newborn.setdefault((parent, lv), []).append(c)
        if lv not in at.setdefault(parent, []):
            at[parent].append(lv)
    tree = CoverTree(np.zeros(n, np.int64), [], [], [], [], [])
    place = 0
    # (centre, from which of its levels on, its parent's node); a node ends when all below it are placed
    todo: list[tuple[int, int, int]] = [(0, 0, -1)]
    while todo:
        c, k, parent = todo.pop()
        if k < 0:
            tree.hi[parent] = place
            continue
        node = len(tree.lo)
        if parent >= 0:
            tree.kids[parent].append(node)
        tree.lo.append(place)
        tree.hi.append(0)
        tree.centre.append(c)
        tree.radius.append(0.0)
        tree.kids.append([])
        todo.append((c, -1, node))
        levels = at.get(c, [])
        if k < len(levels):
            todo += [(b, 0, node) for b in newborn[c, levels[k]]]
            todo.append((c, k + 1, node))
        else:
            own_rows = rows[c]
            tree.order[place : place + len(own_rows)] = own_rows
            place += len(own_rows)
    placed = x[tree.order]
    tree.radius = [float(_distances(placed[a:b], x[c]).max()) for a, b, c in zip(tree.lo, tree.hi, tree.centre, strict=True)]
    return tree


def exact_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, in whole numbers."""
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def assign(points: np.ndarray, x: np.ndarray, tree: CoverTree, centroids: np.ndarray, c: np.ndarray, over: CoverTree) -> tuple[np.ndarray, int]:
    """The nearest centroid (ties: the smaller number) of each row of points (whole numbers, in the tree's order), and how
    many pairs were compared exactly. x, c: points (rows in their own order) and centroids as float64, in one unit, in which none
    is over 1 if the whole numbers are Python's; over: a tree over c.

    Pairs of a node of points and nodes of centroids: with the distance d of their centres, every point of the one is at
    least d - (both radii) from every centroid of the other, and at most d + (the points' radius) from the other's centre,
    which is a centroid. What can't be nearest to any of the node's points is pruned; of the pairs left the wider side is
    opened. One centroid left takes the whole node; leaves are compared exactly."""
    number = np.empty(len(points), np.int64)
    # whole numbers beyond 53 bits are rounded in float64, by less than 2^-45 of the largest
    blur = 0.0 if points.dtype == np.int64 else 2.0**-45
    radius, kids = np.array(over.radius), over.kids
    middle = c[np.array(over.centre)]
    compared = 0
    todo = [(0, np.array([0]))]
    while todo:
        node, pairs = todo.pop()
        r = tree.radius[node]
        while True:
            d = _distances(middle[pairs], x[tree.centre[node]])
            most = (d.min() + r) * (1 + SLACK) + blur
            pairs = pairs[(d - r - radius[pairs]) * (1 - SLACK) <= most]
            wide = [p for p in pairs.tolist() if kids[p] and radius[p] >= r]
            if not wide:
                break
            pairs = np.array([p for p in pairs.tolist() if p not in wide] + [k for p in wide for k in kids[p]])
        lo, hi = tree.lo[node], tree.hi[node]
        left = [i for p in pairs.tolist() for i in over.order[over.lo[p] : over.hi[p]].tolist()]
        if len(left) == 1:
            number[lo:hi] = left[0]
        elif tree.kids[node]:
            todo += [(k, pairs) for k in tree.kids[node]]
        else:
            some = np.array(sorted(left))
            number[lo:hi] = some[np.argmin(exact_squares(points[lo:hi], centroids[some]), axis=1)]
            compared += (hi - lo) * len(some)
    return number, compared


def whole(x: np.ndarray, scale: float, kind: type) -> np.ndarray:
    """floor(scale * x) as whole numbers of a kind: 64-bit ones, or Python's (object) where those are too small to square."""
    f = np.floor(x * scale)
    return f.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in row] for row in f.tolist()], object)


TREE_DDL = "n int, ids binary, known binary, vectors binary, places binary, lo array<int>, hi array<int>, centre array<int>, radius array<double>, kids array<array<int>>"


def tree_blocks(vectors: DataFrame, dims: int, scale: float, unit: float) -> DataFrame:
    """Blocks of up to BLOCK rows of vectors (vec_id, v: dims doubles), each with its cover tree, whose distances are in
    `unit`; rows stay in their tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in few_rows(parts, BLOCK):
            if not p.num_rows:
                continue
            x = np.array(p.column(1).flatten()).reshape(p.num_rows, dims)
            tree = cover_tree((f := np.floor(x * scale)) * unit)
            known = np.array([i is not None for i in p.column(0).to_pylist()], np.uint8)
            ids = np.array([i or 0 for i in p.column(0).to_pylist()], np.int64)
            row = (p.num_rows, pack(ids), pack(known), pack(f), pack(tree.order), tree.lo, tree.hi, tree.centre, tree.radius, tree.kids)
            names = [f.split()[0] for f in TREE_DDL.split(", ")]
            types = [pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int32())] * 3, pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return vectors.mapInArrow(run, TREE_DDL)


def _assigned(parts: Iterator[pa.RecordBatch], centroids: np.ndarray, unit: float) -> Iterator[tuple]:
    """Of each block: ids, known, points in whole numbers (rows in their own order) and their centroids' numbers."""
    c = centroids.astype(np.float64) * unit
    over = cover_tree(c, leaf=1)
    for p in parts:
        for b in p.to_pylist():
            x = unpack(b["vectors"], np.float64).reshape(b["n"], -1)
            points = whole(x, 1.0, centroids.dtype.type if centroids.dtype == np.int64 else object)
            tree = CoverTree(unpack(b["places"], np.int64), b["lo"], b["hi"], b["centre"], b["radius"], b["kids"])
            number = np.empty(b["n"], np.int64)
            number[tree.order] = assign(points[tree.order], x * unit, tree, centroids, c, over)[0]
            yield b, points, number


def _limbs(total: int, n: int) -> list[int]:
    """total in n numbers of LIMB bits, the lowest first; the highest has the sign."""
    out = []
    for _ in range(n - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each usable row of vectors
    (vec_id, embedding): dims components, none null or non-finite (nor scale times it), each taken as floor(scale * x).

    Centroids 0, 1, ... start as the k vectors with the smallest SHA-256 (hex) of "<seed>:<vec_id>". A round assigns every
    vector to the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to the floor of
    their mean. The last centroids assign once more. All of it is exact.

    Blocks of vectors are written once with a cover tree each. A round sends the k centroids to all tasks and gets back, for
    each cluster, a count and a sum for each component, summed in each task before the shuffle: k rows come to the driver,
    whatever the number of vectors. Equal vectors lie in the blocks where they were read, so a common one fills no task. A
    lost executor costs the blocks of one round.

    A null vec_id counts as an empty text where centroids are chosen; repeated rows count as often as they are there; equal
    hashes are ordered by components. Fewer than k vectors: as many centroids. No usable vector: no rows. Distances and
    inertias beyond 64 bits (components of over 10^9) are given as the largest long; what decides is exact even then. Other
    columns take no part and may have any name."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))
    scratch = Scratch(spark, "dual-tree")
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if largest is None:
        return spark.createDataFrame([], empty)
    kind, limbs = (np.int64, 1) if largest * scale + 1 < SAFE else (object, int(math.log2(largest) + math.log2(scale)) // LIMB + 2)
    unit = 1.0 if kind is np.int64 else 2.0 ** -math.ceil(math.log2(largest) + math.log2(scale) + 1)
    blocks = scratch.save(tree_blocks(rows, dims, scale, unit), "blocks")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = whole(np.array([r["v"] for r in starts]), scale, kind)
    sums_ddl = "cluster int, n long, sums array<bigint>"

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for _, points, number in _assigned(parts, centroids, unit):
            for c in np.unique(number).tolist():
                own = points[number == c]
                count[c] = count.get(c, 0) + len(own)
                total[c] = total.get(c, 0) + own.sum(axis=0).astype(object)
        sums = [[x for t in total[c].tolist() for x in _limbs(int(t), limbs)] for c in total]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([count[c] for c in total], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    for _ in range(rounds):
        moved = blocks.mapInArrow(partial, sums_ddl).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims * limbs)]).alias("sums"))
        centroids = centroids.copy()
        for c, n, sums in moved.collect():  # k rows
            centroids[c] = [sum(s << (LIMB * j) for j, s in enumerate(sums[i : i + limbs])) // n for i in range(0, len(sums), limbs)]

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, points, number in _assigned(parts, centroids, unit):
            ids, known = unpack(b["ids"], np.int64), unpack(b["known"], np.uint8).astype(bool)
            own = centroids[number]
            far = np.array([min(int(d), MOST_LONG) for d in ((points - own) ** 2).sum(axis=1)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(number, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = scratch.save(blocks.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r[0]: int(r[1]) for r in found}
    of = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    every = min(sum(inertia.values()), MOST_LONG)
    known = [{"cluster": c, "cluster_inertia": min(s, MOST_LONG), "inertia": every, "centroid_sha256": of(c)} for c, s in inertia.items()]
    named = literal_table(spark, known, "cluster:int,cluster_inertia:long,inertia:long,centroid_sha256:string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
