"""Consistent-hash sharding with virtual nodes and bounded loads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, counted_broadcast, literal_table

#: Rows of one arc that one task numbers, about.
BLOCK_ROWS = 100_000


def _ring(shards: int, virtual_nodes: int, seed: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise; places are unsigned 32-bit."""
    import xxhash

    nodes = [(xxhash.xxh32_intdigest(f"{seed}/{s}/{v}"), s) for s in range(shards) for v in range(virtual_nodes)]
    return sorted(nodes)


def _array(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<{kind}>")


def assign_arcs(counts: list[int], owners: list[int], loads: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deals the keys of each arc (counts, clockwise) to shards: to the arc's owner while that has room, and on
    clockwise to the next virtual node whose shard has room. Rows: (arc, first rank, end rank, shard, first slot).

    Every shard first takes what lies on its own arcs, so that a key moves only if its shard is full; what overflows
    then continues clockwise. Total room is the number of keys, so all loads are met exactly."""
    room, slot, out, rest = list(loads), [0] * len(loads), [], []

    def take(arc: int, frm: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            out.append((arc, frm, frm + got, shard, slot[shard]))
            slot[shard] += got
            room[shard] -= got
        return got

    for arc, n in enumerate(counts):
        got = take(arc, 0, n, owners[arc])
        if got < n:
            rest.append((arc, got, n - got))
    for arc, frm, n in rest:
        for step in range(1, len(owners) + 1):
            if not n:
                break
            got = take(arc, frm, n, owners[(arc + step) % len(owners)])
            frm, n = frm + got, n - got
    return out


def shard(
    df: DataFrame, key: Column, order: list[Column], shards: int = 40, virtual_nodes: int = 64, epsilon: float = 0.0, seed: int = 0
) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard); columns of these names that df has already
    are replaced, all others stay, whatever they are called.

    A row lies on the ring where its key hashes; its arc is that of the next virtual node clockwise. A shard takes at
    most ceil((1 + epsilon) * rows / shards) rows, with epsilon 0 exactly its share (counts at most one apart); keys
    that overflow a full shard continue clockwise. Only counts by arc come to the driver: shards * virtual_nodes numbers.
    An arc is numbered in blocks of about BLOCK_ROWS rows, so that one key may fill it; where a block begins is a table,
    which is broadcast up to a counted number of rows and else joined by the blocks' own partitioning.

    order: columns that tell rows apart; rows equal in all of them may swap places. Null keys: a key like any other.
    Repeated rows: each has a slot. Texts and keys of any length count by their hash. An empty table: no rows."""
    ring, scratch = _ring(shards, virtual_nodes, seed), Scratch(df.sparkSession, "ring")
    own_columns = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in own_columns]).alias("row")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32)).alias("place")
    arcs, cells = len(ring), 4096  # most cells of the ring lie in one arc; the rest search the places
    table, width = [], (1 << 32) // 4096
    for c in range(cells):
        lo, hi = (sum(p < x for p, _ in ring) for x in (c * width, (c + 1) * width))
        table.append(lo % arcs if lo == hi else -1)
    cell = F.element_at(_array(table, "int"), F.shiftright(F.col("place"), 20).cast("int") + 1)
    search = (F.array_size(F.filter(_array([p for p, _ in ring], "long"), lambda e: e < F.col("place"))) % arcs).cast("int")
    ties = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]).alias("ties")
    placed = df.select(row, place, ties, F.xxhash64(*order, F.lit(seed)).alias("mixed"))
    placed = placed.withColumn("arc", F.when(cell >= 0, cell).otherwise(search))
    counts = [0] * arcs
    for r in placed.groupBy("arc").count().collect():  # a row for each virtual node at most
        counts[r["arc"]] = r["count"]
    total, blocks = sum(counts), [max(1, -(-n // BLOCK_ROWS)) for n in counts]
    number = F.element_at(_array(blocks, "int"), F.col("arc") + 1)
    placed = placed.withColumn("block", F.pmod(F.col("mixed"), number).cast("int"))
    share, more = divmod(total, shards)
    if epsilon > 0:
        loads = [math.ceil((1 + epsilon) * total / shards)] * shards
    else:
        loads = [share + (s < more) for s in range(shards)]
    by_arc: dict[int, list] = {}
    for arc, frm, end, s, slot in assign_arcs(counts, [s for _, s in ring], loads):
        by_arc.setdefault(arc, []).append({"frm": frm, "end": end, "shard": s, "slot": slot})
    dealt = literal_table(df.sparkSession, [{"arc": a, "dealt": v} for a, v in by_arc.items()], "arc:int,dealt:array<struct<frm:long,end:long,shard:int,slot:long>>")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "block").orderBy("place", "ties")) - 1)
    if max(blocks) > 1:
        sizes = placed.where(number > 1).groupBy("arc", "block").count()
        before = Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        begins = scratch.save(sizes.select("arc", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("from")), "begins")
        ranked = ranked.join(counted_broadcast(begins), ["arc", "block"], "left")
    else:
        ranked = ranked.withColumn("from", F.lit(0))
    # a row for each virtual node, and one more for each shard at most
    joined = ranked.join(F.broadcast(dealt), "arc").withColumn("rank", F.col("rank") + F.coalesce("from", F.lit(0)))
    out = joined.withColumn("own", F.filter("dealt", lambda d: (d["frm"] <= F.col("rank")) & (F.col("rank") < d["end"]))[0])
    return out.select(*[F.col("row").getField(c).alias(c) for c in own_columns], F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("rank") - F.col("own.frm")).alias("slot"))
