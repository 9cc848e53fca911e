"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b); loops and repeated links do no harm.

    Each round gives a node the least label among its own and its neighbours', then that label's own label. Labels and
    links stay in tables; only the number of changes comes to the driver. Hot nodes are summed up before the shuffle."""
    both = links.select("a", "b").where("a is not null and b is not null")
    both = scratch.save(both.union(both.select("b", "a")).where("a <> b").distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("least"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        new = least.join(jump, F.col("least") == F.col("at"), "left").select("node", "old", F.coalesce("next", "least").alias("component"))
        new = scratch.save(new, f"{name}-{turn}")
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        scratch.drop(f"{name}-{turn - 1}")
        if not changed:
            return labels
