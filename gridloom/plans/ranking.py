"""List ranking: places along chains and cycles whose links lie in many tasks.

Pointer doubling: each round joins a table with itself and doubles how far each node sees, so a chain of n nodes takes
log2 n rounds, no task sees a whole chain, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, drop_cut


def list_ranks(links: DataFrame) -> DataFrame:
    """(node, end, d) of ``links`` (node, nxt), where each chain ends in a node without nxt: that node, and the number of steps to it."""
    now = cut(links.select("node", "nxt", F.lit(0).cast("long").alias("d"), F.col("node").alias("end")).withColumn("d", F.when(F.col("nxt").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")))
    while not now.where("nxt is not null").isEmpty():
        ahead = now.select(F.col("node").alias("nxt"), F.col("nxt").alias("__nxt"), F.col("d").alias("__d"), F.col("end").alias("__end"))
        moved = now.where("nxt is not null").join(ahead, "nxt").select("node", F.col("__nxt").alias("nxt"), (F.col("d") + F.col("__d")).alias("d"), F.col("__end").alias("end"))
        after = cut(now.where("nxt is null").unionByName(moved))
        drop_cut(now)
        now = after
    return now.select("node", "end", "d")


def cycle_minima(links: DataFrame) -> DataFrame:
    """(node, nxt, root) of ``links`` (node, nxt), which are cycles: the smallest node of each."""
    first = cut(links.select("node", "nxt"))
    now = cut(first.withColumn("m", F.col("node")))
    while True:
        ahead = now.select(F.col("node").alias("nxt"), F.col("nxt").alias("__nxt"), F.col("m").alias("__m"))
        after = cut(now.join(ahead, "nxt").select("node", F.col("__nxt").alias("nxt"), F.least("m", "__m").alias("m"), (F.col("__m") < F.col("m")).alias("less")))
        drop_cut(now)
        now = after
        # where no window of 2^k nodes has a smaller one next to it, all windows of a cycle agree
        if now.where("less").isEmpty():
            return first.join(now.select("node", F.col("m").alias("root")), "node")


def cycle_ranks(links: DataFrame) -> DataFrame:
    """(node, root, rank) of ``links`` (node, nxt), which are cycles: places from the smallest node of each on."""
    rooted = cut(cycle_minima(links))
    ranks = list_ranks(rooted.select("node", F.when(F.col("nxt") != F.col("root"), F.col("nxt")).alias("nxt")))
    whole = ranks.groupBy("end").agg(F.max("d").alias("most"))
    placed = ranks.join(whole, "end").select("node", (F.col("most") - F.col("d")).alias("rank"))
    return rooted.select("node", "root").join(placed, "node")
