"""Connected components of a link table by alternating large-star and small-star steps.

Links, nodes and labels stay distributed; each step ends in a table in the shared folder. A node with very many links
is no bottleneck: minima are pre-aggregated, and joins on the node can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import save


def _stepped(links: DataFrame) -> tuple[DataFrame, tuple]:
    """(the links saved, their number and the sum of their hashes)."""
    seen = Observation()
    saved = save(links, "links", seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"))
    return saved, (seen.get["n"], seen.get["h"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Links may repeat or run either way; links of a node to itself and null ends count for nothing. No links: no rows.
    """
    now, state = _stepped(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    while state[0]:
        now, new = _stepped(_small_star(_large_star(now)))
        if new == state:
            break
        state = new
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
