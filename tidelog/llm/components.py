"""Connected components of a distributed edge list, by alternating star contraction; of at most FEW edges, in one task.

A round of contraction is eight shuffles or so, of all edges. The driver keeps a record of each of their tasks, so rounds over
a short list cost it more than the list: on the check tool's check_h, 211 partitions wide, most tasks of the near
duplicates were these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored

#: Copies of a node's row in the joins, so that a node with very many neighbours is spread over as many tasks.
SALTS = 8
#: Edges that one task takes in: 16 bytes each as they come, about 100 while it works on them.
FEW = 200_000


def least(edges: DataFrame) -> DataFrame:
    """(u, m, salt): m is the smallest of u and its neighbours v."""
    lows = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: larger neighbours go to the smallest neighbour; small: the smaller ones and the node do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least(both), ["u", "salt"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges, and the smallest node that it reaches: roots go under smaller neighbours until no edge joins two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low != high
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]


def rooted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *frames])
    node, root = roots(rows["u"].to_numpy(), rows["v"].to_numpy())
    yield pd.DataFrame({"node": node, "root": root})


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches.

    edges has long columns a and b. Each round is written to the shared folder and the one before it deleted. Rounds end
    when the edges form stars that a further round leaves alone; their number grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v"))
    if now.count() <= few:
        return now.coalesce(1).mapInPandas(rooted, "node long, root long")
    mark = None
    while True:
        after = stored(star(star(now, True), False))
        removed(spark, now)
        now, past = after, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == past or not mark[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
