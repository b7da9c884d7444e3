"""Connected components by alternating large-star and small-star rounds.

Only minima per node and joins with them: no node's neighbours are gathered,
so a node with very many edges is split by the partial aggregation and by the
skew join.  Each round is written to the shared folder; the rounds end when
the edges stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, F.col("u") == F.col("c")).where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(e: DataFrame) -> DataFrame:
    """``e`` has ``u > v`` in every row."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    on = e.join(least, F.col("u") == F.col("c"))
    return on.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (its smallest node) for every node of an edge between different nodes.

    Rows with a null end and loops are ignored; the same edge may come often
    and in both directions; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
        now = written(_small(_large(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
