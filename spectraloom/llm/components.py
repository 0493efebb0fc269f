"""Connected components by alternating large-star and small-star, as joins and aggregations.

Minima are aggregated for each node before they are joined back to the edges, so no list of
neighbours is gathered anywhere. Edges of every round are a table in the shared folder; nothing
but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import Tables


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of long ids: (u, v) with v the least id that u reaches, for every u but
    the least ones themselves. Loops, repeated and reversed links do no harm; no links, no rows."""
    store = Tables(links.sparkSession, "components")
    edges = store.save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
    seen, k = None, 0
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen or not state[0]:
            return edges
        seen, k = tuple(state), k + 1
        edges = store.save(small_star(large_star(edges)), str(k))
        store.drop(str(k - 1))
