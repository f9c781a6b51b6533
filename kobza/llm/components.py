"""Connected components by alternating large and small stars, as joins and aggregations of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import durable, release


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large: every neighbour above u moves to the least neighbour of u or u itself; small: those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        moved = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b, in any order and as often as it may be. Returns id and component, the least id that it
    reaches, for every id with an edge to another; ids without one are absent."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = durable(star(star(now, True), False))
        release(edges.sparkSession)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
