"""Connected components of an undirected edge table by alternating large and small stars.

Node ids are longs; the label of a component is its smallest id. Each round is two
grouped minima and two joins, cut into the shared folder, so that lineage stays short and
a lost executor costs one round. Only counts and check sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large: hang larger neighbours on the smallest one. Small: the smaller ones and the node itself."""
    sides = _both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = sides.join(low, F.col("a") == F.col("n"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 40) -> tuple[DataFrame, str | None]:
    """(id, component) of every node that has an edge to another one; the path to drop later."""
    spark = edges.sparkSession
    e, path = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _sum(e)
    for _ in range(rounds):
        if not before[0]:
            break
        new, at = cut(_star(_star(e, True), False))
        after = _sum(new)
        drop(spark, path)
        e, path = new, at
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")), path
