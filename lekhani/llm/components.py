"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Loop, attach, cut, release


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars: each node's neighbours are linked to the smallest among them and the node."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(both)
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "c"))
    seen = attach(both, least, {"u": "w"}, "c", both.count())
    least = least.drop("c")
    if large:
        out = seen.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long nodes -> (node, root) for each node with a link; the root is the smallest node.

    Large and small stars alternate, each round a table in the shared folder, until nothing changes; then every node
    is linked to its root only. Links stay distributed; a few numbers a round come to the driver; the least neighbour of
    a node with very many is sent to every task. Links of null or of a node to itself count for nothing; links that
    repeat, in either direction, count once; an empty table gives no rows.
    """
    loop = Loop(links.sparkSession)
    now = loop.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())  # greatest passes over nulls, so a link to null is one to itself
    mark = None
    while True:
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
        now = loop.put(_star(_star(now, True), False))
    release(links.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
