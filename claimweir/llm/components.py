"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweir.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, component) for all ids in links (a, b): the smallest id that is reachable.

    Each round every id points at the neighbour (or itself) with the least hash, and links are redrawn between what their ends
    point at. Hashes make chains shrink by a constant factor a round, whatever the order of ids, so rounds grow with the
    logarithm of the longest chain. Both tables of a round are written, and no row of either meets the driver. An id with many
    links is summed by partial minima; the joins on it can be split by adaptive execution, as one side has each id once.
    """
    edges = scratch.write(links.select("a", "b").filter("a <> b").distinct())
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b").alias("hash"), F.col("b").alias("id")))
        nearest = both.groupBy("a").agg(least.alias("least")).select("a", "least.id", "least.hash")
        own = F.struct(F.xxhash64("a").alias("hash"), F.col("a").alias("id"))
        maps.append(scratch.write(nearest.select("a", F.least(own, F.struct("hash", "id"))["id"].alias("to"))))
        first = edges.join(maps[-1].withColumnRenamed("to", "p"), "a")
        redrawn = first.join(maps[-1].select(F.col("a").alias("b"), F.col("to").alias("q")), "b").filter("p <> q")
        following = scratch.write(redrawn.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        scratch.drop(edges)
        edges = following
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    at = maps[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for step in maps[1:]:
        at = at.join(step.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    at = scratch.write(at)
    scratch.drop(edges, *maps)
    return at.join(at.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
