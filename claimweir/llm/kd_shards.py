"""K-d tree partitioning: split at distributed weighted medians of the widest metadata dimension until leaves reach the target bytes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimweir.llm.shared import Scratch
from claimweir.operators.lookup import lookup_join

BINS = 1024
#: A point weighs at most this share of a leaf; heavier groups of equal texts are cut into such parts.
PART = 1 / 100
#: A median counts as found when the bin that holds it weighs less than this share of a leaf.
EXACT = 1 / 2048


def kd_shards(
    docs: DataFrame,
    shards: int | None = 8,
    target_bytes: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang", "size", "doc_id"),
) -> DataFrame:
    """Put every row into one of `shards` leaves of nearly equal bytes (UTF-8 bytes of the text plus 1); with `target_bytes`, into as
    few as hold no more than these bytes on average.

    Points of the tree are groups of equal texts, so copies share a leaf unless their group outweighs 1/100 of a leaf; such
    groups are cut into parts of that size by a hash of the id. A group lies where the least of its members' values lie.
    Numbers are scaled to 0..1 over all rows, strings are hashed to 0..1, "size" is the logarithm of the bytes. Every median is
    found by sums over 1,024 bins a node, refined until the bin is light; ties on the dimension are cut by a hash of the
    group. All nodes of a level are split together, and nodes, bins and cuts are rows of tables, so that neither the plan nor the driver
    grows with the number of leaves. No point outweighs 1/100 of a leaf,
    so leaves differ by about a percent at most once they hold thousands of rows.

    Null text: 1 byte, grouped with empty texts. Null metadata count as 0. Repeated rows are placed and numbered each. An
    empty table gives an empty result. Other columns are ignored, whatever their names. Returns id, size, text_crc32, shard
    and slot (gapless from 0 in each shard).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd-shards")
    kinds = dict(docs.dtypes)
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 1
    text = F.coalesce(F.col(text_column), F.lit(""))

    def raw(name: str) -> Column:
        if name == "size":
            return F.log2(size.cast("double"))
        if kinds[name] == "string":
            return F.pmod(F.xxhash64(F.coalesce(F.col(name), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    names = [f"at{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(id_column).alias("id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        *[raw(d).alias(n) for d, n in zip(dimensions, names, strict=True)],
    )
    rows = scratch.write(rows)
    bounds = rows.agg(F.sum("size").alias("total"), F.count("*").alias("n"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    total = bounds["total"] or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    leaf = total / shards

    group = ["hash", "crc", "group_size"]
    rows = rows.withColumn("group_size", F.col("size"))
    heavy = (  # their number is at most shards / PART, as their weights add up to the total
        rows.groupBy(group)
        .agg(F.sum("size").alias("weight"))
        .filter(F.col("weight") > F.lit(leaf * PART))
        .select(*group, F.ceil(F.col("weight") / F.lit(max(leaf * PART, 1))).alias("parts"))
    )
    rows = lookup_join(rows, scratch.write(heavy), group, "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0))
    )
    key = [*group, "part"]

    def scaled(name: str) -> Column:
        low, width = bounds[f"lo_{name}"] or 0.0, (bounds[f"hi_{name}"] or 0.0) - (bounds[f"lo_{name}"] or 0.0)
        return (F.min(name) - F.lit(low)) / F.lit(width) if width > 0 else F.min(name) * 0

    tie = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(1 << 40)) / float(1 << 40)
    points = scratch.write(rows.groupBy(key).agg(F.sum("size").alias("weight"), *[scaled(n).alias(n) for n in names]).withColumn("tie", tie))
    leaves = _leaves(points, key, names, shards, leaf, scratch)

    placed = rows.select("id", "size", "crc", *key).join(leaves, key)
    buckets = max(1, math.ceil((bounds["n"] or 0) / (shards * 50_000)))
    placed = placed.select("id", "size", F.col("crc").alias("text_crc32"), "shard", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    placed = scratch.write(placed)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return numbered.select(F.col("id").alias(id_column), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("at")).cast("long").alias("slot"))


def _leaves(points: DataFrame, key: list[str], names: list[str], shards: int, leaf: float, scratch: Scratch) -> DataFrame:
    """Points (key) with the number of their leaf (`shard`).

    A node is known by its first leaf and its number of leaves. A level writes the points with their node in the next one.
    """
    level = points.withColumns({"node": F.lit(0), "leaves": F.lit(shards)})
    most = shards
    while most > 1:
        cuts = _cuts(level, names, leaf, scratch)
        of_dimension = F.get(F.array(*names), F.col("dimension"))
        half = F.floor(F.col("leaves") / 2).cast("int")
        at = F.when(F.col("on_tie"), F.col("tie")).otherwise(of_dimension)
        beyond = F.when(F.col("behind"), at > F.col("edge")).otherwise(at >= F.col("edge"))
        upper = F.when(F.col("on_tie"), (of_dimension > F.col("value")) | ((of_dimension == F.col("value")) & beyond)).otherwise(beyond)
        split = level.join(cuts, "node", "left").withColumn("upper", F.coalesce(upper, F.lit(False)) & (F.col("leaves") > 1))
        split = split.withColumns(
            {
                "next": F.when(F.col("upper"), F.col("node") + half).otherwise(F.col("node")),
                "left": F.when(F.col("leaves") <= 1, F.col("leaves")).when(F.col("upper"), F.col("leaves") - half).otherwise(half),
            }
        )
        written = scratch.write(split.select(*key, "weight", "tie", *names, F.col("next").alias("node"), F.col("left").cast("int").alias("leaves")))
        if most < shards:
            scratch.drop(level)
        scratch.drop(cuts)
        level, most = written, most - most // 2
    return level.select(*key, F.col("node").alias("shard"))


def _cuts(level: DataFrame, names: list[str], leaf: float, scratch: Scratch) -> DataFrame:
    """For each node of several leaves where its widest dimension is cut, so that the lower part holds its share of the weight.

    Points at `edge` or beyond it (`behind`: only beyond it) are in the upper part; with `on_tie`, of the points whose value is
    `value`, those whose tie is.
    """
    widths = [F.max(n) - F.min(n) for n in names]
    spans = level.filter("leaves > 1").groupBy("node", "leaves").agg(F.sum("weight").alias("weight"), *[e.alias(f"w{i}") for i, e in enumerate(widths)], *[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    count = range(len(names))
    widest = F.greatest(*[F.col(f"w{i}") for i in count], F.lit(0.0))
    dimension = reduce(lambda rest, i: F.when(F.col(f"w{i}") == widest, F.lit(i)).otherwise(rest), reversed(count), F.lit(0))
    spans = spans.withColumn("dimension", dimension)
    of = lambda k: F.get(F.array(*[F.col(f"{k}{i}") for i in count]), F.col("dimension"))
    goal = F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")
    fresh = {"value": F.lit(None).cast("double"), "edge": F.lit(None).cast("double"), "behind": F.lit(False), "on_tie": F.lit(False), "done": F.lit(False), "below": F.lit(0.0)}
    state = scratch.write(spans.select("node", "dimension", of("lo").alias("lo"), of("hi").alias("hi"), goal.alias("goal")).withColumns(fresh))
    while not state.filter("NOT done").isEmpty():
        following = scratch.write(_refined(level.select("node", "weight", "tie", *names), state, names, leaf))
        scratch.drop(state)
        state = following
    return state.select("node", "dimension", "on_tie", "value", "edge", "behind")


def _refined(points: DataFrame, state: DataFrame, names: list[str], leaf: float) -> DataFrame:
    """One round: the weight of the open nodes' points by bins between lo and hi, and the bin in which the goal is reached."""
    opened = state.filter("NOT done")
    of_dimension = F.get(F.array(*names), F.col("dimension"))
    here = points.join(opened, "node").withColumn("at", F.when(F.col("on_tie"), F.col("tie")).otherwise(of_dimension))
    here = here.filter(F.col("at").between(F.col("lo"), F.col("hi")) & (~F.col("on_tie") | (of_dimension == F.col("value"))))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("at") - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    sums = here.groupBy("node", place.alias("bin")).agg(F.sum("weight").cast("double").alias("w"), F.min("at").alias("least"), F.max("at").alias("most"))
    own = Window.partitionBy("node").orderBy("bin")
    sums = sums.withColumn("upto", F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = sums.join(opened.select("node", "goal", "below"), "node")
    reached = F.col("below") + F.col("upto") >= F.col("goal")
    bin_ = F.struct("bin", "w", "least", "most", "upto")
    # the first bin that reaches the goal, or the last one
    found = found.groupBy("node").agg(F.coalesce(F.min_by(F.when(reached, bin_), F.when(reached, F.col("bin"))), F.max_by(bin_, "bin")).alias("b"))
    light, single = F.col("b.w") <= F.lit(leaf * EXACT), F.col("b.least") == F.col("b.most")
    below = F.col("below") + F.col("b.upto") - F.col("b.w")
    tied = single & ~F.col("on_tie") & ~light
    done = (light | single) & ~tied
    behind = F.col("goal") - below > F.col("b.w") / 2  # the nearer edge of the bin
    told = state.join(found, "node", "left")
    new = {
        "lo": F.when(tied, F.lit(0.0)).otherwise(F.col("b.least")),
        "hi": F.when(tied, F.lit(1.0)).otherwise(F.col("b.most")),
        "below": below,
        "value": F.when(tied, F.col("b.least")).otherwise(F.col("value")),
        "on_tie": F.col("on_tie") | tied,
        "edge": F.when(done, F.when(behind, F.col("b.most")).otherwise(F.col("b.least"))),
        "behind": done & behind,
        "done": done,
    }
    return told.select("node", "dimension", "goal", *[F.when(F.col("done"), F.col(n)).otherwise(v).alias(n) for n, v in new.items()])
