"""Collision-counting projections: near-duplicate vectors agree within a window on almost all one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimweir.llm.components import components
from claimweir.llm.shared import Scratch

#: Vectors compared at a time: a task holds two blocks and the collisions of QUERIES rows of one with the other.
BLOCK = 2048
QUERIES = 256
#: Projections at most; they are orthonormal, so there are no more than dimensions.
PROJECTIONS = 64
#: Projections counted for all pairs; those that miss too often already are not counted on.
FIRST = 16


def projections(dimension: int, most: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """Orthonormal random directions, one a column; the same wherever they are computed."""
    directions, _ = np.linalg.qr(np.random.default_rng(seed + dimension).standard_normal((dimension, dimension)))
    return directions[:, :most]


def radius(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold, with room for rounding."""
    return math.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-6


def close_pairs(mine: np.ndarray, theirs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two sets of vectors with cosine >= threshold.

    A window reaches r / 2 to either side of a query's value on a projection, r being the distance at the threshold. The squared
    differences on orthonormal projections add up to r^2 at most, so a similar pair misses at most 4 windows: a count of
    `projections - 4` collisions has a recall of 1. Candidates of that count are verified by their cosine in double precision.
    """
    r = radius(threshold)
    window, allowed = r / 2, 4
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (mine, theirs))
    axes = projections(mine.shape[1])
    p, q = a @ axes, b @ axes
    by_p, by_q = np.argsort(p[:, 0], kind="stable"), np.argsort(q[:, 0], kind="stable")
    sorted_q = q[by_q]
    left, right = [], []
    for k in range(0, len(by_p), QUERIES):
        query = by_p[k : k + QUERIES]
        low, high = np.searchsorted(sorted_q[:, 0], (p[query[0], 0] - r, p[query[-1], 0] + r))
        if low >= high:
            continue
        misses = np.zeros((len(query), high - low), np.uint8)
        for axis in range(min(FIRST, p.shape[1])):
            misses += np.abs(p[query, axis][:, None] - sorted_q[low:high, axis][None, :]) > window
        i, j = np.nonzero(misses <= allowed)
        left.append(query[i])
        right.append(by_q[low + j])
        count = misses[i, j].astype(np.int64)
        for axis in range(FIRST, p.shape[1]):
            count += np.abs(p[left[-1], axis] - q[right[-1], axis]) > window
            if axis % 8 == 7 or axis == p.shape[1] - 1:
                stay = count <= allowed
                left[-1], right[-1], count = left[-1][stay], right[-1][stay], count[stay]
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    near = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        near[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    return i[near], j[near]


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label") -> DataFrame:
    """Link vectors of equal labels whose cosine is `threshold` or more; all links are found.

    Returns one row per row: id, n_links (other vectors linked directly), component_id (smallest id reachable by links, itself
    included), kept (the id is its component's). Vectors that are null, zero, empty or hold null or non-finite components link
    with nothing, and so do rows with a null label or a null id (whose component is null and which are not kept). Vectors of different lengths have no
    cosine and do not link. Rows that repeat an id count their links together. An empty table gives an empty result.

    Equal vectors of a label are one point with a weight. Points are sorted by label, by cells of width r on two projections,
    and by a third one, and cut into blocks of at most 2,048 of one label, whatever the label's size. Two blocks meet when
    their boxes on all projections are within r; such a pair of blocks is one row of a task, which returns sums and the edges
    of a spanning forest: at most two rows per vector and no list of pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    r = radius(threshold)
    label = F.lit(0) if label_column is None else F.col(label_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["label"]
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    rows = rows.withColumn("sound", sound)

    def project(batches):
        for batch in batches:
            lists = batch.column(2)
            places, bytes_ = [], []
            for v in lists:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                with np.errstate(over="ignore"):
                    x = x / np.abs(x).max()
                bytes_.append(x.tobytes())
                p = (x / np.linalg.norm(x)) @ projections(len(x), most=3)
                places.append(np.pad(p, (0, 3 - len(p))))
            places = np.array(places).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(v) for v in lists], pa.int32()), pa.array(bytes_, pa.binary()), *(pa.array(places[:, k]) for k in range(3))],
                names=["id", "label", "size", "vector", "p0", "p1", "p2"],
            )

    found = scratch.write(rows.filter("sound").select("id", "label", "vector").mapInArrow(project, f"id long, label {kind}, size int, vector binary, p0 double, p1 double, p2 double"))
    points = found.groupBy("label", "size", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"), *[F.first(p).alias(p) for p in ("p0", "p1", "p2")])
    order = ["label", "size", F.floor(F.col("p0") / r), F.floor(F.col("p1") / r), "p2", "id"]
    points = scratch.write(points.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "size", "vector", "weight"))

    def block_of(group: list[tuple]) -> list:
        ids, label, size, weights, data = [g[0] for g in group], group[0][1], group[0][2], [g[4] for g in group], b"".join(g[3] for g in group)
        x = np.frombuffer(data, np.float64).reshape(len(ids), size)
        p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ projections(size)
        return [label, size, np.array(ids, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), data, p.min(0).tolist(), p.max(0).tolist()]

    def cut(batches):
        def blocks():
            group: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group and (row[1:3] != group[0][1:3] or len(group) == BLOCK):
                        yield block_of(group)
                        group = []
                    group.append(row)
            if group:
                yield block_of(group)

        names = ["label", "size", "ids", "weights", "data", "lo", "hi"]
        for block in blocks():
            kinds = [label_type, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block, kinds, strict=True)], names=names)

    label_type = to_arrow_type(points.schema["label"].dataType)
    blocks = scratch.write(
        points.mapInArrow(cut, f"label {kind}, size int, ids binary, weights binary, data binary, lo array<double>, hi array<double>").withColumn("block", F.monotonically_increasing_id())
    )
    boxes = blocks.select("block", "label", "size", "lo", "hi")

    def cells(reach: float) -> Column:
        return F.explode(F.sequence(F.floor((F.col("lo")[0] - reach) / (2 * r)), F.floor((F.col("hi")[0] + reach) / (2 * r)))).alias("cell")

    one = boxes.select("*", cells(r))
    two = boxes.select(F.col("block").alias("block2"), "label", "size", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), cells(0.0))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("lo2", "hi", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    meets = one.join(two, ["label", "size", "cell"]).filter((F.col("block") <= F.col("block2")) & (apart <= r * r)).select("block", "block2", "size").distinct()
    mine = blocks.select("block", "ids", "weights", "data")
    other = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("weights").alias("weights2"), F.col("data").alias("data2"))
    work = meets.join(mine, "block").join(other, "block2").select("block", "block2", "size", "ids", "weights", "data", "ids2", "weights2", "data2")

    def compare(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same, size = row[0] == row[1], row[2]
                ids, weights, ids2, weights2 = (np.frombuffer(row[k], np.int64) for k in (3, 4, 6, 7))
                x, y = (np.frombuffer(row[k], np.float64).reshape(-1, size) for k in (5, 8))
                i, j = close_pairs(x, y, threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
                np.add.at(links, i, weights2[j])
                np.add.at(links2, j, weights[i])
                node = np.concatenate([ids, ids2])
                rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
                ordered_ids = np.sort(node, kind="stable")
                root = _least_reachable(len(node), rank[i], rank[len(ids) + j])
                linked = np.concatenate([links, links2])
                some = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(linked[some]), pa.array(ordered_ids[root[rank[some]]])], names=["a", "links", "b"])

    linked = scratch.write(work.mapInArrow(compare, "a long, links long, b long"))
    at = components(linked.select("a", "b"), Scratch(spark, "neardup-components"))
    sums = linked.groupBy(F.col("a").alias("point")).agg(F.sum("links").alias("links"))
    classes = points.select("label", "size", "vector", F.col("id").alias("point"), "weight")
    classes = classes.join(sums, "point", "left").join(at.withColumnRenamed("id", "point"), "point", "left")
    classes = classes.select("label", "size", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    told = found.select("id", "label", "size", "vector").join(classes, ["label", "size", "vector"]).select("id", "n_links", "component_id")
    rest = rows.filter("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = told.unionByName(rest)
    return both.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
