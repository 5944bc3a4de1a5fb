"""Consecutive numbers 1..n over a global order, without moving all rows to one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweir.sources.staging import stage

_BITS = 33


def number_rows(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with their position in the order of `by` (nulls last), which must not tie.

    The rows are written to the shared folder first: numbers must not depend on a plan that may run again. Then they are cut
    into ranges of the order, each sorted by its own task; a row's number is its place in the range plus the sizes of the
    ranges before it.
    """
    return number_ranges(stage(rows, name), by, name)


def number_ranges(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    order = [F.col(column).asc_nulls_last() for column in by]
    # monotonically_increasing_id holds the partition in its upper bits and the place inside it in the lower ones.
    ranged = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    written = stage(ranged, name).withColumn("_range", F.shiftright("_place", _BITS))
    # One row per range, so at most as many rows as there are shuffle partitions.
    sizes = written.groupBy("_range").count()
    before = F.sum("count").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        written.join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_range", "_place", "_start")
    )
