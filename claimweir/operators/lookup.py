"""Equi-joins to lookup tables whose size is not known beforehand, with hot keys spread over many tasks."""

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweir.sources.staging import stage

#: A lookup of more rows or bytes is not broadcast.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20
MOST_HOT_KEYS = 10_000
#: Items that a sketch of frequent keys holds at most.
TRACKED_KEYS = 100_000


def row_bytes(table: DataFrame) -> Column:
    """About what a row takes in memory."""

    def size(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
        return F.lit(16)

    return reduce(add, [size(field) for field in table.schema.fields], F.lit(0).cast("long"))


def is_small(table: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes.

    Every task sends one number, and a written table has its rows in its footers; bytes are added up only of few enough rows.
    """
    return table.count() <= rows and (table.agg(F.sum(row_bytes(table))).first()[0] or 0) <= size


class FrequentKeys:
    """The keys of a table that own many rows, for several sets of key columns, from one scan when the first of them is asked for.

    Each task keeps a sketch of the most frequent items of every set, and sketches are merged, so the cost does not depend on how
    the keys are spread. Keys are told apart by a hash, and counts are estimates: which keys are cut, and into how many parts, changes
    where rows go but not what a join gives.
    """

    def __init__(self, table: DataFrame, key_sets: Sequence[Sequence[str]], least_rows: int | None = None):
        self.table, self.key_sets, self.least_rows = table, [tuple(k) for k in key_sets], least_rows
        self._found: DataFrame | None = None

    def of(self, on: Sequence[str]) -> DataFrame:
        """Rows (_key, _parts): the hash of each key with at least least_rows rows, and in how many parts of so many rows it is cut.

        Without least_rows that is a million, or one part in MOST_HOT_KEYS of all rows if that is more, so there are no more than
        MOST_HOT_KEYS of them.
        """
        if self._found is None:
            if self.least_rows is None:
                self.least_rows = max(1_000_000, self.table.count() // MOST_HOT_KEYS)
            tops = [F.expr(f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in k)}), {MOST_HOT_KEYS}, {TRACKED_KEYS})").alias(f"top{i}") for i, k in enumerate(self.key_sets)]
            self._found = stage(self.table.agg(*tops), "frequent_keys")
        top = F.explode(f"top{self.key_sets.index(tuple(on))}").alias("top")
        parts = F.ceil(F.col("top.count") / self.least_rows).cast("int").alias("_parts")
        return self._found.select(top).filter(F.col("top.count") >= self.least_rows).select(F.col("top.item").alias("_key"), parts)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    small_rows: int = SMALL_ROWS,
    hot_rows: int | None = None,
    copies: int = 64,
    heat: FrequentKeys | None = None,
) -> DataFrame:
    """Join facts to a lookup table (inner or left), both of them cheap to read twice.

    Up to small_rows, and SMALL_BYTES, the lookup is broadcast. Beyond that both sides shuffle on the key, and every key that owns at
    least hot_rows facts (see FrequentKeys) is cut into parts of about that many: its facts get a number by their own content, its
    lookup rows one copy per number. Facts without a key are cut into `copies` parts. `heat` has the frequent keys of facts that
    are dear to read again, or that several joins share; it has to hold the facts' rows before earlier joins.
    """
    if is_small(lookup, small_rows):
        return facts.join(F.broadcast(lookup), on, how)
    hot = (heat or FrequentKeys(facts, [on], hot_rows)).of(on)
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    key = F.xxhash64(*[F.col(c) for c in on])
    parts = F.when(no_key, F.lit(copies)).otherwise(F.coalesce("_parts", F.lit(1)))
    content = F.xxhash64(*[F.col(c) for c in facts.columns])
    spread_facts = facts.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn("_part", F.pmod(content, parts).cast("int"))
    numbers = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    spread_lookup = lookup.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn("_part", F.explode(numbers))
    joined = spread_facts.drop("_parts", "_key").join(spread_lookup.drop("_parts", "_key"), [*on, "_part"], how)
    return joined.drop("_part")
