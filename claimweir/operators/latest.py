"""Last write wins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is greatest in `by`.

    A maximum combines before the shuffle, so a key with any share of the rows leaves each task as one row.
    """
    newest = F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("row")
    return rows.groupBy(*keys).agg(newest).select("row.*")


def upsert(table: DataFrame, incoming: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The table with incoming rows inserted, or put in the place of those with the same key.

    Of incoming rows with one key, that which is greatest in `by` stays.
    """
    both = table.withColumn("_round", F.lit(0)).unionByName(incoming.withColumn("_round", F.lit(1)))
    return latest_by_key(both, [key], ["_round", *by]).drop("_round")
