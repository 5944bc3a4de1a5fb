"""Helpers of the operators: tables of a folder, folds, tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweir.sources.staging import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds. A null id has no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many rows in a batch that a task sends to Python, in all that runs inside; afterwards as many as before.

    A batch of whole texts stands in a task's memory several times: where the JVM makes it and where Python reads it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables that an operator writes below spark.checkpoint.dir, and drops once nothing reads them any more.

    A written table cuts the lineage where every executor can read it back: a lost executor repeats one step at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self.paths.append((back, path))
        return back

    def clear(self) -> None:
        """Delete all tables of this folder."""
        self.drop(*[back for back, _ in self.paths])
        self.paths.clear()

    def drop(self, *frames: DataFrame) -> None:
        for path in (p for back, p in self.paths if any(back is frame for frame in frames)):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
