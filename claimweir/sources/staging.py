"""Tables written to the shared folder, so that lineage is cut where every executor can read it back."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a single machine without one, a new temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="claimweir-"))
    return context.getCheckpointDir()


def staging_path(spark: SparkSession, name: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/claimweir/{application}/{name}-{uuid.uuid4().hex}"


def stage(table: DataFrame, name: str, by: str | None = None, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: columns stay prunable and sizes become known to the planner.

    With `by`, a folder for each value of that column, so that readers of one value skip the others. A caller who deletes the
    table after use gives its path.
    """
    spark = table.sparkSession
    path = path or staging_path(spark, name)
    (table.write.partitionBy(by) if by else table.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out to all of them.

    One small file is one task, whatever work follows. Tables with enough splits are returned as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
