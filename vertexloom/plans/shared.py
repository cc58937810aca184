"""The folder that driver and executors share, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster sets it. Only where it is unset a folder is chosen: a temporary one with a
    local master, else one in the warehouse."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        said = f"file://{tempfile.mkdtemp(prefix='vertexloom-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is used more than once is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes the files behind a frame that checkpointed() returned."""
    spark = df.sparkSession
    where = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if where.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its partitioning kept: a lost executor costs nothing, and plans start here.

    An adaptive plan doesn't tell how its result is partitioned, so it is off while this plan is made.
    """
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
