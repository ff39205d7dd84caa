"""Where driver and executors meet: the folder of spark.checkpoint.dir, frames written there, small tables on all cores."""

from __future__ import annotations

from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, one of this machine if Spark runs on it alone, as in
    tests; on a cluster that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
        found = mkdtemp(prefix="quirefold-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it has no more splits than these: a file of one row group would else be one task's work.
    Larger tables have splits for all cores and stay as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
