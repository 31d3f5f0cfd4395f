"""Lineage cut, and intermediate tables written, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir, or else the context's checkpoint folder, names. Neither set: an error, as a folder of one machine would not do."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get(SETTING, None) or (own.get() if own.isDefined() else None)
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that driver and executors share")
    return folder


#: Spark removes an execution's shuffle files at its end, for queries made while this is set.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clear: bool = False) -> DataFrame:
    """df checkpointed in the shared folder. clear: what was shuffled for it is removed at once, not when the driver next happens to collect garbage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    if not clear:
        return df.checkpoint()
    before = df.sparkSession.conf.get(CLEAR, "false")
    df.sparkSession.conf.set(CLEAR, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, so that nothing else loses its files
    finally:
        df.sparkSession.conf.set(CLEAR, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Take a folder made by new_folder() away, wherever the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
