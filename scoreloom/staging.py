"""Written intermediate tables in the folder the cluster shares.

Operators that need more than one pass over an expensive input write its narrow
columns once and read the table back. Losing an executor then costs nothing but
the task: the table sits on shared storage and its lineage is a file scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    return configured


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scoreloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> bool:
    """Remove what this application staged, once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
