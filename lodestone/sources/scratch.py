"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below what ``spark.checkpoint.dir`` names; where
    that is unset, a temporary one on a single machine, and on a cluster an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        found = context._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/lodestone/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application, once its results are
    written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """``df`` written out once and read back, its lineage cut."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd" if not parts else "snappy")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
