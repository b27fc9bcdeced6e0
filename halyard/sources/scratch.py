"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir. Only a session on one machine may leave that unset: a folder of its warehouse then serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for what is written in between, which goes as such tables do."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it once as Parquet and return a scan of what was written.

    A lost executor costs no more than the tasks that read its part again. The tables go when the
    interpreter ends, or on drop_scratch().
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_scratch() -> None:
    """Delete every table written so far; results that still read them must have been stored before."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session may be gone; the folder is scratch either way
            return
