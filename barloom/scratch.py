"""Folders for intermediate tables, in the one place that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # by application, only where no shared folder is named


def scratch_root(spark: SparkSession) -> str:
    """The parent of all intermediate tables of this application.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a session on one
    machine gets a fresh folder under ``/tmp``; on a cluster it must be set.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _OWN[context.applicationId] = shared
    return f"{shared.rstrip('/')}/barloom-{context.applicationId}"


def scratch_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh folder for one intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table of this application in one step."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
