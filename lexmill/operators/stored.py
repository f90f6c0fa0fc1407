"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder. A cluster must set it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(folder, "own", None)
    if own is None:
        own = folder.own = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
