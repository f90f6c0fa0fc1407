"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space; words are what stands between them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, as in tests on one machine, a temporary one; a cluster must set it."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends there, and a lost executor costs no earlier stage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of scratch() or stored() that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of stored() that no later step reads."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(df.sparkSession, path)


def one_space(text: Column) -> Column:
    """text with each run of white space replaced by one space; null counts as empty. Lone spaces are left as they are, so the pattern matches rarely."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def free(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases: Spark deletes them when their datasets are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()
