"""Streaming queries, run to their end over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.stored import folder, stored
from lexmill.streaming import encoder

from .registry import query, table

FEED = 300


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What an append stream gives for the files that are there."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into feeds of FEED characters, streamed, split, and joined again."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    n = F.ceil(F.length("text") / FEED).cast("int")
    feeds = docs.select(F.col("doc_id").alias("stream"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), "text", n.alias("n"))
    feeds = feeds.select("stream", "seq", F.substring("text", F.col("seq") * FEED + 1, F.lit(FEED)).alias("text"), (F.col("seq") == F.col("n") - 1).alias("last"))
    written = stored(feeds, "feeds")
    path = written.inputFiles()[0].rsplit("/", 1)[0]
    out = drained(encoder.pieces(spark.readStream.schema(written.schema).option("maxFilesPerTrigger", 4).parquet(path)), "pieces")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "pos", "piece"))), lambda x: x["piece"]), "")
    return out.groupBy(F.col("stream").alias("doc_id")).agg(F.sha2(whole, 256).alias("sha"))
