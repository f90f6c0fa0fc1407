"""Exact deduplication through the keyed state of a streaming query.

The corpus is read as a stream of files. A streaming aggregation without
watermark keeps, for each content digest, a state row that never expires:
the stable identifier that stays (the smallest one seen), the number of
rows, and the locator (file and row) of the content. State lives in RocksDB
on the executors' disks and is committed to the shared checkpoint folder, so
memory is bounded and a lost executor restores it; a later call with the same
checkpoint folder only reads files it hasn't seen.

A row whose digest names another row is a hit. Hits are compared with the row
that the state names over their full normalised bytes; rows whose bytes
differ (a digest collision) are grouped by the bytes themselves.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_space, scratch, stored

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a state partition would take 4 MB of disk before its first row
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: A group of over one in HOT rows is joined under several salts.
HOT = 1000


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def only(path: str) -> str:
    """A pattern that path alone matches: a stream then reads a single file as well as a folder. Patterns stay as they are."""
    path = path.rstrip("/")
    return path if path[-1] in "*?]}" else f"{path[:-1]}[{path[-1]}]"


def digest_state(spark: SparkSession, path: str, schema, checkpoint: str, digest: Column, text_col: str = "text", id_col: str = "doc_id", max_bytes: int = 64 << 30, max_files: int | None = None) -> DataFrame:
    """Feed the files under path that checkpoint hasn't seen into the keyed state, and return the state: digest, keep_id, group_size, locator(id, file, row)."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    rows = reader.parquet(path).select(digest.alias("digest"), F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    state = rows.groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    with _conf(spark, ROCKSDB):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        at, n = (f"value.`{f.name}`" for f in kept.schema["value"].dataType.fields)
        return stored(kept.select("key.digest", F.col(f"{at}.id").alias("keep_id"), F.col(n).alias("group_size"), F.col(at).alias("at")), "digests")


def streaming_exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None, max_bytes: int = 64 << 30, max_files: int | None = None, digest: Column | None = None) -> DataFrame:
    """One row for each row of the Parquet files under path: id, keep_id, group_size, kept, text_sha256, keep_file, keep_row.

    Texts are equal when their bytes are, after one_space(); a null text is
    an empty one. Of equal texts the row with the smallest id stays; rows
    that repeat the same id and text stay or go together, as the id is all
    that tells rows apart. A null id counts as larger than any other. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    digest: another digest than SHA-256 of the normalised text, as for tests.
    """
    batch = spark.read.parquet(path)
    kept = batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    text = one_space(F.col("t"))
    key = F.unhex(F.sha2(text, 256)) if digest is None else digest
    schema = batch.select(id_col, text_col).schema
    state = digest_state(spark, only(path), schema, checkpoint or scratch(spark, "dedup-state"), (F.unhex(F.sha2(one_space(F.col(text_col)), 256)) if digest is None else digest), text_col, id_col, max_bytes, max_files)

    # docs to state: one state row a digest; hot digests are few by their definition, so their list is small enough to broadcast
    total = state.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    salts = F.greatest(F.lit(1), F.ceil(F.col("group_size") * HOT / F.lit(max(total, 1))).cast("int"))
    hot = F.broadcast(state.filter(F.col("group_size") * HOT > total).select("digest", salts.alias("salts")))
    rows = kept.select("id", key.alias("digest"), F.sha2(text, 256).alias("sha"))
    rows = rows.join(hot, "digest", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int")).drop("salts")
    wide = state.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    found = rows.join(wide, ["digest", "salt"]).select("id", "sha", "digest", "keep_id", "group_size", "at")

    # hits against the full bytes of the row that stays, a few thousand at most to one copy of it
    hits = kept.join(found.filter((F.col("group_size") > 1)).select(F.col("id").alias("id2"), "keep_id", "group_size", "digest"), F.col("id").eqNullSafe(F.col("id2")))
    parts = F.ceil(F.col("group_size") / 4096).cast("int")
    hits = hits.withColumn("part", F.pmod(F.xxhash64("id", "digest"), parts).cast("int"))
    first = state.filter("group_size > 1").select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), parts.alias("parts"))
    first = kept.join(first, F.col("id").eqNullSafe(F.col("k"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = first.select("d", "part", one_space(F.col("t")).alias("bytes"))
    differ = hits.join(first, (F.col("digest") == F.col("d")) & (hits["part"] == first["part"]) & (text != F.col("bytes"))).select("digest").distinct()
    wrong = stored(differ, "collisions")
    out = found.select("id", "keep_id", "group_size", F.col("sha").alias("text_sha256"), F.col("at.file").alias("keep_file"), F.col("at.row").alias("keep_row"), "digest")
    if not wrong.isEmpty():
        again = kept.select("id", key.alias("digest"), text.alias("bytes")).join(wrong, "digest", "left_semi")
        sums = again.groupBy("digest", "bytes").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        fixed = again.join(sums, ["digest", "bytes"]).select("id", "keep_id", "group_size", F.sha2("bytes", 256).alias("text_sha256"), F.lit(None).cast("string").alias("keep_file"), F.lit(None).cast("bigint").alias("keep_row"), "digest")
        out = out.join(wrong, "digest", "left_anti").select(out.columns).unionByName(fixed)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_file", "keep_row")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
