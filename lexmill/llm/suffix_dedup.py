"""Repeated byte strings by merged Burrows-Wheeler transforms of shards.

Sorting all suffixes of a corpus by hundreds of bytes is out of reach, so
suffixes are dealt by the anchors of their 400-byte windows: equal windows
have equal anchors and meet. A segment (the windows with one anchor) that occurs
twice as a whole is repeated throughout, and is kept once as a reference. All
different segments of an anchor go into suffix orders: each task builds
those of shards of them and merges these by interleave refinement. The windows
in repeated intervals of the merged order, where neighbours have 400 bytes in
common, are the repeated ones; no hash has a say in that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt
from .common import discard, documents, free, stored
from .simhash import dealt_join
from .windows import MARK, NEEDS, RESOLVED, keyed_documents, keyed_runs, mix, read_lists, resolved, run_hashes, segment_rows, united

WINDOW, GRAM = 400, 200
#: A hash for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Segments that a task looks at together.
TOGETHER = 1000
#: Different segments of an anchor that one task orders at most (some MB); beyond, their windows are dealt by 128-bit hashes.
BUCKET = 4000
#: A second hash for each byte value.
OTHER = mix(BYTES + np.uint64(0x632BE59BD9B4E019))


def byte_hashes(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def segment_texts(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(k, doc, th, a, n, st, bytes) of the runs (doc, th, a, n, st, k)."""
    value = F.struct("a", "n", "st", "k")
    by_doc = runs.groupBy("doc", "th").agg(F.collect_list(value).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "doc", "th", "a", "n", "st", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.binary()]
        for b in batches:
            rows, size = [], 0
            for doc, th, t, own in zip(*(b.column(i).to_pylist() for i in range(3)), read_lists(b.column(3)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for a, n, st, k in zip(*(x.tolist() for x in own), strict=True):
                    rows.append((k, doc, th, a, n, st, raw[a : a + n + window - 1]))
                    size += len(rows[-1][6])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.join(by_doc, ["doc", "th"]).select("doc", "th", "t", "runs").mapInArrow(run, "k long, doc long, th long, a int, n int, st byte, bytes binary")


def _runs(doc: np.ndarray, th: np.ndarray, a: np.ndarray, n: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
    """Maximal runs of repeated windows; repeated has one flag for each window of the segments (a, n), in their order."""
    own = np.repeat(np.arange(len(n)), n)
    at = a[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(repeated)
    if len(hit):
        new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)])
        first = hit[new]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(hit)]]))
    else:
        first, size = hit, hit
    return pa.RecordBatch.from_arrays([pa.array(doc[own[first]]), pa.array(th[own[first]]), pa.array(at[first].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.ones(len(first), np.int8))], ["doc", "th", "a", "n", "st"])


def repeated_by_order(texts: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """Runs of windows of segments (st NEEDS) that occur in another segment with the same k."""

    def look(doc: np.ndarray, th: np.ndarray, a: np.ndarray, n: np.ndarray, st: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        n = n.astype(np.int64)
        sizes = np.array([len(x) + 1 for x in raw])
        own = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + within  # each window's suffix
        again = bwt.merged(list(raw), window, shard_bytes).repeated()[at]
        return _runs(doc, th, a, n, again & (st[own] == NEEDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, *cols in keyed_runs(batches, TOGETHER):
            lo = 0
            while lo < len(k):  # some segments at a time, but all of an anchor
                hi = lo + int(np.searchsorted(k[lo:], k[min(lo + TOGETHER, len(k)) - 1], side="right"))
                yield look(*(c[lo:hi] for c in cols))
                lo = hi

    return texts.repartition("k").sortWithinPartitions("k", "doc", "a").mapInArrow(run, "doc long, th long, a int, n int, st byte")


def repeated_by_hash(texts: DataFrame, window: int) -> DataFrame:
    """The same for segments whose anchor is too frequent to bring together: each window goes where its own 128-bit hash is dealt."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, a, st, raw in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 5, 6)), strict=True):
                w, x = run_hashes(byte_hashes(raw), window), run_hashes(OTHER[np.frombuffer(raw, np.uint8)], window)
                n = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(x.view(np.int64)), pa.array(np.full(n, doc)), pa.array(np.full(n, th)), pa.array((a + np.arange(n)).astype(np.int32)), pa.array(np.full(n, st, np.int8))], ["h", "l", "doc", "th", "a", "st"])

    rows = stored(texts.mapInArrow(explode, "h long, l long, doc long, th long, a int, st byte"), "hot")
    rows = rows.select(F.struct("h", "l").alias("w"), "doc", "th", "a", "st")
    twice = rows.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").withColumnRenamed("w", "w2")
    return dealt_join(rows.filter(F.col("st") == NEEDS + 8), "w", twice, "w2", "c").select("doc", "th", "a", F.lit(1).alias("n"), F.lit(1).cast("byte").alias("st"))


def drop_repeated_bytes(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, shard_bytes: int = 1 << 18, hot: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_bytes, kept (binary) and spans [first byte, end) that were removed.

    A byte goes if it lies in a 400-byte string that also starts anywhere else,
    in the same text too; overlaps count, and strings don't cross texts. Null
    texts are empty; texts of fewer than 400 bytes lose nothing. Repeated rows
    count as texts of their own, so they remove each other. Cuts may
    fall inside a character, so what stays is bytes. An empty table gives no rows.
    Whole segments are compared by 128 bits of hashes, parts of them by their
    bytes; past bucket different segments of an anchor, by 128-bit hashes too. Ids must
    be integers, or text that Spark casts to such. A text is held whole by one
    task, but looked at a piece at a time.
    """
    spark = df.sparkSession
    docs = keyed_documents(df, id_col, text_col)
    segments = stored(resolved(segment_rows(docs, bytes, byte_hashes, gram, window, False, hot), False).drop("s"), "segments")
    free(spark)
    compared = segments.filter(F.col("st") != RESOLVED)
    big = stored(compared.filter("st < 8").groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > bucket).select("k", F.lit(8).alias("more")), "big")
    compared = compared.join(big, "k", "left").withColumn("st", (F.col("st") + F.when(F.col("st") < 8, F.coalesce("more", F.lit(0))).otherwise(0)).cast("byte"))
    texts = stored(segment_texts(docs, compared.select(segments.columns), window), "texts")  # of all of them at once, as the documents are shuffled for it
    free(spark)
    hot = texts.filter("st >= 8")
    spans = [segments.filter(F.col("st") == RESOLVED).drop("k"), stored(repeated_by_order(texts.filter("st < 8"), window, shard_bytes), "intervals")]
    if not hot.isEmpty():
        spans.append(stored(repeated_by_hash(hot, window), "intervals"))
    discard(texts)
    free(spark)
    found = spans[0].unionByName(spans[1]) if len(spans) == 2 else spans[0].unionByName(spans[1]).unionByName(spans[2])
    found = found.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, pieces, sha, kept, cut = [], [], [], [], [], []
            for t, runs in zip(b.column(1).to_pylist(), read_lists(b.column(2)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                starts, ends = united(*runs, window) if runs else ([], [])
                left = b"".join([raw[i:j] for i, j in zip([0, *ends], [*starts, len(raw)], strict=True)])
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                pieces.append(len(starts))
                sha.append(hashlib.sha256(left).hexdigest())
                if keep_bytes:
                    kept.append(left)
                    cut.append([{"first": i, "end": j} for i, j in zip(starts, ends, strict=True)])
            cols = {"doc": b.column(0), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(pieces, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if keep_bytes:
                cols |= {"kept": pa.array(kept, pa.binary()), "spans": pa.array(cut, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<first: long, end: long>>" * keep_bytes
    out = docs.join(found, ["doc", "th"], "left").select("doc", "t", "runs").mapInArrow(run, schema)
    return out.select(F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias(id_col), *out.columns[1:])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, sf_dir), keep_bytes=False)


#: Strings are told apart by their MD5, as hex digits two to a byte; runs of hits that touch are one span.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT rid, i, md5(substr(h, (2 * i + 1)::INT, 800)) AS s FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT rid, i FROM win SEMI JOIN twice USING (s)),
step AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM step),
span AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY rid, k),
gap AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS b FROM span),
cut AS (SELECT rid, sum(z - a)::BIGINT AS n, count(*) AS spans, max(z) AS last, string_agg(substr(h, (2 * b + 1)::INT, (2 * (a - b))::INT), '' ORDER BY a) AS pieces FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE pieces || substr(h, (2 * last + 1)::INT) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
