"""Repeated word passages by relative Lempel-Ziv factors.

Every document is parsed into factors, each a run of words that stands in a
reference: the documents with smaller ids. The references are indexed in
blocks. A block is a run of words whose 13-word windows have one anchor (the
six words with the least hash); it lies in the index under its anchor, so a
document meets all blocks that can hold a window of its own.

A block of a document that equals a reference block as a whole points to it.
Where the anchor is known but the blocks differ, as they do where a copy
begins and ends, the words themselves are compared: from each word on the
factor runs on greedily as long as a reference block of that anchor, in a
smaller document, has the same words. The parse then takes factors in the
order of the document and runs on over block after block for as long as they
point to consecutive words of one reference. Factors of 13 words or more are
the duplicate spans. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, free, stored
from .simhash import dealt_join
from .windows import NEEDS, RESOLVED, keyed_documents, read_lists, resolved, segment_rows, united

WINDOW, GRAM = 13, 6
#: Different blocks of an anchor that one task compares word by word; the windows of further ones are told apart by 128-bit hashes.
BUCKET = 2000


class WordHasher:
    """Hashes of words; those of up to limit words are kept."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        if len(known) > self.limit:
            known.clear()
        for w in words:
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh64_intdigest(w)
            out.append(x)
        return np.array(out, np.uint64)


class _Words:
    """Makes a WordHasher on first use, in the task."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        own = getattr(self, "own", None)
        if own is None:
            own = self.own = WordHasher()
        return own(words)


def block_words(docs: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """(k, doc, th, a, n, words) of the blocks (doc, th, a, n, k): their words joined by one space."""
    by_doc = blocks.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "n", "k")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["k", "doc", "th", "a", "n", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            rows, size = [], 0
            for doc, th, t, (a, n, k) in zip(*(b.column(i).to_pylist() for i in range(3)), read_lists(b.column(3)), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                for at, count, key in zip(a.tolist(), n.tolist(), k.tolist(), strict=True):
                    rows.append((key, doc, th, at, count, b" ".join(words[at : at + count + window - 1])))
                    size += len(rows[-1][5])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.join(by_doc, ["doc", "th"]).select("doc", "th", "t", "blocks").mapInArrow(run, "k long, doc long, th long, a int, n int, words binary")


FACTOR = "doc long, th long, a int, n int, s long, k int"


def factors(texts: DataFrame, window: int) -> DataFrame:
    """The factors of window or more words of the blocks (k, doc, th, a, n, words) in blocks of smaller documents with the same k: their first window a, number of windows n, and the document s and window k that they point to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, index = None, {}
        for b in batches:
            out = []
            for k, doc, th, a, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != anchor:
                    anchor, index = k, {}
                words, factor = text.split(b" "), None
                for j in range(n):
                    there = index.setdefault(b" ".join(words[j : j + window]), (doc, a + j))
                    if there[0] == doc:  # rows come by document: no smaller one has it
                        factor = None
                    elif factor and factor[4] == there[0] and factor[5] + factor[3] == there[1]:
                        factor[3] += 1
                    else:
                        factor = [doc, th, a + j, 1, *there]
                        out.append(factor)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], ["doc", "th", "a", "n", "s", "k"])

    return texts.repartition("k").sortWithinPartitions("k", "doc", "th", "a").mapInArrow(run, FACTOR)


def factors_by_hash(texts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many blocks for one task: each window goes where its own 128-bit hash is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, a, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.split(b" ")
                for j in range(n):
                    h = xxhash.xxh3_128_intdigest(b" ".join(words[j : j + window]))
                    rows.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), doc, th, a + j))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["h", "l", "doc", "th", "a"])

    rows = stored(texts.select("doc", "th", "a", "n", "words").mapInArrow(run, "h long, l long, doc long, th long, a int"), "windows")
    rows = rows.select(F.struct("h", "l").alias("w"), "doc", "th", "a")
    least = rows.groupBy("w").agg(F.min(F.struct("doc", "a")).alias("least"), F.count("*").alias("c")).filter("c > 1").withColumnRenamed("w", "w2")
    found = dealt_join(rows, "w", least, "w2", "c").filter("doc > least.doc")
    return found.select("doc", "th", "a", F.lit(1).alias("n"), F.col("least.doc").alias("s"), F.col("least.a").alias("k"))


def parse(x: np.ndarray, ref: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of a document's pieces (x = first window << 32 | windows, reference document, window there): pieces that go on in the same place of the same reference become one factor (first window, windows, ref, at)."""
    order = np.argsort(x, kind="stable")
    first, count, ref, at = x[order] >> 32, x[order] & 0xFFFFFFFF, ref[order], at[order].astype(np.int64)
    once = np.concatenate([[True], first[1:] != first[:-1]])  # repeated rows bring their pieces twice
    first, count, ref, at = first[once], count[once], ref[once], at[once]
    new = np.concatenate([[True], (first[1:] != first[:-1] + count[:-1]) | (ref[1:] != ref[:-1]) | (at[1:] - first[1:] != at[:-1] - first[:-1])])
    head = np.flatnonzero(new)
    return first[head], np.add.reduceat(count, head), ref[head], at[head]


def drop_repeated_passages(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of df: id, n_words, n_removed, kept_sha256, n_factors (of window words or more) and, with keep_text, kept_text, spans [first word, end) that were removed, and factors (first word, end, the id and word they point to).

    A word goes if a window of 13 words around it also starts in a document
    with a smaller id. Words are unchanged runs of non-space characters; kept
    ones are joined by one space. Null and blank texts have no words; texts of
    fewer than 13 words lose none. Rows that share an id are never compared
    with each other, and repeated rows have equal results. A null id
    is larger than all others; ids must be integers, as their order decides, or
    text that Spark casts to such. An empty table gives no rows. Whole blocks are
    compared by 128 bits of hashes, parts of blocks by their words. A text is held
    whole by one task, but looked at a piece at a time.
    """
    spark = df.sparkSession
    docs = keyed_documents(df, id_col, text_col)
    blocks = stored(resolved(segment_rows(docs, bytes.split, _Words(), gram, window, True, hot), True), "blocks")
    free(spark)
    open_ = blocks.filter(F.col("st") == NEEDS).select("doc", "th", "a", "n", "k")
    texts = stored(block_words(docs, open_, window), "words")
    free(spark)
    big = stored(texts.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > bucket).select("k"), "big")
    parts = [blocks.filter(F.col("st") == RESOLVED).select("doc", "th", "a", "n", "s", F.col("k").cast("int").alias("k"))]
    parts.append(stored(factors(texts.join(big, "k", "left_anti").select(texts.columns), window), "factors"))
    if not big.isEmpty():
        parts.append(stored(factors_by_hash(texts.join(big, "k", "left_semi"), window), "factors"))
    discard(texts)
    free(spark)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    piece = F.struct(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("x"), "s", "k")
    found = found.groupBy("doc", "th").agg(F.collect_list(piece).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, many, kept, cut, all_factors = [], [], [], [], [], [], []
            for t, pieces in zip(b.column(1).to_pylist(), read_lists(b.column(2)), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                starts, ends, own, left = [], [], (), words
                if pieces:
                    own = parse(*pieces)
                    starts, ends = united(own[0], own[1], window)
                    left = [w for i, j in zip([0, *ends], [*starts, len(words)], strict=True) for w in words[i:j]]
                line = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(line).hexdigest())
                many.append(len(own[0]) if pieces else 0)
                if keep_text:
                    kept.append(line.decode("utf-8", "surrogatepass"))
                    cut.append([{"first": i, "end": j} for i, j in zip(starts, ends, strict=True)])
                    all_factors.append([{"first": f, "end": f + c + window - 1, "ref": r, "ref_first": x} for f, c, r, x in zip(*(v.tolist() for v in own), strict=True)] if pieces else [])
            cols = {"doc": b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "n_factors": pa.array(many, pa.int64())}
            if keep_text:
                long = lambda *names: pa.list_(pa.struct([(x, pa.int64()) for x in names]))
                cols |= {"kept_text": pa.array(kept, pa.string()), "spans": pa.array(cut, long("first", "end")), "factors": pa.array(all_factors, long("first", "end", "ref", "ref_first"))}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc long, n_words long, n_removed long, kept_sha256 string, n_factors long" + ", kept_text string, spans array<struct<first: long, end: long>>, factors array<struct<first: long, end: long, ref: long, ref_first: long>>" * keep_text
    out = docs.join(found, ["doc", "th"], "left").select("doc", "t", "pieces").mapInArrow(run, schema)
    return out.select(F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias(id_col), *out.columns[1:])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(documents(spark, sf_dir), keep_text=False).drop("n_factors")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_id AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT rid, i FROM win JOIN least_id USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT rid, i + k AS p FROM hit, range(13) t(k)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
