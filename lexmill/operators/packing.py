"""Windows over token sequences, packing, and spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_windows(n: Column, size: int, overlap: int = 0) -> Column:
    """ARRAY<STRUCT<start, end>> over n tokens: windows of at most size that overlap; no window after one that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than size")
    return late_windows(n, size, size - overlap)


def late_windows(n: Column, window: int, stride: int) -> Column:
    """The same by stride, which may leave gaps."""
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    n = n.cast("long")
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)).cast("long") * stride
    starts = F.sequence(F.lit(0).cast("long"), F.least(last, F.greatest(F.floor((n - 1) / stride) * stride, F.lit(0))), F.lit(stride).cast("long"))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + window, n).alias("end")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))


def offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """sizes with the column before: the sum of all sizes earlier in order. Two levels: order is cut into ranges, as many as shuffles have partitions, ranges are summed, and only the ranges' sums pass through one task."""
    ranged = sizes.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    within = F.sum(size).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    ranged = ranged.withColumn("_within", F.coalesce(within, F.lit(0)))
    from .stored import stored

    ranged = stored(ranged, "ranges")  # ranges are sampled: they must not be dealt twice
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_base")
    return ranged.join(F.broadcast(before), "_part").withColumn("before", (F.col("_base") + F.col("_within")).cast("long")).drop("_part", "_within", "_base")


def pack(docs: DataFrame, ids: str, length: int, bos: int | None = None, eos: int | None = None, pad: int | None = None, order: str = "doc_id") -> DataFrame:
    """(seq, ids): documents one after the other, with bos and eos around each, cut to length. The tail is dropped, or filled with pad."""
    around = [F.array(F.lit(bos).cast("int"))] * (bos is not None) + [F.col(ids).cast("array<int>")] + [F.array(F.lit(eos).cast("int"))] * (eos is not None)
    rows = docs.select(order, F.concat(*around).alias("ids")).withColumn("n", F.size("ids").cast("long"))
    at = offsets(rows, order, "n")
    # a document is cut into the sequences that it reaches, so arrays and not tokens are moved
    first, last = F.floor(F.col("before") / length), F.floor((F.col("before") + F.col("n") - 1) / length)
    lo = lambda q: F.greatest(F.col("before"), q * length)
    hi = lambda q: F.least(F.col("before") + F.col("n"), (q + 1) * length)
    cut = F.transform(F.sequence(first, last), lambda q: F.struct(q.alias("seq"), lo(q).alias("lo"), F.slice("ids", (lo(q) - F.col("before") + 1).cast("int"), (hi(q) - lo(q)).cast("int")).alias("own")))
    parts = at.filter("n > 0").select(F.explode(cut).alias("x")).select("x.*")
    made = parts.groupBy("seq").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "own"))), lambda x: x["own"])).alias("ids"))
    if pad is None:
        return made.filter(F.size("ids") == length)
    return made.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad).cast("int"), F.lit(length) - F.size("ids"))))


def id_dtype(n: Column) -> Column:
    return F.when(n <= 65536, "uint16").otherwise("uint32")


def fixed_groups(tokens: DataFrame, size: int, stride: int, doc: str = "doc_id", pos: str = "pos", hard: str = "hard") -> DataFrame:
    """Groups of size tokens every stride within runs that a hard token (kept alone) ends: (doc, segment, group, kind, start, n, weight, center).

    kind is preserved for a hard token, full, partial for a last group that is
    shorter, uncovered for tokens that a stride over size leaves out.
    """
    w = W.partitionBy(doc).orderBy(pos)
    before = F.sum(F.col(hard).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    seg = tokens.withColumn("segment", F.coalesce(before, F.lit(0)) * 2 + F.col(hard).cast("int"))
    k = F.row_number().over(W.partitionBy(doc, "segment").orderBy(pos)) - 1
    seg = seg.withColumn("k", k.cast("long"))
    reach = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") - size) / stride) + 1).cast("long"), F.floor(F.col("k") / stride).cast("long")))
    lone = seg.filter(hard).select(doc, "segment", F.lit(0).cast("long").alias("group"), F.col(pos), F.lit("preserved").alias("kind"))
    soft = seg.filter(~F.col(hard))
    grouped = soft.select(doc, "segment", pos, "k", reach.alias("group")).filter((F.col("k") >= F.col("group") * stride) & (F.col("k") < F.col("group") * stride + size)).select(doc, "segment", "group", pos, F.lit("full").alias("kind"))
    left = soft.filter(F.col("k") % stride >= size).select(doc, "segment", F.floor(F.col("k") / stride).alias("group"), pos, F.lit("uncovered").alias("kind"))
    rows = grouped.unionByName(lone).unionByName(left).groupBy(doc, "segment", "group", "kind").agg(F.min(pos).cast("long").alias("start"), F.count("*").alias("n"), F.max(pos).alias("last"))
    kind = F.when((F.col("kind") == "full") & (F.col("n") < size), "partial").otherwise(F.col("kind"))
    return rows.select(doc, "segment", "group", kind.alias("kind"), "start", "n", F.round(1 / F.col("n"), 6).alias("weight"), ((F.col("start") + F.col("last")) / 2).alias("center"))


def token_range(spans: DataFrame, tokens: DataFrame, doc: str = "doc_id", bucket: int = 256) -> DataFrame:
    """(doc, span_id, first, last): tokens (doc, pos, start, end) that byte spans (doc, span_id, byte_start, byte_end) overlap. Both sides are dealt into buckets of bytes, so the range join is an equi-join."""
    spread = lambda a, z: F.explode(F.sequence(F.floor(a / bucket), F.floor((F.greatest(z - 1, a)) / bucket)))
    s = spans.withColumn("_b", spread(F.col("byte_start"), F.col("byte_end")))
    t = tokens.withColumn("_b", spread(F.col("start"), F.col("end")))
    both = s.join(t, [doc, "_b"]).filter((F.col("start") < F.col("byte_end")) & (F.col("end") > F.col("byte_start")))
    return both.groupBy(doc, "span_id").agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"))


# --- windows that end at boundaries ------------------------------------------

ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "no", "fig", "al", "z.b", "bzw", "usw", "nr", "sr", "sra", "dra", "av", "p.ej", "m", "mme", "mlle"}
TERMINATORS = set(".!?…。！？｡।॥؟۔።")
CLOSERS = set("\"')]}»”’」』")


def sentence_end(text: str, i: int) -> bool:
    """Whether a sentence ends before text[i]."""
    j = i
    while j and text[j - 1].isspace():
        j -= 1
    if j == i and i < len(text) and not (j and text[j - 1] in "。！？｡"):
        return False
    while j and text[j - 1] in CLOSERS:
        j -= 1
    if not j or text[j - 1] not in TERMINATORS:
        return False
    if text[j - 1] != ".":
        return True
    word = re.search(r"(\S*)\.$", text[max(0, j - 24) : j])[1].lstrip("\"'([{«“").lower()
    return not (word in ABBREVIATIONS or re.fullmatch(r"(?:\w\.)*\w", word) and len(word) < 4 and "." in word or re.fullmatch(r"\w", word) and word.isalpha() and not word.isdigit())


def boundary(text: str, i: int, kind: str, words: set[str] | None = None) -> bool:
    if i in (0, len(text)) or kind == "codepoint":
        return True
    if kind == "word":
        return text[i].isspace() or text[i - 1].isspace()
    if kind == "paragraph":
        return text[:i].endswith("\n\n") or text[:i].endswith("\r\n\r\n")
    if kind == "sentence":
        return sentence_end(text, i)
    raise ValueError(kind)


def dictionary_words(text: str, words: set[str]) -> list[int]:
    """Ends of the words of a text without spaces: the longest word of the dictionary, else one character."""
    longest = max(map(len, words), default=1)
    out, i = [], 0
    while i < len(text):
        i += next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
        out.append(i)
    return out


def snapped(text: str, size: int, overlap: int, kind: str, words: set[str] | None = None) -> list[tuple[int, int]]:
    """Character windows of at most size whose ends move left to the nearest boundary, or stay if there is none; each starts overlap before the last one's end, one further at least."""
    ends = set(dictionary_words(text, words)) if kind == "dictionary" else None
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        cut = next((i for i in range(end, start, -1) if (i in ends if ends is not None else boundary(text, i, kind))), end)
        out.append((start, cut))
        if cut >= len(text):
            break
        start += max(1, cut - start - overlap)
    return out


def snapped_windows(size: int, overlap: int, kind: str, words: set[str] | None = None):
    @F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in snapped(t, size, overlap, kind, words)], na_action="ignore")

    return run


def sampled_windows(docs: DataFrame, ids: str, length: int, per_document: int, seed: int, doc: str = "doc_id") -> DataFrame:
    """(doc, k, start, ids): per_document windows at places that seed and id decide, from documents that are long enough."""
    rows = docs.filter(F.size(ids) >= length).select(doc, ids, F.explode(F.sequence(F.lit(0), F.lit(per_document - 1))).alias("k"))
    start = F.pmod(F.xxhash64(doc, "k", F.lit(seed)), F.size(ids) - length + 1)
    return rows.select(doc, "k", start.alias("start"), F.slice(ids, (start + 1).cast("int"), length).alias("ids"))
