"""Encoding: documents to tokens.

Ids of a piece depend on its bytes alone. Pieces are split off in the JVM and
coded in Arrow batches without a shuffle: a worker encodes each distinct piece
once and keeps it, and a batch's tokens are gathered by columns. Tokens stay in
one array a document; vocabularies are small and go to the workers whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models, pretok
from .models import Vocab
from .stored import stored


def byte_ids(text: Column) -> Column:
    """The byte model: an id for each UTF-8 byte."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def byte_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., hex) for each byte; the hex pair is cheaper to count than a number."""
    return docs.select(*keep, F.explode(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))).alias("hex"))


def byte_counts(docs: DataFrame) -> DataFrame:
    """(id, n) of the bytes of all texts, counted in Arrow buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            text = b.column(0).drop_null()
            if len(text):
                ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
                total += np.bincount(np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]], minlength=256)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])

    return docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def byte_lists(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) under the byte model; a null text has no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_parts(whole, 1)):
            text = pc.fill_null(b.column(1), "")
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
            raw = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(raw.astype(np.int32)))], [id_col, "ids"])

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def hex_id(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("long")


def encode_pieces(pieces: DataFrame, v: Vocab, kernel: str) -> DataFrame:
    """(piece, ids) for distinct pieces."""
    shared = pieces.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, own = models.KERNELS[kernel], shared.value
        for b in batches:
            yield pd.DataFrame({"piece": b["piece"], "ids": [f(p.encode("utf-8", "surrogatepass"), own) for p in b["piece"]]})

    return pieces.select("piece").mapInPandas(run, "piece string, ids array<long>")


def piece_rows(docs: DataFrame, scheme: str, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    return docs.select(id_col, F.posexplode(pretok.pieces(F.col("text") if text is None else text, scheme)).alias("pos", "piece"))


#: Characters of pieces whose ids a worker keeps, and of a piece that is worth it.
KEPT, WORTH = 1 << 20, 256
#: Bytes of texts or pieces, and ids, that a worker looks at together.
BYTES, IDS = 1 << 20, 1 << 18


class Coder:
    """Ids of pieces; those of up to limit characters of short pieces are kept."""

    def __init__(self, v: Vocab, kernel: str, limit: int = KEPT):
        self.v, self.f, self.limit = v, models.coder(kernel, v), limit
        self.known: dict[str, np.ndarray] = {}
        self.size = 0

    def __call__(self, pieces: pa.Array) -> pa.ListArray:
        """A list of ids for each piece."""
        coded = pieces.dictionary_encode()
        if self.size > self.limit:
            self.known.clear()
            self.size = 0
        lists = []
        for p in coded.dictionary.to_pylist():
            ids = self.known.get(p)
            if ids is None:
                ids = np.array(self.f(p.encode("utf-8", "surrogatepass")), np.int64)
                if len(p) <= WORTH:
                    self.known[p] = ids
                    self.size += len(p)
            lists.append(ids)
        ends = np.cumsum([0, *map(len, lists)], dtype=np.int64).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
        return made if len(coded.indices) == len(lists) and coded.indices.equals(pa.array(np.arange(len(lists), dtype=np.int32))) else made.take(coded.indices)


def _ends(lists: pa.ListArray) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose sizes add up to about most; a row stays whole."""
    total, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_parts(batch: pa.RecordBatch, column: int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """parts() by the bytes of a column of texts, or of lists of pieces, which count as 8 more each."""
    c = batch.column(column)
    if pa.types.is_list(c.type):
        before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(c.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)])
        sizes = np.diff(before[_ends(c)])
    else:
        sizes = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return parts(batch, sizes, most)


def encode_lists(docs: DataFrame, v: Vocab, kernel: str = "bpe", scheme: str = "cl100k", id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of each document with any pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _coded(batches, shared.value, kernel, id_col)

    return _pieced(docs, scheme, id_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<long>")


def _pieced(docs: DataFrame, scheme: str, id_col: str) -> DataFrame:
    return docs.select(id_col, pretok.pieces(F.col("text"), scheme).alias("pieces")).filter(F.size("pieces") > 0)


def _coded(batches: Iterator[pa.RecordBatch], v: Vocab, kernel: str, id_col: str) -> Iterator[pa.RecordBatch]:
    """(id, ids) of (id, pieces)."""
    code = Coder(v, kernel)
    for whole in batches:
        for b in text_parts(whole, 1):
            ids = code(b.column(1).flatten())
            ends = _ends(ids)[_ends(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids.flatten())], [id_col, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], v: Vocab, id_col: str, kind: str) -> Iterator[pa.RecordBatch]:
    """(id, raw) of (id, ids)."""
    tokens = [t or b"" for t in v.tokens] + [b""]
    if kind == "wordpiece":
        tokens = [t[2:] if t.startswith(b"##") else b" " + t for t in tokens[:-1]] + [b""]
    names = pa.array(tokens, pa.binary())
    for whole in batches:
        for b in parts(whole, np.diff(_ends(whole.column(1)).astype(np.int64)), IDS):
            ids = b.column(1).flatten().to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < len(tokens) - 1), ids, len(tokens) - 1)
            text = pa.ListArray.from_arrays(pa.array(_ends(b.column(1))), names.take(pa.array(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join(text, pa.scalar(b"", pa.binary()))], [id_col, "raw"])


def _text(made: DataFrame, id_col: str, kind: str) -> DataFrame:
    text = F.decode("raw", "UTF-8")
    return made.select(id_col, (F.substring(text, 2, 1 << 30) if kind == "wordpiece" else text).alias("text"))


def roundtrip(docs: DataFrame, v: Vocab, kernel: str = "bpe", scheme: str = "cl100k", id_col: str = "doc_id", kind: str = "concat") -> DataFrame:
    """decode_lists(encode_lists(docs)): a worker decodes what it has encoded, so ids stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_coded(batches, shared.value, kernel, id_col), shared.value, id_col, kind)

    made = _pieced(docs, scheme, id_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, raw binary")
    return _text(made, id_col, kind)


def decode_lists(rows: DataFrame, v: Vocab, id_col: str = "doc_id", kind: str = "concat") -> DataFrame:
    """(id, text) of (id, ids). Ids without a token add nothing; kind wordpiece puts a space before tokens that don't carry on a word."""
    shared = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, shared.value, id_col, kind)

    return _text(rows.select(id_col, "ids").mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, raw binary"), id_col, kind)


def transcoded(rows: DataFrame, before: Vocab, after: Vocab, kernel: str = "bpe", scheme: str = "cl100k", id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """(id, text, n_before, ids) of (id, ids): the bytes of ids under one vocabulary, encoded under another.

    Negative ids, ids past the end of before, or over most, are an error.
    """
    last = F.lit(min(len(before.tokens) - 1, most if most is not None else len(before.tokens)))
    bad = F.exists("ids", lambda x: (x < 0) | (x > last))
    guarded = rows.select(id_col, F.when(bad, F.raise_error(F.concat(F.lit("an id is not in the vocabulary: "), F.col(id_col).cast("string"))).cast("array<bigint>")).otherwise(F.col("ids")).alias("ids"), F.size("ids").alias("n_before"))
    shared = rows.sparkSession.sparkContext.broadcast((before, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([t or b"" for t in shared.value[0].tokens], pa.binary())
        for whole in batches:
            for b in parts(whole, np.diff(_ends(whole.column(1)).astype(np.int64)), IDS):
                text = pa.ListArray.from_arrays(pa.array(_ends(b.column(1))), names.take(b.column(1).flatten()))
                yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join(text, pa.scalar(b"", pa.binary())), b.column(2)], [id_col, "raw", "n_before"])

    kind = rows.schema[id_col].dataType.simpleString()
    text = guarded.mapInArrow(run, f"{id_col} {kind}, raw binary, n_before int").select(id_col, F.decode("raw", "UTF-8").alias("text"), "n_before")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Coder(shared.value[1], kernel)
        for whole in batches:
            for b in text_parts(whole, 3):
                ids = ask(b.column(3).flatten())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(_ends(ids)[_ends(b.column(3))]), ids.flatten())], [id_col, "text", "n_before", "ids"])

    return text.select("*", pretok.pieces(F.col("text"), scheme).alias("pieces")).mapInArrow(code, f"{id_col} {kind}, text string, n_before int, ids array<long>")


def encode(docs: DataFrame, v: Vocab, kernel: str = "bpe", scheme: str = "cl100k", id_col: str = "doc_id") -> DataFrame:
    """(id, pos, piece, ids) for each piece of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(shared.value, kernel)
        for whole in batches:
            for b in text_parts(whole, 2):
                yield pa.RecordBatch.from_arrays([*b.columns, code(b.column(2))], [id_col, "pos", "piece", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return piece_rows(docs, scheme, id_col).mapInArrow(run, f"{id_col} {kind}, pos int, piece string, ids array<long>")


def encode_whole(docs: DataFrame, v: Vocab, kernel: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) without pre-tokenizing: documents are encoded as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, own = models.KERNELS[kernel], shared.value
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [f((t or "").encode("utf-8", "surrogatepass"), own) for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, ids array<long>")


def token_counts(docs: DataFrame, v: Vocab, kernel: str = "bpe", scheme: str = "cl100k") -> DataFrame:
    """(id, n) over all documents: tokens are counted where they are made, and only sums by id are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(shared.value, kernel)
        for b in (part for whole in batches for part in text_parts(whole, 0)):
            n = pc.value_counts(code(b.column(0).flatten()).flatten())
            yield pa.RecordBatch.from_arrays([n.field("values"), n.field("counts")], ["id", "n"])

    rows = docs.select(pretok.pieces(F.col("text"), scheme).alias("pieces")).filter(F.size("pieces") > 0)
    return rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def cached(docs: DataFrame, v: Vocab, path: str, kernel: str = "bpe", scheme: str = "cl100k", id_col: str = "doc_id") -> DataFrame:
    """(id, ids, hit) of documents with any pieces. Encodings are kept under path by the SHA-256 of their text, for this vocabulary, model and scheme; only texts that aren't there are encoded, each once, and added."""
    spark = docs.sparkSession
    model = f"{kernel}-{scheme}-{models.fingerprint(kernel, v, lambda t: models.KERNELS[kernel](t.encode(), v))[:16]}"
    rows = docs.select(id_col, "text", F.sha2("text", 256).alias("sha"))
    schema = "sha string, ids array<long>"
    try:
        known = spark.read.schema(schema).parquet(f"{path}/{model}")
        have = stored(known.select("sha").distinct(), "known")
    except AnalysisException:
        have = spark.createDataFrame([], "sha string")
    new = rows.join(have, "sha", "left_anti").groupBy("sha").agg(F.first("text").alias("text"))
    encode_lists(new, v, kernel, scheme, "sha").write.mode("append").parquet(f"{path}/{model}")
    all_ = spark.read.schema(schema).parquet(f"{path}/{model}")
    return rows.join(all_, "sha").join(have.withColumn("hit", F.lit(True)), "sha", "left").select(id_col, "ids", F.coalesce("hit", F.lit(False)).alias("hit"))


def vocab_table(spark, v: Vocab) -> DataFrame:
    """(id, hex, bytes) of a vocabulary."""
    rows = [(i, t.hex().upper(), len(t)) for i, t in enumerate(v.tokens) if t is not None]
    return spark.createDataFrame(rows, "id long, hex string, length int")


def overlays(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Byte tokens with their typed channels: start, end, boundary bits (1: chunk start, 2: code point start) and provenance."""
    rows = docs.select(id_col, F.posexplode(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))).alias("byte_start", "hex"))
    head = ~F.substring("hex", 1, 1).isin("8", "9", "A", "B")
    bits = F.when(F.col("byte_start") == 0, 1).otherwise(0).bitwiseOR(F.when(head, 2).otherwise(0))
    return rows.select(id_col, "byte_start", (F.col("byte_start") + 1).alias("byte_end"), hex_id(F.col("hex")).alias("token"), bits.alias("boundary"), F.lit(0).alias("provenance"))


def explain(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens of encode() with their bytes, the least efficient first: shortest, then in order."""
    rows = pieces.select("doc_id", "pos", "piece", F.posexplode("ids").alias("k", "token"))
    return rows.join(vocab, F.col("token") == F.col("id")).select("doc_id", "pos", "k", "piece", "token", "hex", "length").orderBy("length", "doc_id", "pos", "k")


def wrapped(ids: Column, pair: Column | None = None, cls: int = 101, sep: int = 102, doubled: bool = False) -> tuple[Column, Column]:
    """Post-processing of one text or a pair: special ids around, and type ids. doubled puts two separators between a pair, and type 0 everywhere."""
    one = F.concat(F.array(F.lit(cls)), ids, F.array(F.lit(sep)))
    if pair is None:
        return one, F.array_repeat(F.lit(0), F.size(one))
    two = F.concat(F.array(F.lit(sep)), pair, F.array(F.lit(sep))) if doubled else F.concat(pair, F.array(F.lit(sep)))
    return F.concat(one, two), F.concat(F.array_repeat(F.lit(0), F.size(one)), F.array_repeat(F.lit(0 if doubled else 1), F.size(two)))


def template(parts: list, ids: dict[str, Column]) -> tuple[Column, Column]:
    """parts: ("special", id, type), ("text", name, type), and ("typed", name, None) for what an earlier processor made, whose types are under "name types"."""
    cols = [F.array(F.lit(x).cast("long")) if kind == "special" else ids[x] for kind, x, _ in parts]
    types = [ids[f"{x} types"] if kind == "typed" else F.array_repeat(F.lit(t), F.size(c)) for c, (kind, x, t) in zip(cols, parts, strict=True)]
    return F.concat(*cols), F.concat(*types)


def image_tokens(width: Column, height: Column, patch: int = 16, most: int = 1024) -> dict[str, Column]:
    """Patch grid of an image: scaled down to most pixels on the longer side, rows ended by a break and the last one by an end."""
    ratio = F.greatest(width / F.lit(most), height / F.lit(most))
    w = F.when(ratio > 1, F.greatest(F.lit(1), F.floor(width / ratio))).otherwise(width)
    h = F.when(ratio > 1, F.greatest(F.lit(1), F.floor(height / ratio))).otherwise(height)
    cols, rows = F.floor((w - 1) / patch) + 1, F.floor((h - 1) / patch) + 1
    return {"n_cols": cols.cast("long"), "n_rows": rows.cast("long"), "n_tokens": ((cols + 1) * rows).cast("long")}


def multimodal(parts: DataFrame, by: str, order: str, image: int = 10, row_end: int = 12, image_end: int = 13, audio: int = 24) -> DataFrame:
    """(by, ids, n_texts): the tokens of parts of kind 0 (text, its ids), 1 (image of width and height: patches, a break after each row, an end after the last) and 2 (audio of samples), in order."""
    grid = image_tokens(F.col("width"), F.col("height"))
    row = F.array_repeat(F.lit(image), grid["n_cols"].cast("int"))
    rows = F.flatten(F.transform(F.sequence(F.lit(1), grid["n_rows"].cast("int")), lambda i: F.concat(row, F.array(F.when(i == grid["n_rows"], image_end).otherwise(row_end)))))
    ids = F.when(F.col("kind") == 0, F.col("text")).when(F.col("kind") == 1, rows).otherwise(F.array_repeat(F.lit(audio), audio_tokens(F.col("samples")).cast("int")))
    made = parts.select(by, order, ids.alias("ids"), (F.col("kind") == 0).cast("long").alias("is_text"))
    x = F.sort_array(F.collect_list(F.struct(order, "ids")))
    return made.groupBy(by).agg(F.flatten(F.transform(x, lambda r: r["ids"])).alias("ids"), F.sum("is_text").alias("n_texts"))


def audio_tokens(samples: Column, hop: int = 160, per_token: int = 8) -> Column:
    frames = F.floor((samples + hop - 1) / hop)
    return F.floor((frames + per_token - 1) / per_token).cast("long")
