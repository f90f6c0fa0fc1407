"""Vocabulary files, sinks and caches: what is written is read again and used on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import encode, models, packing, pretok
from lexmill.operators.stored import folder, stored
from lexmill.sources import readers, sinks, writers

from .registry import BYTES, HEX_ID, query, table
from .tokens import UNI, WP, V

#: Where the vocabularies of public tokenizers lie.
PUBLIC = "/opt/tokenizers"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _new(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/lexmill-{name}-{uuid.uuid4().hex[:12]}"


#: Format: its file, and the model and pieces that use it.
FORMATS = {
    "ranks": (lambda: writers.ranks_text(V), "bpe", "cl100k"),
    "tokenizer_json": (lambda: writers.tokenizer_json(V), "bpe", "cl100k"),
    "piece_model": (lambda: writers.piece_model(UNI, [6 if 128 <= i < 256 else 1 for i in range(len(UNI.tokens))]), "unigram", "cl100k"),
    "world": (lambda: writers.world_text(V), "longest", "identity"),
    "tekken": (lambda: writers.tekken_json(V, 0), "bpe", "tekken"),
    "binary": (lambda: writers.binary(V), "ungreedy", "identity"),
}


def _format(name: str) -> None:
    """A vocabulary is written in a format, told by its bytes, loaded, and used on all documents, whose texts must come back."""
    data, kernel, scheme = FORMATS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _new(spark, name)
        sinks.put_bytes(spark, path, data())
        raw = readers.read_bytes(spark, path)
        v, kind = readers.load(raw), readers.detect(raw)
        return encode.roundtrip(_docs(spark, sf_dir), v, kernel, scheme).select("doc_id", F.sha2("text", 256).alias("sha"), F.lit(kind).alias("format"))

    run.__name__ = f"format_{name}"
    query(f"SELECT doc_id, sha256(text) AS sha, '{name}' AS format FROM documents WHERE text <> ''")(run)


for _name in FORMATS:
    _format(_name)


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def public_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A public vocabulary of 50,256 tokens over all documents, and back; its ids are held against the library that it belongs to in tests."""
    v = readers.load(readers.read_bytes(spark, f"file://{PUBLIC}/byte_bpe_50k.tiktoken"))
    return encode.roundtrip(_docs(spark, sf_dir), v, "bpe", "gpt2").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"SELECT rank, hex FROM (SELECT i AS rank, hex FROM (VALUES {', '.join(f'({i}, {chr(39)}{t.hex().upper()}{chr(39)})' for i, t in enumerate(V.tokens))}) AS t(i, hex))")
def rank_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "ranks")
    sinks.put_bytes(spark, path, writers.ranks_text(V))
    return readers.rank_table(spark, path)


@query("SELECT kind, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents, (VALUES ('json'), ('parquet')) k(kind) WHERE text IS NOT NULL GROUP BY kind")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as compressed JSON lines and as Parquet, read again as corpora."""
    docs, out = _docs(spark, sf_dir).filter("text IS NOT NULL").select("text"), None
    for kind in ("json", "parquet"):
        path = _new(spark, kind)
        (docs.write.option("compression", "gzip").json if kind == "json" else docs.write.parquet)(path)
        got = readers.documents(spark, path, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT doc_id, k AS chunk, sha256(substr(text, (k * 200 + 1)::INT, 200)) AS sha FROM (SELECT doc_id, text, unnest(range((length(text) + 199) // 200)) AS k FROM documents)")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 characters as JSON lines, one record each, read again."""
    n = F.ceil(F.length("text") / 200)
    rows = _docs(spark, sf_dir).filter("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    path = _new(spark, "chunks")
    rows.select("doc_id", "chunk", F.expr("substring(text, cast(chunk * 200 + 1 AS INT), 200)").alias("text")).write.json(path)
    back = spark.read.schema("doc_id long, chunk long, text string").json(path)
    return back.select("doc_id", "chunk", F.sha2("text", 256).alias("sha"))


@query(f"SELECT count(*) AS n, sum({HEX_ID})::BIGINT AS total, sum(({HEX_ID}) * (pos % 1009))::BIGINT AS ordered FROM {BYTES}")
def flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ids of all documents in flat files, read again; with the documents' sizes the order is checked too."""
    docs, path = encode.byte_lists(_docs(spark, sf_dir)), _new(spark, "flat")
    written = stored(sinks.write_flat(docs, path), "written")
    ids = sinks.read_flat(spark, path).select("part", F.posexplode("ids").alias("i", "id"))
    before = written.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")
    starts = packing.offsets(docs.select("doc_id", F.size("ids").cast("long").alias("n")), "doc_id", "n").filter("n > 0")
    at = ids.join(before, "part").select((F.col("base") + F.col("i")).alias("at"), "id")
    # each place belongs to the document whose bytes reach over it: both sides meet by blocks of places
    block = 1 << 16
    spans = starts.select("before", "n", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block))).alias("b"))
    here = at.withColumn("b", F.floor(F.col("at") / block)).join(spans, "b").filter("at >= before AND at < before + n")
    return here.agg(F.count("*").alias("n"), F.sum("id").alias("total"), F.sum(F.col("id") * ((F.col("at") - F.col("before")) % 1009)).alias("ordered"))


@query("""SELECT count(*) AS n_rows, sum(CASE WHEN len = 128 THEN 1 ELSE 0 END)::BIGINT AS whole, (sum(total))::BIGINT AS total FROM (
SELECT 128 AS len, 0 AS total FROM range((SELECT sum(strlen(text) + 1) FROM documents)::BIGINT // 128)) """.replace("(sum(total))::BIGINT", "(SELECT (sum(strlen(text) + 1)::BIGINT // 128) * 128 FROM documents)"))
def packed_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of bytes, each ended by 256, packed to 128 and written as arrays, read again."""
    docs, path = encode.byte_lists(_docs(spark, sf_dir)), _new(spark, "npy")
    stored(sinks.write_npy(packing.pack(docs, "ids", 128, eos=256), path), "written")
    rows = sinks.read_npy(spark, path)
    return rows.agg(F.count("*").alias("n_rows"), F.sum((F.size("ids") == 128).cast("long")).alias("whole"), F.sum(F.size("ids")).cast("long").alias("total"))


# --- models that had no query ----------------------------------------------------


@query(r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s\p{Z}]+')) AS word, true AS same FROM documents")
def merge_graph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging by a graph of id pairs gives what merging by ranks gives."""
    merges = [(V.by_bytes[a], V.by_bytes[b]) for a, b in writers.rank_merges(V)]
    graph = models.merge_graph(V, merges)

    @F.udf("boolean", useArrow=True)
    def same(word: str) -> bool:
        raw = word.encode("utf-8", "surrogatepass")
        return models.graph_bpe(raw, V, graph) == models.bpe(raw, models.Vocab(V.tokens, {V.tokens[a] + V.tokens[b]: i for i, (a, b) in enumerate(merges)}))

    words = _docs(spark, sf_dir).select(F.explode(pretok.pieces(F.col("text"), "whitespace_split")).alias("word")).distinct()
    return words.select("word", same("word").alias("same"))


@query(r"SELECT word, true AS whole, true AS again FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s\p{Z}]+')) AS word FROM documents) WHERE regexp_matches(word, '^[ -~]+$')")
def sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmentation drawn for each word of ASCII: it spells the word, and the same seed draws it again."""

    @F.udf("struct<whole: boolean, again: boolean>", useArrow=True)
    def drawn(word: str) -> tuple[bool, bool]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = models.sampled(raw, UNI, 0.3, 7)
        return b"".join(UNI.tokens[i] for i in ids) == raw, ids == models.sampled(raw, UNI, 0.3, 7)

    words = _docs(spark, sf_dir).select(F.explode(pretok.pieces(F.col("text"), "whitespace_split")).alias("word")).filter(F.col("word").rlike("^[ -~]+$")).distinct()
    return words.select("word", drawn("word").alias("x")).select("word", "x.*")


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: CASE WHEN strlen(w) > 100 THEN '[UNK]' ELSE w END), ' ') AS text FROM documents WHERE regexp_matches(lower(text), '[a-z]')")
def wordpiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of small letters, encoded and decoded again: one space stands between words."""
    rows = _docs(spark, sf_dir).select("doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ").alias("text"))
    return encode.roundtrip(rows, WP, "wordpiece", "whitespace_split", kind="wordpiece")


@query("SELECT doc_id, sha256(text) AS sha, true AS same FROM documents WHERE text <> ''")
def chunked_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at safe places, the parts encoded as rows of their own and put together: the tokens are those of the whole."""
    parts = _docs(spark, sf_dir).select("doc_id", F.posexplode(pretok.safe_cut_rows(F.col("text"), 400)).alias("part", "text")).withColumn("key", F.struct("doc_id", "part"))
    coded = encode.encode_lists(parts.select("key", "text"), V, id_col="key").select("key.doc_id", "key.part", "ids")
    whole = coded.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    want = encode.encode_lists(_docs(spark, sf_dir), V).select("doc_id", F.xxhash64("ids").alias("want"))
    both = whole.join(want, "doc_id").select("doc_id", "ids", (F.xxhash64("ids") == F.col("want")).alias("same"))
    text = encode.decode_lists(both.select(F.struct("doc_id", "same").alias("key"), "ids"), V, id_col="key")
    return text.select("key.doc_id", F.sha2("text", 256).alias("sha"), "key.same")


@query("SELECT run, count(*) AS n_texts, sum(CASE WHEN run = 2 THEN 1 ELSE 0 END)::BIGINT AS hits, sum(strlen(text))::BIGINT AS n_ids FROM documents, (VALUES (1), (2)) r(run) WHERE text <> '' GROUP BY run")
def prefix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings kept by the digest of their text: the second run finds all of them."""
    path, out = _new(spark, "cache"), None
    for run in (1, 2):
        got = stored(encode.cached(_docs(spark, sf_dir), models.Vocab(V.tokens[:256]), path, scheme="identity"), "coded")
        n = got.agg(F.lit(run).alias("run"), F.count("*").alias("n_texts"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum(F.size("ids")).cast("long").alias("n_ids"))
        out = n if out is None else out.unionByName(n)
    return out


# --- post-processing ---------------------------------------------------------------

IDS = "(SELECT conv_id, list((turn % 5 + 10)::BIGINT ORDER BY turn) AS a, list((length(text) % 50 + 10)::BIGINT ORDER BY turn) AS b FROM conversations GROUP BY conv_id)"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.sort_array(F.collect_list(F.struct("turn", (F.col("turn") % 5 + 10).cast("long").alias("a"), (F.length("text") % 50 + 10).cast("long").alias("b"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(x.alias("x"))
    return rows.select("conv_id", F.transform("x", lambda r: r["a"]).alias("a"), F.transform("x", lambda r: r["b"]).alias("b"))


def _flat(rows: DataFrame, made: tuple) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("conv_id", text(made[0]).alias("ids"), text(made[1]).alias("types"))


@query(f"SELECT conv_id, array_to_string([0] || a || [2, 2] || b || [2], ' ') AS ids, array_to_string(list_transform(range(len(a) + len(b) + 4), lambda i: 0), ' ') AS types FROM {IDS}")
def postprocess_roberta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir)
    return _flat(rows, encode.wrapped(F.col("a"), F.col("b"), 0, 2, doubled=True))


@query(f"SELECT conv_id, array_to_string([1] || a || [7] || b || [9, 9], ' ') AS ids, array_to_string([0] || list_transform(a, lambda i: 0) || [0] || list_transform(b, lambda i: 1) || [1, 2], ' ') AS types FROM {IDS}")
def postprocess_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir)
    parts = [("special", 1, 0), ("text", "A", 0), ("special", 7, 0), ("text", "B", 1), ("special", 9, 1), ("special", 9, 2)]
    return _flat(rows, encode.template(parts, {"A": F.col("a"), "B": F.col("b")}))


@query(f"SELECT conv_id, array_to_string([1, 101] || a || [102, 8], ' ') AS ids, array_to_string(list_transform(range(len(a) + 4), lambda i: 0), ' ') AS types FROM {IDS}")
def postprocess_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processor after another: the second wraps what the first made."""
    rows = _ids(spark, sf_dir)
    inner, types = encode.wrapped(F.col("a"))
    return _flat(rows, encode.template([("special", 1, 0), ("typed", "A", None), ("special", 8, 0)], {"A": inner, "A types": types}))


@query("""SELECT conv_id, sum(CASE WHEN turn % 3 = 0 THEN strlen(text) WHEN turn % 3 = 1 THEN ((length(text) * 3 % 500) // 16 + 2) * ((length(text) * 7 % 300) // 16 + 1) ELSE ((length(text) * 40 + 159) // 160 + 7) // 8 END)::BIGINT AS n_ids,
sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_texts FROM conversations GROUP BY conv_id""")
def multimodal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts of text, image and audio: their tokens in one sequence, in order."""
    n = F.length("text").cast("long")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("kind"), encode.byte_ids(F.col("text")).alias("text"), (n * 3 % 500 + 1).alias("width"), (n * 7 % 300 + 1).alias("height"), (n * 40).alias("samples"))
    ids = encode.multimodal(t, "conv_id", "turn")
    return ids.select("conv_id", F.size("ids").cast("long").alias("n_ids"), "n_texts")
