"""Corpus and vocabulary readers.

Corpora are read by Spark. Vocabulary files are small by nature (a token per
line); they are read as Spark files too, so any file system works, and parsed
where they arrive.
"""

from __future__ import annotations

import ast
import base64
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.models import Vocab


def line_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): lines without carriage returns at their ends, empty ones left out."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "^\r+|\r+$", "")).filter("line <> ''")


def diff_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): all lines, the empty last one too."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def json_field(rows: DataFrame, col: str, field: str, kind: str) -> DataFrame:
    return rows.withColumn(field, F.from_json(col, f"`{field}` {kind}")[field])


def documents(spark: SparkSession, path: str, kind: str, field: str = "text") -> DataFrame:
    """A corpus as (text): lines, whole files, JSON lines or Parquet; compressed files by their extension."""
    if kind == "lines":
        return spark.read.text(path).select(F.col("value").alias("text"))
    if kind == "whole":
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return (spark.read.json(path) if kind == "json" else spark.read.parquet(path)).select(F.col(field).alias("text"))


def avoid_list(texts: DataFrame) -> DataFrame:
    """(line_no, pattern): a literal pattern per line; # starts a comment line, empty lines don't count."""
    rows = texts.select(F.posexplode(F.split("text", "\n", -1)).alias("line_no", "pattern"))
    return rows.withColumn("pattern", F.regexp_replace("pattern", "\r+$", "")).filter("pattern <> '' AND NOT startswith(pattern, '#')")


#: Fields of the exchange of captions with spans.
SPANS = """schema string, image_id string, original_token_count int, captions array<struct<
  caption_id: int, section: string, text: string, spans: array<struct<
    span_id: string, token_start: int, token_end: int, byte_start: int, byte_end: int, text: string, role: string, entity_id: string, embedding: array<double>,
    confidence: double, kind: string, relation_from_entity_id: string, relation_to_entity_id: string>>>>"""


def semantic_spans(values: DataFrame) -> DataFrame:
    """(image_id, caption_id, section, span columns) of JSON documents of captions with spans."""
    captions = values.select(F.from_json("value", SPANS).alias("v")).select("v.image_id", F.explode("v.captions").alias("c"))
    return captions.select("image_id", "c.caption_id", "c.section", F.explode("c.spans").alias("s")).select("image_id", "caption_id", "section", "s.*")


def mapping_examples(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON examples {example_id, spans, relations}."""
    node = "span_id: string, token_start: int, token_end: int, role: string, label: string, protected: boolean, embedding: array<double>"
    schema = f"example_id string, spans array<struct<{node}>>, relations array<struct<source: string, relation: string, target: string>>"
    v = values.select(F.from_json("value", schema).alias("v"))
    nodes = v.select("v.example_id", F.explode("v.spans").alias("s")).select("example_id", "s.*")
    return nodes, v.select("v.example_id", F.explode("v.relations").alias("r")).select("example_id", "r.*")


# --- vocabularies ---------------------------------------------------------------


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """(rank, hex) of a file of base64 tokens and ranks; ranks that aren't 0, 1, 2, … once each are an error."""
    rows = spark.read.text(path).filter("value <> ''").select(F.split("value", " ").alias("x"))
    rows = rows.select(F.try_to_binary(F.col("x")[0], F.lit("base64")).alias("b"), F.expr("try_cast(x[1] AS BIGINT)").alias("rank"))
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("z"), F.count("b").alias("b")).first()
    if n.n and (n.d, n.a, n.z, n.b) != (n.n, 0, n.n - 1, n.n):
        raise ValueError(f"ranks aren't dense or a line is bad: {n}")
    return rows.select("rank", F.hex("b").alias("hex"))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def parse_ranks(data: bytes) -> Vocab:
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    ranks = {base64.b64decode(a, validate=True): int(b) for a, b in pairs}
    if sorted(ranks.values()) != list(range(len(pairs))):
        raise ValueError("ranks aren't dense")
    tokens: list[bytes | None] = [None] * len(pairs)
    for t, r in ranks.items():
        tokens[r] = t
    return Vocab(tokens, ranks)


def parse_tokenizer_json(data: bytes) -> dict:
    """kind, vocab (Vocab), merges, and the names of normalizer, pre-tokenizer, decoder and post-processor of a tokenizer.json."""
    from lexmill.functions.text import _byte_of

    d = json.loads(data)
    model = d["model"]
    kind = model.get("type") or ("BPE" if "merges" in model else "Unigram" if isinstance(model["vocab"], list) else "WordPiece")
    byte_level = any("ByteLevel" in json.dumps(d.get(k) or {}) for k in ("pre_tokenizer", "decoder"))
    table = _byte_of()

    def raw(t: str) -> bytes:
        return bytes(table[c] for c in t) if byte_level and all(c in table for c in t) else t.encode("utf-8", "surrogatepass")

    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if kind == "Unigram":
        v = Vocab([raw(t) for t, _ in model["vocab"]], scores=[s for _, s in model["vocab"]], unk=model.get("unk_id") or 0, byte_fallback=bool(model.get("byte_fallback")))
    else:
        size = max(model["vocab"].values(), default=-1) + 1
        tokens: list[bytes | None] = [None] * size
        for t, i in model["vocab"].items():
            tokens[i] = raw(t)
        ranks = {raw(a + b): r for r, (a, b) in reversed(list(enumerate(merges)))} if merges else None
        v = Vocab(tokens, ranks, unk=model["vocab"].get(model.get("unk_token") or "", 0), byte_fallback=bool(model.get("byte_fallback")), prefix=(model.get("continuing_subword_prefix") or "##").encode(), max_word=model.get("max_input_chars_per_word") or 100)
    return {"kind": kind, "vocab": v, "merges": merges, "added": d.get("added_tokens", []), **{k: (d.get(k) or {}).get("type") for k in ("normalizer", "pre_tokenizer", "decoder", "post_processor")}}


def wire_fields(data: bytes):
    """(field, wire type, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, 0, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, kind, data[i : i + n]
            i += n
        elif kind == 2:
            n = varint()
            yield tag >> 3, 2, data[i : i + n]
            i += n
        else:
            raise ValueError(f"wire type {kind}")


def parse_piece_model(data: bytes) -> dict:
    """A SentencePiece model: kind (unigram, bpe, …), Vocab, piece types and whether bytes are a fallback."""
    tokens, scores, types, kind = [], [], [], 1
    for f, _, x in wire_fields(data):
        if f == 1:
            piece, score, t = b"", 0.0, 1
            for g, _, y in wire_fields(x):
                piece, score, t = (y, score, t) if g == 1 else (piece, struct.unpack("<f", y)[0], t) if g == 2 else (piece, score, y) if g == 3 else (piece, score, t)
            tokens.append(piece)
            scores.append(score)
            types.append(t)
        elif f == 2:
            kind = next((y for g, _, y in wire_fields(x) if g == 3), 1)
    unk = types.index(2) if 2 in types else 0
    order = sorted((i for i, t in enumerate(types) if t == 1), key=lambda i: (-scores[i], i))
    ranks = {tokens[i]: r for r, i in enumerate(order)}
    return {"kind": {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind, "unigram"), "vocab": Vocab(tokens, ranks, scores, unk, 6 in types), "types": types}


def parse_world_vocab(data: bytes) -> Vocab:
    """Lines of id, Python literal and byte length; the length is checked, ids may have gaps."""
    found: dict[int, bytes] = {}
    for line in data.decode("utf-8").splitlines():
        if line.strip():
            a, z = line.index(" "), line.rindex(" ")
            lit = ast.literal_eval(line[a + 1 : z])
            raw = lit.encode("utf-8") if isinstance(lit, str) else lit
            if len(raw) != int(line[z + 1 :]):
                raise ValueError(f"length of token {line[:a]}")
            found[int(line[:a])] = raw
    tokens: list[bytes | None] = [None] * (max(found, default=-1) + 1)
    for i, raw in found.items():
        tokens[i] = raw
    return Vocab(tokens)


def parse_tekken(data: bytes) -> dict:
    """Special tokens first, then ranked byte tokens, as many as the configuration says."""
    d = json.loads(data)
    conf = d["config"]
    special = conf.get("default_num_special_tokens", 0)
    size = conf.get("default_vocab_size", len(d["vocab"]) + special) - special
    tokens = [base64.b64decode(x["token_bytes"]) for x in sorted(d["vocab"], key=lambda x: x["rank"])[:size]]
    return {"pattern": conf.get("pattern"), "special": special, "vocab": Vocab([None] * special + tokens, {t: r for r, t in enumerate(tokens)})}


def parse_tokenizer_config(data: bytes) -> dict:
    """Special tokens and the chat template of a tokenizer_config.json."""
    d = json.loads(data)
    text = lambda x: x.get("content") if isinstance(x, dict) else x
    return {"chat_template": d.get("chat_template"), "model_max_length": d.get("model_max_length"), "special": {k: text(v) for k, v in d.items() if k.endswith("_token")}, "added": {int(k): v["content"] for k, v in d.get("added_tokens_decoder", {}).items()}}


def harmony(ranks: Vocab, special: dict[str, int]) -> Vocab:
    """A ranked vocabulary with special tokens at their own ids beyond it."""
    tokens = [*ranks.tokens, *[None] * (max(special.values(), default=-1) + 1 - len(ranks.tokens))]
    return Vocab(tokens, ranks.ranks)


#: How a binary vocabulary begins; a byte with its version, 1 to 3, follows.
MAGIC = b"ZTM"
#: The header's capcode byte.
CAPCODES = ("none", "forward_delete", "full", "full_printable")
#: Bits of the header's normalizer byte.
NORMALIZERS = {1: "nfd", 2: "lowercase", 4: "accents", 8: "quotemarks", 16: "collapse", 32: "trim", 64: "leading_space", 128: "unix_lines"}


class _Bytes:
    """Little-endian numbers and runs of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.take(size), "little")


def parse_binary(data: bytes) -> dict:
    """A binary vocabulary: vocab, version, capcode, normalizer (names), aliases [(id, bytes)] from version 2, twins [(id, key, [(id, bytes consumed)])] from version 3."""
    f = _Bytes(data)
    if f.take(3) != MAGIC:
        raise ValueError("not a binary vocabulary")
    version, again, capcode, _, norm = (f.number(1) for _ in range(5))
    if version != again or not 1 <= version <= 3 or capcode >= len(CAPCODES):
        raise ValueError("version or capcode of a binary vocabulary")
    count, unk, total = (f.number() for _ in range(3))
    raw = f.take(total)
    ends = struct.unpack(f"<{count + 1}I", f.take(4 * (count + 1)))
    if ends[0] or (count and ends[-1] != total) or any(a > b for a, b in zip(ends, ends[1:], strict=False)) or (count and unk >= count):
        raise ValueError("offsets of a binary vocabulary")
    f.take(count)  # words of each token, which the bytes tell as well

    def known(i: int) -> int:
        if i >= count:
            raise ValueError(f"id {i} of a binary vocabulary")
        return i

    aliases = [(known(f.number()), f.take(f.number())) for _ in range(f.number())] if version >= 2 else []
    twins = [(known(f.number()), f.take(f.number()), [(known(f.number()), f.number()) for _ in range(f.number(1))]) for _ in range(f.number())] if version == 3 else []
    if any(not x for _, x in aliases) or any(not k or len(a) > 2 for _, k, a in twins):
        raise ValueError("an alias without bytes, or too many alternatives")
    v = Vocab([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], unk=unk)
    for i, x in aliases:
        v.by_bytes.setdefault(x, i)
        v.longest = max(v.longest, len(x))
    return {"vocab": v, "version": version, "capcode": CAPCODES[capcode], "normalizer": [n for bit, n in NORMALIZERS.items() if norm & bit], "aliases": aliases, "twins": twins}


def detect(head: bytes, name: str = "") -> str:
    """Format of a vocabulary file from its first 32 KiB; the extension decides what the bytes leave open."""
    head = head[: 32 << 10]
    if head.startswith(MAGIC):
        return "binary"
    text = head.lstrip()
    if text.startswith(b"{"):
        if b'"token_bytes"' in head or b'"default_num_special_tokens"' in head:
            return "tekken"
        return "tokenizer_json" if b'"model"' in head or b'"version"' in head or name.endswith("tokenizer.json") else "unknown"
    first = text.split(b"\n", 1)[0].split()
    if len(first) == 2 and first[1].isdigit():
        try:
            base64.b64decode(first[0], validate=True)
            return "ranks"
        except ValueError:
            pass
    if len(first) >= 3 and first[0].isdigit() and first[-1].isdigit() and first[1][:1] in b"'\"b":
        return "world"
    if head[:1] == b"\n" or name.endswith(".model"):
        return "piece_model"
    return "ranks" if name.endswith(".tiktoken") else "unknown"


def load(data: bytes, name: str = "") -> Vocab:
    kind = detect(data, name)
    if kind == "unknown":
        raise ValueError("unknown vocabulary format")
    got = {"binary": parse_binary, "tekken": parse_tekken, "tokenizer_json": parse_tokenizer_json, "ranks": parse_ranks, "world": parse_world_vocab, "piece_model": parse_piece_model}[kind](data)
    return got if isinstance(got, Vocab) else got["vocab"]
