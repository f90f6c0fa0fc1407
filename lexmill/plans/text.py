"""Normalizers and pre-tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as N
from lexmill.operators import pretok

from .registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _digest(name: str, expression, sql: str | None):
    """A query that returns (doc_id, sha) of a normalised text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", F.sha2(expression(F.col("text")), 256).alias("sha"))

    run.__name__ = name
    query(f"SELECT doc_id, sha256({sql}) AS sha FROM documents" if sql else None)(run)


_digest("normalize_identity", N.identity, "text")
_digest("normalize_nfc", N.unicode_form("NFC"), "nfc_normalize(text)")
_digest("normalize_nfd_nfc", lambda c: N.unicode_form("NFC")(N.unicode_form("NFD")(c)), "nfc_normalize(text)")
_digest("normalize_nfkc_nfkd", lambda c: N.unicode_form("NFKC")(N.unicode_form("NFKD")(c)), None)
_digest("normalize_replace", lambda c: N.replace_literal(c, "the", "<>"), "replace(text, 'the', '<>')")
_digest("normalize_replace_regex", lambda c: N.replace_regex(c, "[0-9]+", "#"), "regexp_replace(text, '[0-9]+', '#', 'g')")
_digest("normalize_strip", lambda c: N.strip_ascii(F.concat(F.lit("\t \n"), c, F.lit(" \r\n\f"))), "regexp_replace(regexp_replace(text, '^[\\x09-\\x0D\\x20]+', ''), '[\\x09-\\x0D\\x20]+$', '')")
_digest("normalize_lowercase", N.lowercase_simple, "lower(text)")
_digest("normalize_prepend", lambda c: N.prepend(c, "▁"), "'▁' || text")
_digest("normalize_sequence", N.sequence([lambda c: N.replace_literal(c, "\n", " "), lambda c: N.prepend(c, ">"), N.unicode_form("NFC")]), "nfc_normalize('>' || replace(text, chr(10), ' '))")
COLLAPSED = "regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '^ | $', '', 'g')"
_digest("normalize_sentence_piece", lambda c: N.sentence_piece(c), f"replace(CASE WHEN {COLLAPSED} <> '' THEN ' ' || {COLLAPSED} ELSE '' END, ' ', '▁')")
_digest("normalize_charsmap", N.charsmap({"th": "þ", "the": "ð", "in": "ı"}), None)
_digest("normalize_bert", N.bert(), None)
# what is coded is decoded again: the digest must be that of the text
_digest("byte_level_roundtrip", lambda c: N.byte_level_decode(N.byte_level_encode(c)), "text")
_digest("caps_roundtrip", lambda c: N.caps_decode(N.caps_encode(c)), "text")
_digest("spaced_roundtrip", lambda c: N.spaced_decode(N.spaced_encode(c)), "text")


@query("""SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_bytes, coalesce(sum(n), 0)::BIGINT AS origin_bytes, coalesce(sum(n * start), 0)::BIGINT AS origins FROM (
SELECT doc_id, strlen(CASE c WHEN 'ñ' THEN 'nn' WHEN 'a' THEN '' ELSE c END) AS n, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(c) AS start
FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS c FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text <> ''))) GROUP BY doc_id""")
def normalize_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel that lengthens one letter and drops another: each byte knows where it stems from."""
    kernel = lambda t: t.replace("ñ", "nn").replace("a", "")
    rows = _docs(spark, sf_dir).filter("text <> ''").select("doc_id", N.origin_column(kernel)(F.col("text")).alias("o"))
    total = F.aggregate("o.origin", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.octet_length("o.text").cast("long").alias("n_bytes"), F.size("o.origin").cast("long").alias("origin_bytes"), total.alias("origins"))


@query("""SELECT vec_id, 5 * (vec_id % 5) + vec_id % 3 + 2 * (label % 4) + 1 AS n_bytes, (vec_id % 5)::INT AS moves, (vec_id % 3)::INT AS stacks, (label % 4)::INT AS branches,
CASE WHEN vec_id % 5 > 0 THEN 'move' WHEN vec_id % 3 > 0 THEN 'stack' WHEN label % 4 > 0 THEN 'branch' ELSE 'return' END AS first_opcode FROM embeddings""")
def machine_code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of some moves (mov eax, 1), pushes and short branches, and a return, as each row has it."""
    times = lambda code, n: F.expr(f"repeat('{code}', CAST({n} AS INT))")
    code = F.unhex(F.concat(times("b801000000", "vec_id % 5"), times("50", "vec_id % 3"), times("7402", "label % 4"), F.lit("c3")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", N.route_column(code).alias("r"))
    count = lambda kind: F.size(F.filter("r", lambda x: x["opcode"] == kind))
    total = F.aggregate("r", F.lit(0), lambda a, x: a + x["length"])
    return rows.select("vec_id", total.cast("long").alias("n_bytes"), count("move").alias("moves"), count("stack").alias("stacks"), count("branch").alias("branches"), F.col("r")[0]["opcode"].alias("first_opcode"))


def _lossless(scheme: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _docs(spark, sf_dir).select("doc_id", pretok.pieces(F.col("text"), scheme).alias("p"))
        return p.select("doc_id", F.sha2(F.array_join("p", ""), 256).alias("sha"), (F.size("p") > 0).alias("some"))

    run.__name__ = f"pretok_{scheme}_lossless"
    query("SELECT doc_id, sha256(text) AS sha, text <> '' AS some FROM documents")(run)


for _scheme in pretok.LOSSLESS:
    _lossless(_scheme)


def _pieces(name: str, expression, sql: str):
    """(piece, n) over all documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir).select(F.explode(expression(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"SELECT piece, count(*) AS n FROM (SELECT unnest({sql}) AS piece FROM documents) GROUP BY piece")(run)


_pieces("pretok_digits", lambda c: pretok.pieces(c, "digits"), r"regexp_extract_all(text, '\p{N}+|\P{N}+')")
_pieces("pretok_digits_each", lambda c: pretok.pieces(c, "digits_each"), r"regexp_extract_all(text, '\p{N}|\P{N}+')")
_pieces("pretok_punctuation", lambda c: pretok.punctuation_pieces(c), r"regexp_extract_all(text, '\p{P}|\P{P}+')")
_pieces("pretok_punctuation_removed", lambda c: pretok.punctuation_pieces(c, "removed"), r"regexp_extract_all(text, '\P{P}+')")
_pieces("pretok_whitespace", lambda c: pretok.pieces(c, "whitespace"), r"regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\s\p{Z}\p{L}\p{N}\p{M}_]')")
_pieces("pretok_whitespace_split", lambda c: pretok.pieces(c, "whitespace_split"), r"regexp_extract_all(text, '[^\s\p{Z}]+')")
_pieces("pretok_metaspace", lambda c: pretok.pieces(c, "metaspace"), "regexp_extract_all(CASE WHEN starts_with(text, ' ') THEN '' ELSE '▁' END || replace(text, ' ', '▁'), '▁[^▁]*')")
_pieces("pretok_bert", lambda c: pretok.pieces(c, "bert"), r"regexp_extract_all(text, '[\p{P}\p{S}]|[^\s\p{Z}\p{P}\p{S}]+')")
_pieces("pretok_split_removed", pretok.split_pieces(r"[,.]", "removed"), "list_filter(regexp_split_to_array(text, '[,.]'), lambda x: x <> '')")
_pieces("pretok_split_isolated", pretok.split_pieces(r"[,.]", "isolated"), "regexp_extract_all(text, '[,.]|[^,.]+')")
_pieces("pretok_split_contiguous", pretok.split_pieces(r"[,.]", "contiguous"), "regexp_extract_all(text, '[,.]+|[^,.]+')")
_pieces("pretok_split_previous", pretok.split_pieces(r"[,.]", "merged_with_previous"), "regexp_extract_all(text, '[^,.]+[,.]?|[,.]')")
_pieces("pretok_split_next", pretok.split_pieces(r"[,.]", "merged_with_next"), "regexp_extract_all(text, '[,.][^,.]*|[^,.]+')")
_pieces("pretok_chain", lambda c: pretok.chain(c, ["whitespace_split", "digits"]), r"flatten(list_transform(regexp_extract_all(text, '[^\s\p{Z}]+'), lambda w: regexp_extract_all(w, '\p{N}+|\P{N}+')))")
_pieces("added_token_scan", lambda c: pretok.added_token_segments(c, [{"content": "the"}, {"content": "then"}, {"content": "de"}]), "regexp_extract_all(replace(replace(replace(text, 'then', chr(1)), 'the', chr(2)), 'de', chr(3)), '[\\x01-\\x03]|[^\\x01-\\x03]+')")
# the scan above replaces its tokens by marks; turn them back
from .registry import ORACLE_SQL  # noqa: E402

ORACLE_SQL["added_token_scan"] = "SELECT replace(replace(replace(piece, chr(1), 'then'), chr(2), 'the'), chr(3), 'de') AS piece, n FROM (" + ORACLE_SQL["added_token_scan"] + ")"


@query()
def pretok_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(pretok.byte_level_pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, sha256(text) AS sha, text <> '' AS some FROM documents")
def safe_cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _docs(spark, sf_dir).select("doc_id", pretok.safe_cut_rows(F.col("text"), 2000).alias("p"))
    return p.select("doc_id", F.sha2(F.array_join("p", ""), 256).alias("sha"), (F.size("p") > 0).alias("some"))


@query("SELECT doc_id, " + ", ".join(rf"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in pretok.CLASSES.items() if k != "white_space") + " FROM documents")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *(pretok.class_count(F.col("text"), k).cast("long").alias(f"n_{k}") for k in pretok.CLASSES if k != "white_space"))
