"""Encoders, decoders, post-processing, windows and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chat, encode, models, packing, pretok

from .registry import BYTES, HEX_ID, query, table

V = models.LITERAL
HASHES = ", ".join(f"('{t.hex().upper()}', {i})" for i, t in enumerate(V.tokens))
VOCAB = f"(SELECT * FROM (VALUES {HASHES}) AS t(hex, id))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT {HEX_ID} AS id, count(*) AS n FROM {BYTES} GROUP BY h")
def byte_histogram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.byte_counts(_docs(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS n_tokens, sum(({HEX_ID}) * (pos % 97 + 1))::BIGINT AS check_sum FROM {BYTES} GROUP BY doc_id")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode.byte_lists(_docs(spark, sf_dir)).filter(F.size("ids") > 0)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate(F.transform("ids", lambda x, i: x * (i % 97 + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("check_sum"))


@query(f"SELECT doc_id, sum(pos)::BIGINT AS starts, sum(pos + 1)::BIGINT AS ends, sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END + CASE WHEN h[1] IN ('8', '9', 'A', 'B') THEN 0 ELSE 2 END)::BIGINT AS boundaries FROM {BYTES} GROUP BY doc_id")
def byte_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode.overlays(_docs(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.sum("byte_start").alias("starts"), F.sum("byte_end").alias("ends"), F.sum("boundary").alias("boundaries"))


def _roundtrip(name: str, kernel: str, scheme: str):
    """decode(encode(text)) per document; its digest must be that of the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return encode.roundtrip(_docs(spark, sf_dir), V, kernel, scheme).select("doc_id", F.sha2("text", 256).alias("sha"))

    run.__name__ = name
    query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")(run)


for _k in ("bpe", "bpe_whole", "longest", "fewest", "strict", "ungreedy"):
    _roundtrip(f"roundtrip_{_k}", _k, "cl100k")
_roundtrip("roundtrip_o200k", "bpe", "o200k")


@query(f"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s\\p{{Z}}]+')) AS word FROM documents),
v AS {VOCAB},
m AS (SELECT word, hex(encode(word)) AS h, 0 AS p, 0 AS n FROM w
      UNION ALL
      SELECT word, h, p + (SELECT max(length(v.hex)) FROM v WHERE substr(m.h, m.p + 1, length(v.hex)) = v.hex), n + 1 FROM m WHERE p < length(h))
SELECT word, max(n)::BIGINT AS n_tokens FROM m GROUP BY word""")
def longest_match_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(pretok.pieces(F.col("text"), "whitespace_split")).alias("piece")).distinct()
    return encode.encode_pieces(words, V, "longest").select(F.col("piece").alias("word"), F.size("ids").cast("long").alias("n_tokens"))


WP = models.Vocab([b"[UNK]", *(c.encode() for c in "abcdefghijklmnopqrstuvwxyz"), *(b"##" + c.encode() for c in "abcdefghijklmnopqrstuvwxyz"), b"the", b"##ing", b"##tion", b"an", b"##er"])
WP_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t.decode()}', {i})" for i, t in enumerate(WP.tokens) if i) + ") AS t(piece, id))"


@query(f"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{P}}\\p{{S}}]|[^\\s\\p{{Z}}\\p{{P}}\\p{{S}}]+')) AS word FROM documents),
v AS {WP_SQL},
m AS (SELECT word, 0 AS p, 0 AS n FROM w
      UNION ALL
      SELECT word, p + coalesce((SELECT max(length(v.piece) - CASE WHEN starts_with(v.piece, '##') THEN 2 ELSE 0 END) FROM v
                                  WHERE starts_with(v.piece, '##') = (m.p > 0)
                                    AND substr(m.word, m.p + 1, length(v.piece) - CASE WHEN starts_with(v.piece, '##') THEN 2 ELSE 0 END)
                                        = CASE WHEN starts_with(v.piece, '##') THEN substr(v.piece, 3) ELSE v.piece END), 100000), n + 1
      FROM m WHERE p < length(word))
SELECT word, CASE WHEN max(p) >= 100000 OR strlen(word) > 100 THEN 1 ELSE max(n) END::BIGINT AS n_tokens, (max(p) >= 100000 OR strlen(word) > 100) AS unknown FROM m GROUP BY word""")
def wordpiece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(pretok.pieces(F.lower("text"), "bert")).alias("piece")).distinct()
    return encode.encode_pieces(words, WP, "wordpiece").select(F.col("piece").alias("word"), F.size("ids").cast("long").alias("n_tokens"), (F.col("ids")[0] == 0).alias("unknown"))


UNI = models.Vocab(V.tokens, scores=[-8.0] * 256 + [-2.0 - 0.1 * i for i in range(20)])


@query()
def unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_counts(_docs(spark, sf_dir), UNI, "unigram")


@query()
def char_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_counts(_docs(spark, sf_dir), V, "char_bpe")


@query()
def explain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.explain(encode.encode(_docs(spark, sf_dir), V), encode.vocab_table(spark, V))


@query("SELECT doc_id, sha256(text) AS sha, true AS shorter FROM documents WHERE text <> ''")
def transcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of one vocabulary to bytes to ids of another: bytes and merged tokens."""
    bytes_only = models.Vocab(V.tokens[:256])
    a = encode.encode_lists(_docs(spark, sf_dir), bytes_only)
    made = encode.transcoded(a, bytes_only, V)
    return made.select("doc_id", F.sha2("text", 256).alias("sha"), (F.size("ids") <= F.col("n_before")).alias("shorter"))


@query()
def model_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, models.fingerprint(k, V, lambda t, f=models.KERNELS[k]: f(t.encode(), V))) for k in ("bpe", "longest", "fewest")]
    return spark.createDataFrame(rows, "kind string, sha string")


@query("""SELECT conv_id, len(a) + len(b) + 3 AS n_ids, len(b) + 1 AS n_second, (101 + 102 + 102 + list_sum(a) + list_sum(b))::BIGINT AS total
FROM (SELECT conv_id, list(turn ORDER BY turn) AS a, list(length(text) ORDER BY turn) AS b FROM conversations GROUP BY conv_id)""")
def postprocess_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("x"))
    ids, types = encode.wrapped(F.transform("x", lambda x: x["turn"]), F.transform("x", lambda x: x["n"]), 101, 102)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", F.size(ids).cast("long").alias("n_ids"), add(types).alias("n_second"), add(ids).alias("total"))


@query("""WITH v AS """ + VOCAB + """, p AS (SELECT DISTINCT hex(encode(unnest(regexp_extract_all(lower(text), '[a-z]+')))) AS h FROM documents)
SELECT h AS hex, max(CASE WHEN EXISTS (SELECT 1 FROM v WHERE length(v.hex) > 2 * k AND starts_with(v.hex, right(h, 2 * k))) THEN k ELSE 0 END)::BIGINT AS dropped
FROM (SELECT h, unnest(range(1, least(3, length(h) // 2) + 1)) AS k FROM p) GROUP BY h""")
def token_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to drop from the end of each word: the longest tail of up to 3 byte tokens that begins a longer token."""
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).select(F.hex(F.encode("w", "UTF-8")).alias("hex")).distinct()
    tails = words.select("hex", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("hex") / 2).cast("int"))).alias("k")).withColumn("tail", F.expr("right(hex, 2 * k)"))
    vocab = encode.vocab_table(spark, V)
    # the starts of all tokens that are up to 3 bytes long turn the prefix join into an equi-join
    starts = vocab.filter("length > 1").select(F.explode(F.expr("transform(sequence(1, least(3, length - 1)), n -> left(hex, 2 * n))")).alias("tail")).distinct()
    hit = tails.join(F.broadcast(starts.withColumn("hit", F.lit(True))), "tail", "left")
    return hit.groupBy("hex").agg(F.max(F.when(F.col("hit"), F.col("k")).otherwise(0)).cast("long").alias("dropped"))


@query("SELECT hex AS hex, id FROM " + VOCAB + " WHERE regexp_matches(hex, '^(20)?(6[1-9A-F]|7[0-9A])+$') AND id >= 256")
def constrained_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer tokens that a grammar of an optional space and small letters allows next."""
    return encode.vocab_table(spark, V).filter("id >= 256").filter(F.col("hex").rlike("^(20)?(6[1-9A-F]|7[0-9A])+$")).select("hex", "id")


@query("""SELECT p_partkey, ((w - 1) // 16 + 1)::BIGINT AS n_cols, ((h - 1) // 16 + 1)::BIGINT AS n_rows, (((w - 1) // 16 + 2) * ((h - 1) // 16 + 1))::BIGINT AS n_tokens
FROM (SELECT p_partkey, CASE WHEN r > 1 THEN greatest(1, floor(w0 / r))::BIGINT ELSE w0 END AS w, CASE WHEN r > 1 THEN greatest(1, floor(h0 / r))::BIGINT ELSE h0 END AS h
      FROM (SELECT *, greatest(w0 / 1024.0::DOUBLE, h0 / 1024.0::DOUBLE) AS r FROM (SELECT p_partkey, p_partkey * 37 % 3000 + 1 AS w0, p_partkey * 91 % 2000 + 1 AS h0 FROM part)))""")
def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 3000 + 1).alias("w"), (F.col("p_partkey") * 91 % 2000 + 1).alias("h"))
    made = encode.image_tokens(F.col("w"), F.col("h"))
    return p.select("p_partkey", *(c.alias(k) for k, c in made.items()))


@query("SELECT doc_id, ((n_chars + 159) // 160 + 7) // 8 AS n_tokens FROM documents")
def audio_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", encode.audio_tokens(F.col("n_chars")).alias("n_tokens"))


# --- windows and packing -----------------------------------------------------


def _windows(name: str, window: int, stride: int, stop: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _docs(spark, sf_dir).select("doc_id", F.explode((packing.token_windows(F.octet_length("text"), window, window - stride)) if stop else packing.late_windows(F.octet_length("text"), window, stride)).alias("w"))
        return rows.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"))

    run.__name__ = name
    query(f'SELECT doc_id, s AS start, least(s + {window}, n) AS "end" FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, strlen(text), {stride})) AS s FROM documents) WHERE s = 0 OR s - {stride} + {window} < n')(run)


_windows("chunk_windows", 512, 448, True)
_windows("late_chunks_gap", 256, 320, False)


@query("""WITH d AS (SELECT doc_id, strlen(text) + 2 AS n, sum(strlen(text) + 2) OVER (ORDER BY doc_id) - strlen(text) - 2 AS before FROM documents),
t AS (SELECT sum(n) AS total FROM d)
SELECT s AS seq, 1024 AS n_ids, (SELECT count(*) FROM d WHERE before >= s * 1024 AND before < (s + 1) * 1024) AS n_bos FROM (SELECT unnest(range(0, (total // 1024)::BIGINT)) AS s FROM t)""")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = encode.byte_lists(_docs(spark, sf_dir))
    made = packing.pack(docs, "ids", 1024, bos=1000, eos=1001)
    return made.select("seq", F.size("ids").alias("n_ids"), F.size(F.filter("ids", lambda x: x == 1000)).cast("long").alias("n_bos"))


@query("""WITH w AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS l FROM documents)),
s AS (SELECT *, regexp_matches(word, '[.]$') AS hard FROM w),
g AS (SELECT *, coalesce(sum(hard::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 + hard::INT AS segment FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY pos) - 1 AS k FROM g),
r AS (SELECT doc_id, segment, 0 AS grp, pos, 'preserved' AS kind FROM k WHERE hard
      UNION ALL SELECT doc_id, segment, k // 4, pos, CASE WHEN k % 4 < 3 THEN 'full' ELSE 'uncovered' END FROM k WHERE NOT hard),
a AS (SELECT doc_id, segment, grp, kind, min(pos) AS start, count(*) AS n, max(pos) AS last FROM r GROUP BY ALL)
SELECT doc_id, segment::BIGINT AS segment, grp::BIGINT AS "group", CASE WHEN kind = 'full' AND n < 3 THEN 'partial' ELSE kind END AS kind, start, n, round(1.0::DOUBLE / n, 6) AS weight, (start + last) / 2.0::DOUBLE AS center FROM a""")
def fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("pos", "word"))
    return packing.fixed_groups(words.select("doc_id", "pos", F.col("word").endswith(".").alias("hard")), 3, 4)


@query("""WITH t AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\\s+|[^\\s]+') AS l FROM documents)),
o AS (SELECT doc_id, pos, (sum(strlen(w)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e, strlen(w) AS n FROM t),
s AS (SELECT doc_id, unnest(range(0, strlen(text), 500)) AS a FROM documents)
SELECT s.doc_id, s.a AS span_id, min(pos) AS first, max(pos) AS last FROM s JOIN o ON s.doc_id = o.doc_id AND e - n < a + 40 AND e > a GROUP BY ALL""")
def span_token_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\s+|[^\s]+"), F.lit(0))).alias("pos", "w"))
    end = F.sum(F.octet_length("w")).over(W.partitionBy("doc_id").orderBy("pos"))
    t = t.select("doc_id", "pos", (end - F.octet_length("w")).alias("start"), end.alias("end"))
    s = _docs(spark, sf_dir).filter("text <> ''").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long") - 1, F.lit(500).cast("long"))).alias("span_id"))
    s = s.select("doc_id", "span_id", F.col("span_id").alias("byte_start"), (F.col("span_id") + 40).alias("byte_end"))
    return packing.token_range(s, t)


@query("SELECT doc_id, length(text) AS n_chars, true AS covered, true AS within FROM documents")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 characters that end at sentences cover each text and hold the limit."""
    c = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), packing.snapped_windows(400, 0, "sentence")(F.col("text")).alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return c.select("doc_id", "n_chars", (total == F.col("n_chars")).alias("covered"), F.forall("w", lambda x: x["end"] - x["start"] <= 400).alias("within"))


@query('SELECT doc_id, s::INT AS start, least(s + 400, length(text))::INT AS "end" FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents)')
def codepoint_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(packing.snapped_windows(400, 0, "codepoint")(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


#: A small dictionary; real ones are the caller's.
WORDS = ("the", "tion", "er", "an", "ation", "in", "de", "la", "est", "ing")


@query(f"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s\\p{{Z}}]+')) AS word FROM documents),
v AS (SELECT unnest([{", ".join(f"'{x}'" for x in WORDS)}]) AS t),
m AS (SELECT word, 0 AS p, 0 AS n FROM w
      UNION ALL SELECT word, p + coalesce((SELECT max(length(t)) FROM v WHERE substr(m.word, m.p + 1, length(t)) = t), 1), n + 1 FROM m WHERE p < length(word))
SELECT word, max(n)::BIGINT AS n_words FROM m GROUP BY word""")
def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without spaces, segmented by the longest words of a dictionary."""
    known = set(WORDS)

    @F.udf("long", useArrow=True)
    def count(word: str) -> int:
        return len(packing.dictionary_words(word, known))

    words = _docs(spark, sf_dir).select(F.explode(pretok.pieces(F.col("text"), "whitespace_split")).alias("word")).distinct()
    return words.select("word", count("word").alias("n_words"))


@query()
def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", encode.byte_ids(F.col("text")).alias("ids"))
    return packing.sampled_windows(docs, "ids", 128, 2, 7).select("doc_id", "k", "start", F.sha2(F.concat_ws(",", "ids"), 256).alias("sha"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chatml(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations")
def chat_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.invert_chatml(chat.render_chatml(table(spark, sf_dir, "conversations"))).withColumn("turn", F.col("turn").cast("long"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_template(table(spark, sf_dir, "conversations"), chat.CHATML, add_generation_prompt=True)
