"""Vocabulary algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import models, encode, pretok
from lexmill.operators import vocabulary as VO

from .registry import HEX_ID, query, table
from .tokens import VOCAB, V

OTHER = ["e", "th", "ing", "tion", "ción", " que", "the", "zz"]
OTHER_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.encode().hex().upper()}')" for i, t in enumerate(OTHER)) + ") AS t(b_id, hex))"


def _other(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t.encode().hex().upper(), len(t.encode())) for i, t in enumerate(OTHER)], "id long, hex string, length int")


@query(f"""WITH a AS {VOCAB}, b AS {OTHER_SQL}
SELECT id::BIGINT AS id, hex FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY b_id), hex FROM b WHERE hex NOT IN (SELECT hex FROM a)""")
def vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.merged(encode.vocab_table(spark, V), _other(spark))[0]


@query(f"""WITH a AS {VOCAB}, b AS {OTHER_SQL},
n AS (SELECT b_id, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY b_id) AS merged_id FROM b WHERE hex NOT IN (SELECT hex FROM a))
SELECT b.b_id::BIGINT AS b_id, coalesce(a.id, n.merged_id)::BIGINT AS merged_id FROM b LEFT JOIN a ON a.hex = b.hex LEFT JOIN n ON n.b_id = b.b_id""")
def vocab_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.merged(encode.vocab_table(spark, V), _other(spark))[1].select("b_id", "merged_id")


_ROUND = "a{1} AS (SELECT id FROM a{0} UNION SELECT s.id FROM s JOIN a{0} x ON x.id = s.l JOIN a{0} y ON y.id = s.r)"


@query(f"""WITH v AS {VOCAB},
u AS (SELECT v.id, hex, length(hex) // 2 AS len FROM v LEFT JOIN (SELECT id, (id * 7919 + (SELECT count(*) FROM documents)) % 11 AS n FROM v) w ON v.id = w.id WHERE w.n >= 3 OR length(hex) = 2),
s AS (SELECT x.id, a.id AS l, b.id AS r FROM (SELECT id, hex, unnest(range(1, len)) AS k FROM u WHERE len > 1) x JOIN u a ON a.hex = left(x.hex, 2 * k::INT) JOIN u b ON b.hex = substr(x.hex, 2 * k::INT + 1) WHERE a.id < x.id AND b.id < x.id),
a0 AS (SELECT id FROM u WHERE len = 1), {", ".join(_ROUND.format(i, i + 1) for i in range(5))}
SELECT id::BIGINT AS id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS new_id FROM a5""")
def vocab_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    v = encode.vocab_table(spark, V)
    return VO.pruned(v, v.select("id", ((F.col("id") * 7919 + n) % 11).alias("n")), 3)


@query(f"""WITH v AS (SELECT id, hex FROM {VOCAB} WHERE id <> 200 UNION ALL SELECT 300, '7468' UNION ALL SELECT 301, '' UNION ALL SELECT 302, '2020' UNION ALL SELECT 303, '7A7A7A')
SELECT 'error' AS severity, 'byte_coverage' AS "check", 200::BIGINT AS id
UNION ALL SELECT 'error', 'duplicate', 300 UNION ALL SELECT 'error', 'empty_token', 301 UNION ALL SELECT 'info', 'whitespace_run', 302
UNION ALL SELECT 'warning', 'special_shadowing', id FROM v WHERE hex = '746865'
UNION ALL SELECT 'warning', 'unreachable_merge', id FROM v s WHERE length(hex) > 2 AND NOT EXISTS (SELECT 1 FROM v a, v b WHERE a.id < s.id AND b.id < s.id AND length(a.hex) > 0 AND length(b.hex) > 0 AND a.hex || b.hex = s.hex)""")
def vocab_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = encode.vocab_table(spark, V).filter("id <> 200").unionByName(spark.createDataFrame([(300, "7468", 2), (301, "", 0), (302, "2020", 2), (303, "7A7A7A", 3)], "id long, hex string, length int"))
    return VO.doctor(v, ["the"])


#: A unigram vocabulary with faults: scores, a byte token by name, bytes missing.
FAULTY = [("a", -1.0), ("b", float("inf")), ("<0x41>", -2.0), ("<0xfE>", -2.0), ("cd", 5000.0), ("##a", -3.0), ("##xy", -3.0), ("\x7f z", -3.0), ("longer", -4.0)]


def _faulty(spark: SparkSession) -> DataFrame:
    rows = [(i, t.encode().hex().upper(), len(t.encode()), s) for i, (t, s) in enumerate(FAULTY)]
    return spark.createDataFrame(rows, "id long, hex string, length int, score double")


@query("""SELECT * FROM (VALUES ('error', 'score_sanity', 1), ('warning', 'score_sanity', 4), ('info', 'unk_coverage', 252), ('info', 'continuation_consistency', 6), ('warning', 'branch_coverage', 4), ('warning', 'branch_coverage', 5), ('info', 'lilbuf_prefix_count', 1)) AS t(severity, "check", id)""".replace("('warning', 'branch_coverage', 4), ('warning', 'branch_coverage', 5)", "('warning', 'branch_coverage', 5)"))
def vocab_doctor_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _faulty(spark)
    t = v.drop("score")
    return VO.doctor_scores(v).unionByName(VO.doctor_continuations(t)).unionByName(VO.doctor_branches(t))


@query("SELECT severity, \"check\", id FROM (SELECT 'error' AS severity, 'roundtrip' AS \"check\", doc_id AS id FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]'))")
def vocab_doctor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a vocabulary of ASCII bytes can't give back."""
    ascii_only = models.Vocab([bytes([b]) for b in range(128)])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    back = encode.roundtrip(docs, ascii_only, "bpe", "identity", id_col="id")
    return VO.doctor_roundtrip(docs, back, "roundtrip")


@query(f"""WITH w AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS k FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{5,}}')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 20),
h AS (SELECT 255 + k AS id, word, strlen(word) AS len, unnest(regexp_extract_all(hex(encode(word)), '..')) AS h FROM w)
SELECT id::BIGINT AS id, word, ({HEX_ID})::BIGINT AS source, round(sum(1.0::DOUBLE / len), 9) AS weight FROM h GROUP BY ALL""")
def vocab_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of bytes with the 20 most frequent longer words appended: each starts as the mean of its bytes."""
    base = models.Vocab(V.tokens[:256])
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(20).select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"), F.hex(F.encode("word", "UTF-8")).alias("hex"))
    coded = encode.encode_pieces(top.select(F.col("word").alias("piece")), base, "bpe").select(F.hex(F.encode("piece", "UTF-8")).alias("piece_hex"), "ids")
    plan = VO.extended(encode.vocab_table(spark, base), top.select("hex", "rank"), coded)
    return plan.select("id", F.decode(F.unhex("hex"), "UTF-8").alias("word"), "source", "weight")


@query(f"""WITH a AS (SELECT id, hex FROM {VOCAB} WHERE length(hex) >= 4), b AS {OTHER_SQL},
ga AS (SELECT DISTINCT id, substr(hex, i::INT, 4) AS g FROM (SELECT id, hex, unnest(range(1, length(hex) - 2, 2)) AS i FROM a)),
gb AS (SELECT DISTINCT hex, substr(hex, i::INT, 4) AS g FROM (SELECT hex, unnest(range(1, length(hex) - 2, 2)) AS i FROM b WHERE length(hex) >= 4)),
p AS (SELECT gb.hex, ga.id, count(*) AS shared FROM ga JOIN gb ON ga.g = gb.g GROUP BY ALL)
SELECT hex, id::BIGINT AS id, shared FROM (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY shared DESC, id) AS r FROM p) WHERE r <= 3""")
def vocab_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.similar_tokens(encode.vocab_table(spark, V), _other(spark).select("hex"))


@query(f"""WITH a AS {VOCAB}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents)
SELECT word, a.id IS NOT NULL AS known FROM w LEFT JOIN a ON a.hex = hex(encode(word))""")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash join of words with the vocabulary on their bytes."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    v = encode.vocab_table(spark, V).select("hex", F.lit(True).alias("hit"))
    return words.join(F.broadcast(v), F.hex(F.encode("word", "UTF-8")) == F.col("hex"), "left").select("word", F.coalesce("hit", F.lit(False)).alias("known"))


@query()
def bpe_ignore_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_counts(table(spark, sf_dir, "documents"), V, "bpe_whole")


@query()
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_counts(table(spark, sf_dir, "documents"), V, "bpe")


@query("SELECT true AS fewest_is_least, count(*) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\s\\p{Z}]+')) FROM documents)")
def fewest_tokens_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(pretok.pieces(F.col("text"), "whitespace_split")).alias("piece")).distinct()
    n = lambda k: encode.encode_pieces(words, V, k).select("piece", F.size("ids").alias(k))
    j = n("fewest").join(n("bpe"), "piece").join(n("longest"), "piece")
    return j.agg(F.min((F.col("fewest") <= F.col("bpe")) & (F.col("fewest") <= F.col("longest"))).alias("fewest_is_least"), F.count("*").alias("n"))
