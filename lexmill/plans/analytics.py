"""Corpus analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import analytics as A
from lexmill.operators import encode, pretok

from .registry import BYTES, HEX_ID, query, table
from .tokens import VOCAB, V

LINES_SQL = "length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END"
WORDS_SQL = r"len(regexp_extract_all(text, '[^\x09-\x0D\x20]+'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars, sum({LINES_SQL})::BIGINT AS lines, sum({WORDS_SQL})::BIGINT AS words FROM documents")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan(_docs(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.byte_counts(_docs(spark, sf_dir))


H = f"(SELECT {HEX_ID} AS id, count(*) AS n FROM {BYTES} GROUP BY h)"


@query(f"SELECT count(*) AS n_used FROM {H}")
def unique_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).agg(F.count("*").alias("n_used"))


@query(f"SELECT id, n FROM {H} ORDER BY n DESC, id LIMIT 20")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(_counts(spark, sf_dir), 20)


@query(f"SELECT id, n FROM {H} ORDER BY n, id LIMIT 20")
def bottom_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top(_counts(spark, sf_dir), 20, ascending=True)


@query(f"""SELECT tokens, round(bytes / tokens, 9) AS bytes_per_token, round(chars / tokens, 9) AS chars_per_token, round(tokens / words, 9) AS tokens_per_word, round(tokens / lines, 9) AS tokens_per_line,
  round(fallback / tokens, 9) AS fallback_rate, (tokens * 2 * 8 * 32 * 128 * 2)::BIGINT AS kv_bytes, round(tokens / 1000000.0::DOUBLE * 0.5::DOUBLE, 9) AS cost
FROM (SELECT sum(strlen(text))::DOUBLE AS tokens, sum(strlen(text))::DOUBLE AS bytes, sum(length(text))::DOUBLE AS chars, sum({LINES_SQL})::DOUBLE AS lines, sum({WORDS_SQL})::DOUBLE AS words FROM documents),
     (SELECT sum(n)::DOUBLE AS fallback FROM {H} WHERE id < 128)""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.sum(F.length(F.regexp_replace("text", r"[^\x00-\x7F]+", ""))).alias("low")
    s = A.scan(_docs(spark, sf_dir), low).withColumn("tokens", F.col("bytes").cast("double"))
    t = F.col("tokens")
    r = lambda a, b: F.round(A.ratio(a, b), 9)
    return s.select("tokens", r(F.col("bytes"), t).alias("bytes_per_token"), r(F.col("chars"), t).alias("chars_per_token"), r(t, F.col("words")).alias("tokens_per_word"), r(t, F.col("lines")).alias("tokens_per_line"), r(F.col("low"), t).alias("fallback_rate"), A.kv_bytes(F.col("bytes"), 8, 32, 128, 2).alias("kv_bytes"), F.round(A.cost(t, 0.5), 9).alias("cost"))


SCRIPT_SQL = """CASE WHEN u <= 127 THEN 'Latin (ASCII)' WHEN u <= 255 THEN 'Latin (extended)' WHEN u <= 1023 THEN 'Latin/Greek/Coptic/Cyrillic' WHEN u <= 1279 THEN 'Cyrillic' WHEN u <= 1535 THEN 'Armenian/Hebrew'
WHEN u <= 1791 THEN 'Arabic' WHEN u <= 2303 THEN 'Other' WHEN u <= 2559 THEN 'Devanagari/Bengali' WHEN u <= 4095 THEN 'Indic' WHEN u <= 8191 THEN 'Other' WHEN u <= 11903 THEN 'Symbols/Punctuation'
WHEN u <= 12287 THEN 'CJK Radicals' WHEN u <= 12351 THEN 'CJK Symbols' WHEN u <= 12447 THEN 'Hiragana' WHEN u <= 12543 THEN 'Katakana' WHEN u <= 19967 THEN 'Bopomofo/Other' WHEN u <= 40959 THEN 'CJK Unified Ideographs'
WHEN u <= 44031 THEN 'Yi/Other' WHEN u <= 55295 THEN 'Hangul' WHEN u <= 57343 THEN 'Surrogates' WHEN u <= 63743 THEN 'Private Use' ELSE 'Other' END"""
CHARS_SQL = "(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS c FROM (SELECT doc_id, string_split(text, '') AS l FROM documents WHERE text <> ''))"
RUNS_SQL = f"""(WITH c AS (SELECT *, CASE WHEN pos = 0 OR regexp_matches(c, '\\p{{L}}') THEN (SELECT {SCRIPT_SQL} FROM (SELECT unicode(c) AS u)) END AS own FROM {CHARS_SQL}),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
r AS (SELECT *, sum(CASE WHEN own <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run FROM l)
SELECT doc_id, run, max(own) AS script, count(*) AS chars, sum(strlen(c))::BIGINT AS bytes FROM r GROUP BY doc_id, run)"""


@query(f"SELECT * FROM {RUNS_SQL}")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.script_runs(_docs(spark, sf_dir))


@query(f"SELECT script, sum(chars)::BIGINT AS chars, sum(bytes)::BIGINT AS tokens, round(sum(bytes)::DOUBLE / sum(chars)::DOUBLE, 9) AS fertility FROM {RUNS_SQL} GROUP BY script")
def script_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.script_runs(_docs(spark, sf_dir)).groupBy("script").agg(F.sum("chars").alias("chars"), F.sum("bytes").alias("tokens"))
    return s.withColumn("fertility", F.round(F.col("tokens") / F.col("chars"), 9))


LANG = "(SELECT lang, sum(strlen(text))::DOUBLE AS tokens, sum(length(text))::DOUBLE AS units FROM documents GROUP BY lang)"


@query(f"SELECT lang, tokens, units, round(tokens / units, 9) AS fertility, round(tokens / units / min(tokens / units) OVER (), 9) AS premium FROM {LANG} WHERE units > 0")
def fairness_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _by_language(spark, sf_dir).withColumn("f", F.col("tokens") / F.col("units"))
    best = g.agg(F.min("f").alias("best"))
    return g.crossJoin(best).select("lang", "tokens", "units", F.round("f", 9).alias("fertility"), F.round(F.col("f") / F.col("best"), 9).alias("premium"))


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.octet_length("text")).cast("double").alias("tokens"), F.sum(F.char_length("text")).cast("double").alias("units")).filter("units > 0")


@query(f"""WITH f AS (SELECT tokens / units AS x FROM {LANG} WHERE units > 0)
SELECT n, round(mean, 9) AS mean, round(best, 9) AS best, round(worst, 9) AS worst, round(worst / best, 9) AS max_premium, round((SELECT sum(abs(a.x - b.x)) FROM f a, f b) / (2 * n * n * mean), 9) AS gini
FROM (SELECT count(*) AS n, avg(x) AS mean, min(x) AS best, max(x) AS worst FROM f)""")
def fairness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.fairness(_by_language(spark, sf_dir))
    return s.select("n", *(F.round(c, 9).alias(c) for c in s.columns[1:]))


#: Tokens of a line under two SQL-able models: words and single punctuation marks, against white-space words.
DIFF = r"""(WITH l AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id, line_no, line, regexp_extract_all(line, '[\p{P}\p{S}]|[^\s\p{Z}\p{P}\p{S}]+') AS a, regexp_extract_all(line, '[^\s\p{Z}]+') AS b FROM l)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))  # noqa: E741
    return l.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", pretok.pieces(F.col("line"), "bert").alias("a"), pretok.pieces(F.col("line"), "whitespace_split").alias("b"))


@query(f"""SELECT count(*) AS total_lines, sum(CASE WHEN line <> '' THEN len(a) ELSE 0 END)::BIGINT AS tokens_a, sum(CASE WHEN line <> '' THEN len(b) ELSE 0 END)::BIGINT AS tokens_b,
sum(strlen(line))::BIGINT AS bytes, sum(CASE WHEN line <> '' AND a <> b THEN 1 ELSE 0 END)::BIGINT AS divergent FROM {DIFF}""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.col("line") != ""
    return _diff(spark, sf_dir).agg(F.count("*").alias("total_lines"), F.sum(F.when(full, F.size("a")).otherwise(0)).alias("tokens_a"), F.sum(F.when(full, F.size("b")).otherwise(0)).alias("tokens_b"), F.sum(F.octet_length("line")).alias("bytes"), F.sum((full & (F.col("a") != F.col("b"))).cast("int")).alias("divergent"))


@query(f"SELECT doc_id, line_no, len(a)::INT AS n_a, len(b)::INT AS n_b FROM {DIFF} WHERE line <> '' AND a <> b ORDER BY doc_id, line_no LIMIT 50")
def diff_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("line <> '' AND a <> b").orderBy("doc_id", "line_no").limit(50).select("doc_id", "line_no", F.size("a").alias("n_a"), F.size("b").alias("n_b"))


@query(f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN d = 0 THEN 'exact' WHEN d <= 3 THEN '1-3' WHEN d <= 10 THEN '4-10' ELSE '>10' END AS bucket
FROM (SELECT levenshtein(array_to_string(list_transform(a, lambda x: chr(40 + (ascii(x) % 80))), ''), array_to_string(list_transform(b, lambda x: chr(40 + (ascii(x) % 80))), '')) AS d FROM {DIFF})) GROUP BY bucket""")
def diff_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.transform(c, lambda x: F.ascii(x) % 80 + 40)
    d = A.bounded_levenshtein(ids(F.col("a")), ids(F.col("b")), 64)
    return _diff(spark, sf_dir).select(A.buckets(d).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""SELECT token, side, count(*) AS n FROM (
  SELECT unnest(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS token, 'a' AS side FROM {DIFF} WHERE a <> b
  UNION ALL SELECT unnest(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))), 'b' FROM {DIFF} WHERE a <> b) GROUP BY ALL""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _diff(spark, sf_dir).filter("a <> b")
    side = lambda x, y, n: F.transform(F.array_except(x, y), lambda t: F.struct(t.alias("token"), F.lit(n).alias("side")))
    return d.select(F.explode(F.concat(side("a", "b", "a"), side("b", "a", "b"))).alias("x")).groupBy("x.token", "x.side").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, {WORDS_SQL}::BIGINT AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", A.words(F.col("text")).alias("words"))


STEP, TWO_64 = 0x9E3779B97F4A7C15, 1 << 64


def _smix(x: int) -> int:
    z = (x + STEP) % TWO_64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % TWO_64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % TWO_64
    return z ^ z >> 31


def _smix_sql(rows: str) -> str:
    """rows with the column x mixed; products are taken with 128 bits."""
    rows = f"(SELECT * REPLACE (((x::UHUGEINT + {STEP}) % {TWO_64})::UBIGINT AS x) FROM {rows})"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        rows = f"(SELECT * REPLACE ((xor(x, x >> {shift})::UHUGEINT * {factor}::UHUGEINT % {TWO_64}::UHUGEINT)::UBIGINT AS x) FROM {rows})"
    return f"(SELECT * REPLACE (xor(x, x >> 31) AS x) FROM {rows})"


def _bigram_sql() -> str:
    pair = lambda at, head: f"SELECT conv_id, turn, n, {head} AS head, b[{at}] AS i, b[{at} + 1] AS j, xor({_smix(STEP ^ (head * STEP) % TWO_64) ^ STEP}::UBIGINT, b[{at}]) AS x FROM b WHERE n > 1"
    rows = _smix_sql(f"({pair('1', 0)} UNION ALL {pair('n - 1', 2)})")
    rows = _smix_sql(f"(SELECT * REPLACE (xor(x, j) AS x) FROM {rows})")
    rows = _smix_sql(f"(SELECT * REPLACE (xor(x, 2::UBIGINT) AS x) FROM {rows})")
    code = "(strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1"
    return f"""WITH b AS (SELECT conv_id, turn, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ({code})::UBIGINT) AS b, len(b) AS n FROM conversations),
h AS (SELECT conv_id, turn, head, CASE WHEN x >= {1 << 63} THEN (x::HUGEINT - {TWO_64})::BIGINT ELSE x::BIGINT END AS x FROM {rows})
SELECT b.conv_id, b.turn, n::INT AS n_ids, (greatest(n - 1, 0) * 3)::BIGINT AS n_hashes, f.x AS first, l.x AS last
FROM b LEFT JOIN h f ON f.conv_id = b.conv_id AND f.turn = b.turn AND f.head = 0 LEFT JOIN h l ON l.conv_id = b.conv_id AND l.turn = b.turn AND l.head = 2"""


@query(_bigram_sql())
def ngram_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram hashes of the bytes of each turn under three heads: how many, the first and the last."""
    ids = table(spark, sf_dir, "conversations").select("conv_id", "turn", encode.byte_ids(F.col("text")).alias("ids"))
    h = A.ngram_hashes(F.col("ids"), 2, 3)
    rows = ids.select("conv_id", "turn", F.size("ids").alias("n_ids"), h.alias("h"))
    return rows.select("conv_id", "turn", "n_ids", F.size("h").cast("long").alias("n_hashes"), F.get("h", F.lit(0)).alias("first"), F.try_element_at("h", F.lit(-1)).alias("last"))


@query(f"SELECT h AS hex, count(DISTINCT id) AS n_tokens FROM (SELECT id, unnest(regexp_extract_all(hex, '..')) AS h FROM {VOCAB}) GROUP BY h")
def vocab_byte_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = encode.vocab_table(spark, V).select("id", F.explode(F.array_distinct(F.regexp_extract_all("hex", F.lit(".."), F.lit(0)))).alias("hex"))
    return v.groupBy("hex").agg(F.count("*").alias("n_tokens"))


@query(f"SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN n::VARCHAR WHEN n <= 8 THEN '5-8' WHEN n <= 16 THEN '9-16' ELSE '17+' END AS bucket, count(*) AS n FROM (SELECT length(hex) // 2 AS n FROM {VOCAB}) GROUP BY 1")
def vocab_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("length")
    b = F.when(n <= 1, "1").when(n <= 4, n.cast("string")).when(n <= 8, "5-8").when(n <= 16, "9-16").otherwise("17+")
    return encode.vocab_table(spark, V).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT v.id, coalesce(h.n, 0) AS n FROM {VOCAB} v LEFT JOIN {H} h ON v.id = h.id")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = encode.vocab_table(spark, V).select("id")
    return v.join(_counts(spark, sf_dir), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH v AS {VOCAB}, s AS (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS k FROM v WHERE length(hex) > 2)
SELECT s.id, min(k)::INT AS split, arg_min(a.id, k)::BIGINT AS left_id, arg_min(b.id, k)::BIGINT AS right_id
FROM s JOIN v a ON a.hex = left(s.hex, 2 * k::INT) JOIN v b ON b.hex = substr(s.hex, 2 * k::INT + 1) WHERE a.id < s.id AND b.id < s.id GROUP BY s.id""")
def merge_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.operators.vocabulary import splits

    return splits(encode.vocab_table(spark, V)).groupBy("id").agg(F.min("k").alias("split"), F.min_by("left_id", "k").alias("left_id"), F.min_by("right_id", "k").alias("right_id"))


SPLIT = "CASE WHEN list_aggregate([(strpos('0123456789abcdef', s[2 * i + 1]) - 1) * 16 + strpos('0123456789abcdef', s[2 * i + 2]) - 1 FOR i IN [7, 6, 5, 4, 3, 2, 1, 0]], 'count') = 8 AND ('0x' || array_to_string([s[2 * i + 1:2 * i + 2] FOR i IN [7, 6, 5, 4, 3, 2, 1, 0]], ''))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.1 THEN 'validation' ELSE 'train' END"


@query(f"SELECT doc_id, {SPLIT} AS split FROM (SELECT doc_id, sha256('\\x07\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode(text)) AS s FROM documents)")
def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", A.split_of(7, F.col("text"), 0.1).alias("split"))


@query(f"""SELECT {SPLIT} AS split, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, sum({WORDS_SQL})::BIGINT AS tokens
FROM (SELECT text, sha256('\\x07\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode(text)) AS s FROM documents) GROUP BY 1""")
def split_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("split", A.split_of(7, F.col("text"), 0.1))
    return d.groupBy("split").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(A.words(F.col("text"))).alias("tokens"))


@query("""SELECT role, word, count(*) AS n, count(DISTINCT conv_id) AS contexts FROM (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
GROUP BY role, word HAVING count(*) >= 3 AND count(DISTINCT conv_id) >= 2""")
def tagged_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pre-tagged words (the role stands for the tag) with thresholds."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("role", "word").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("contexts")).filter("n >= 3 AND contexts >= 2")


@query("SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP(lang, source)")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).rollup("lang", "source").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
