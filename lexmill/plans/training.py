"""Vocabulary training. Counts have SQL; learned vocabularies are held against direct versions in tests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import training as TR
from lexmill.operators.models import LITERAL, Vocab, bpe
from lexmill.operators.stored import stored

from .registry import query, table

WORDS = r"(SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\s\p{Z}]+')) AS word FROM documents) GROUP BY word)"


def _words(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return TR.word_counts(table(spark, sf_dir, "documents"), "whitespace_split", **options)


@query(f"SELECT * FROM {WORDS}")
def train_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


@query(f"SELECT * FROM {WORDS} WHERE NOT contains(word, 'th') AND NOT contains(word, '.')")
def train_avoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, avoid=["th", "."])


PAIRS = f'(SELECT b[i] AS "left", b[i + 1] AS "right", sum(n)::BIGINT AS n FROM (SELECT n, b, unnest(range(1, len(b))) AS i FROM (SELECT n, regexp_extract_all(hex(encode(word)), \'..\') AS b FROM {WORDS})) GROUP BY ALL)'


@query(f"SELECT * FROM {PAIRS}")
def train_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.pair_counts(_words(spark, sf_dir))


@query(f'SELECT * FROM {PAIRS} ORDER BY n DESC, "left", "right" LIMIT 1')
def train_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.pair_counts(_words(spark, sf_dir)).orderBy(F.desc("n"), "left", "right").limit(1)


@query(f"""SELECT piece, n FROM (SELECT piece, sum(n)::BIGINT AS n FROM (SELECT substr(word, i::INT, k::INT) AS piece, n FROM (SELECT word, n, i, unnest(range(2, 6)) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM {WORDS})) WHERE i + k - 1 <= length(word)) GROUP BY piece)
ORDER BY n * length(piece) DESC, length(piece) DESC, piece LIMIT 200""")
def train_substring_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.seed(_words(spark, sf_dir), 5, 200)


def _learned(spark: SparkSession, v: Vocab) -> DataFrame:
    rows = [(i, t.hex().upper(), float(v.scores[i]) if v.scores else 0.0) for i, t in enumerate(v.tokens)]
    return spark.createDataFrame(rows, "id long, hex string, score double").withColumn("score", F.round("score", 6))


@query()
def train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, TR.learn_bpe(stored(_words(spark, sf_dir)), 320))


@query()
def train_spanning_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("text").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return _learned(spark, TR.learn_spanning(stored(lines), 300))


@query()
def train_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, TR.learn_wordpiece(stored(_words(spark, sf_dir)), 240))


@query()
def train_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, TR.learn_unigram(stored(_words(spark, sf_dir)), 400, start=600))


@query()
def train_distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(_words(spark, sf_dir))
    return _learned(spark, TR.distill(words, TR.learn_bpe(words, 330), 290, 0.3))


@query()
def train_path_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(_words(spark, sf_dir))
    return _learned(spark, TR.path_pieces(words, TR.learn_bpe(words, 310), 290, 10))


@query(f"""SELECT id, 'base' AS kind, true AS kept FROM range({len(LITERAL.tokens)}) t(id) UNION ALL SELECT {len(LITERAL.tokens)} + i, 'new', true FROM range(20) t(i)""")
def adapt_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base vocabulary with 20 tokens for the words of web pages: ids of the base stay, new tokens follow and repeat none of it."""
    new, _ = TR.adapt(table(spark, sf_dir, "pages").select(F.col("html").alias("text")), LITERAL, bytes.split, 20)
    after = [*LITERAL.tokens, *new]
    rows = [(i, "base" if i < len(LITERAL.tokens) else "new", t == LITERAL.tokens[i] if i < len(LITERAL.tokens) else t not in LITERAL.by_bytes) for i, t in enumerate(after)]
    return spark.createDataFrame(rows, "id long, kind string, kept boolean")


@query(f"SELECT word, n FROM {WORDS}")
def train_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word, encoded with the vocabulary that was learned from all of them and decoded again."""
    words = stored(_words(spark, sf_dir))
    v = TR.learn_bpe(words, 300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(word=[b"".join(v.tokens[i] for i in bpe(w.encode("utf-8", "surrogatepass"), v)).decode("utf-8", "surrogatepass") for w in b["word"]])

    return words.mapInPandas(run, "word string, n long")


@query(f"""SELECT CASE WHEN e < 0.5 AND i >= 3 THEN -1 ELSE i END AS id, round(ln(greatest(e, 0.5) / sum(greatest(e, 0.5)) OVER ()), 6) AS score
FROM (SELECT i, (i * i + (SELECT count(*) FROM {WORDS})) % 7 / 4.0::DOUBLE AS e FROM range(40) t(i)) WHERE e >= 0.5 OR i < 3""")
def train_m_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _words(spark, sf_dir).count()
    e = spark.range(40).select("id", (((F.col("id") * F.col("id") + n) % 7) / F.lit(4.0)).alias("expected"))
    return TR.maximized(e, 3).select("id", F.round("score", 6).alias("score"))
