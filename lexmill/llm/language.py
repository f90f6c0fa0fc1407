"""Language identification by compression.

A raw-content zstandard dictionary per language is cut from a bounded sample
of labelled texts. A text is cut into blocks, each block is compressed with
each dictionary, and the language whose dictionary gives the fewest bytes over
all blocks is chosen. A choice whose margin over the second is narrow is
rejected (accepted = false).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_fold, documents, stored

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
BLOCK = 4096
#: Dictionaries that a task can hold.
LANGUAGES = 1000


def letters(text: str) -> bytes:
    """What is compressed: lower-case words of letters, so that capitals and symbols don't outweigh the language."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def sample(df: DataFrame, per_language: int, lang_col: str, text_col: str, size: int) -> dict[str, list[str]]:
    """At most per_language texts of each language, those with the smallest hash of their text; of a text of over 4 size characters, so many from its middle. Counts come first, so that only about twice as many rows are ranked."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if counts.count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn")
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)
    near = rows.withColumn("draw", draw).join(F.broadcast(counts), "lang").filter(F.col("draw") * F.col("n") <= 2 * per_language + 20)
    near = near.withColumn("t", F.when(F.length("t") > 4 * size, F.substring("t", (F.length("t") / 2).cast("int") - 2 * size, F.lit(4 * size))).otherwise(F.col("t")))
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw", "t"))).filter(F.col("k") <= per_language)
    found: dict[str, list[str]] = {}
    for r in ranked.select("lang", "t").orderBy("lang", "draw", "t").toLocalIterator():
        found.setdefault(r.lang, []).append(r.t)
    return found


def dictionaries(texts: dict[str, list[str]], size: int) -> dict[str, bytes]:
    """Up to size bytes for each language: an equal share of each text, from its middle; short texts leave theirs to the others."""
    made = {}
    for lang, own in texts.items():
        raw = sorted(map(letters, own), key=len)
        parts, left = [], size
        for k, b in enumerate(raw):
            share = left // (len(raw) - k)
            at = max(0, (len(b) - share) // 2)
            parts.append(b[at : at + share])
            left -= len(parts[-1])
        made[lang] = b"\n".join(parts)
    return made


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int, margin: float):
        self.names = sorted(content)
        self.margin = margin
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compress = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.names or text is None or not LETTER.search(text):
            return "und", 0.0, False
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.compress]
        best = min(sizes)
        at = sizes.index(best)
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != at)
        score = 1 / sum(math.exp(max(-50.0, (best - s) / 8)) for s in sizes)
        return self.names[at], score, second - best >= self.margin * best


def identify(df: DataFrame, train: DataFrame, per_language: int = 300, size: int = 262_144, level: int = 6, margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score, accepted) for each row of df, from dictionaries cut from rows of train.

    Over LANGUAGES languages in train are an error.
    per_language bounds the texts that each dictionary (size bytes) is cut from;
    the whole of each text of df is compressed. A null text, or one without a
    letter, is `und` with score 0, as is every text if train has no labelled
    text. Of languages with equal sizes the first by name is chosen. accepted is
    false where the second language's size is within margin of the best one's.
    Repeated rows each get a row; other columns are not read.
    """
    spark = df.sparkSession
    content = dictionaries(sample(train, per_language, lang_col, text_col, size), size)
    shared = spark.sparkContext.broadcast(content)  # size bytes a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Classifier(shared.value, level, margin)
        for b in batches:
            got = [ask(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] for g in got]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_fold(F.col("doc_id")) == 0
    found = identify(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
