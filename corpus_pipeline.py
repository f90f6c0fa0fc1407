"""A training corpus from raw documents: toxic texts go, one of each group of near copies stays, benchmark passages go, sources are mixed to weights, and the rest is cut into shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it reads the
rows its predecessor kept, from Parquet. An empty table gives an empty table in
each stage. Rows that repeat stay repeated unless a stage says otherwise, and
columns of docs beside doc_id, text and source may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontamination, mixing, sharding, simhash, toxicity
from lexmill.llm.common import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score under 0.5 stay. Null and blank texts have the score of a text without words; rows with null ids are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(docs, docs, labels).filter("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays. Texts without words are copies of one another; rows with null ids stay, and rows that share an id stay or go together."""
    return simhash.without_near_duplicates(docs).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold 40 % of a benchmark item's template go. Null and blank texts, and rows with null ids, stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in the order in which it does. Null and blank texts are never taken; rows of a null source are a source of their own, and rows alike in id and number of words have equal turns."""
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in 40 shards of near equal bytes; equal texts share a shard, a null text goes with the empty ones."""
    return sharding.minimax_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: A trained model and a fingerprint search are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
