"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import packing
from lexmill.sources import readers

from .registry import query, table

LINES = "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, line_no, trim(line, chr(13)) AS line FROM ({LINES}) WHERE trim(line, chr(13)) <> ''")
def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.line_documents(table(spark, sf_dir, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE text <> ''")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query(LINES)
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.diff_lines(table(spark, sf_dir, "documents")).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_field(table(spark, sf_dir, "events"), "props", "k", "long").select("event_id", "k").filter("k IS NOT NULL")


AVOID = "# patterns that a trainer must not learn\r\nthe\r\n\r\n  \n# more\nand\n and\n"


@query("SELECT * FROM (VALUES (1, 'the'), (3, '  '), (5, 'and'), (6, ' and')) AS t(line_no, pattern)")
def avoid_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.avoid_list(spark.createDataFrame([(AVOID,)], "text string"))


SPANS = '{"schema":"v1","image_id":"im1","original_token_count":5,"captions":[{"caption_id":0,"section":"a","text":"red car","tokens":[],"spans":[{"span_id":"s0","token_start":0,"token_end":2,"byte_start":0,"byte_end":7,"text":"red car","role":"object","entity_id":"e1","embedding":[1.0,0.0],"confidence":0.5,"kind":"object"}]},{"caption_id":1,"section":"a","text":"a car","tokens":[],"spans":[{"span_id":"s1","token_start":1,"token_end":2,"byte_start":2,"byte_end":5,"text":"car","role":"object","entity_id":"e1","embedding":[0.8,0.6],"confidence":0.75,"kind":"object"}]}]}'


@query("SELECT * FROM (VALUES ('im1', 0, 's0', 0, 2, 'object', 'e1', 0.5::DOUBLE, 1.0::DOUBLE), ('im1', 1, 's1', 1, 2, 'object', 'e1', 0.75::DOUBLE, 0.8::DOUBLE)) AS t(image_id, caption_id, span_id, token_start, token_end, role, entity_id, confidence, first_value)")
def span_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = readers.semantic_spans(spark.createDataFrame([(SPANS,)], "value string"))
    return spans.select("image_id", "caption_id", "span_id", "token_start", "token_end", "role", "entity_id", "confidence", F.col("embedding")[0].alias("first_value"))


@query("SELECT CASE WHEN count(DISTINCT doc_id) <= 65536 THEN 'uint16' ELSE 'uint32' END AS dtype, count(DISTINCT doc_id) AS n_ids FROM documents")
def id_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("n_ids"))
    return n.select(packing.id_dtype(F.col("n_ids")).alias("dtype"), "n_ids")


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS record FROM documents")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("record"))
