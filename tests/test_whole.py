"""Queries and operators take in their whole input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexmill.llm import line_dedup, simhash
from lexmill.operators import encode
from lexmill.plans import QUERIES, tokens


def test_explain_tokens_has_every_token(spark, sf_dir):
    got = QUERIES["explain_tokens"](spark, sf_dir)
    want = encode.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.V).groupBy("doc_id").agg(F.sum(F.size("ids")).alias("n")).filter("n > 0")
    assert sorted(map(tuple, got.groupBy("doc_id").count().collect())) == sorted(map(tuple, want.collect()))


def test_lines_link_by_edit_similarity_alone(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(2, 10)))
    rows = []
    for n in (10, 10, 10, 20, 20, 30, 50):  # one word of n is changed
        for _ in range(10):
            line = [word() for _ in range(n)]
            other = [*line]
            other[rng.randrange(n)] = word()
            assert line_dedup.similar(" ".join(line), " ".join(other), 0.8)
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows), "abcde"), (len(rows) + 1, "abXde"), (len(rows) + 2, "zzzz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect() if r.n_removed}
    assert got == set(range(1, 142, 2))


def test_near_duplicates_finds_blocks_of_edits(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for share in (0.19, 0.17, 0.14, 0.1):  # a block at the end is appended: the Jaccard similarity is 1 - share
        for _ in range(30):
            words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
            cut = int((len(words) - 4) * (1 - share)) + 1
            want.add(len(rows) + 1)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: cut + 4]))]
    got = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id != r.keep_id}
    assert got <= want and len(got) >= len(want) - 2
