"""Hashes of n-grams, some ids of a batch at a time."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from lexmill.operators import analytics as A


def test_hashes_come_back_in_slices(spark):
    """400,000 ids in one batch are several slices, and give what single rows give."""
    df = spark.range(40, numPartitions=1).select("id", F.when(F.col("id") % 9 > 0, F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: i % (F.col("id") + 7))).alias("ids"))
    of = lambda rows: {r.id: r.x for r in rows.select("id", F.xxhash64(A.ngram_hashes(F.col("ids"), 2, 3)).alias("x")).collect()}
    assert of(df) == of(df.repartition(40))
    sizes = {r.n for r in df.select(F.size(A.ngram_hashes(F.col("ids"), 2, 3)).alias("n")).collect()}
    assert sizes == {0, 29_997} and "HASHED" in inspect.getsource(A.ngram_hashes)
