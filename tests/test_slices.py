"""Text kernels: batches come back in slices, and tables say what the characters one by one do."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from lexmill.functions import text as N

CHARS = "aB z\t\n\r\0� ­ññÉİßſ漢字́​東𠀀🙂Σς"


def slow_bert(text):
    text = "".join(" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c for c in text if not (c in "\0�" or c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf")))
    text = "".join(f" {c} " if N.is_cjk(c) else c for c in text)
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def slow_origin(kernel, text):
    out, origin, at, clusters = "", [], 0, []
    for c in text:
        if clusters and unicodedata.combining(c):
            clusters[-1] += c
        else:
            clusters.append(c)
    for x in clusters:
        out += kernel(x)
        origin += [at] * len(kernel(x).encode())
        at += len(x.encode())
    return out, origin


def texts():
    rng = random.Random(9)
    return ["", "plain ASCII\tText\x07", *("".join(rng.choice(CHARS) for _ in range(rng.randrange(1, 40))) for _ in range(200))]


def test_tables():
    for t in texts():
        assert N.bert_text(t) == slow_bert(t)
        assert N.fold_simple(t) == "".join(x if len(x := c.lower()) == 1 else c for c in t)
        assert N.to_byte_level(t) == "".join(N.byte_alphabet()[b] for b in t.encode())
        kernel = lambda x: x.replace("ñ", "nn").replace("a", "")
        assert N.with_origin(kernel, t) == slow_origin(kernel, t)


def test_slices(spark):
    """100 texts of 50,000 characters are one batch of 5 MB, and come back in slices of at most 1 MB."""
    df = spark.range(100, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("aña"), 16_667)).alias("text"))

    kernel = lambda t: t.replace("a", "")
    got = df.select("id", N.origin_column(kernel)("text").alias("o"), N.lift(str.upper)("text").alias("u")).selectExpr("id", "octet_length(o.text) AS n", "size(o.origin) AS m", "o.text IS NULL AS lost", "u").collect()
    for r in got:
        assert (r.n, r.m, r.lost, r.u) == ((33_334, 33_334, False, "AÑA" * 16_667) if r.id % 7 else (None, r.m, True, None))
    assert all(r.m in (None, -1) for r in got if r.id % 7 == 0)
    import pyarrow as pa

    assert [len(x) for x in N.text_slices(pa.array(["x" * 400_000] * 5 + [None]))] == [2, 2, 2]
