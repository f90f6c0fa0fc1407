"""Public vocabularies against the libraries that they belong to; writers and readers; sinks."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.errors import PythonException

from lexmill.operators import encode, models
from lexmill.plans import formats
from lexmill.sources import readers, sinks, writers

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).cache()


def test_public_ranks(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{formats.PUBLIC}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = readers.load(readers.read_bytes(spark, f"file://{path}"))
    got = {r.doc_id: list(r.ids) for r in encode.encode_lists(docs, v, "bpe", "gpt2").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    assert got == {d: own.encode_ordinary(t) for d, t in texts.items()}


def test_public_json(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{formats.PUBLIC}/byte_bpe_50k.json"
    with open(path, "rb") as f:
        raw = f.read()
    assert readers.detect(raw) == "tokenizer_json"
    got = readers.parse_tokenizer_json(raw)
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    coded = {r.doc_id: list(r.ids) for r in encode.encode_lists(docs, got["vocab"], "bpe", "gpt2").collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    want = own.encode_batch([t for _, t in texts], add_special_tokens=False)
    assert coded == {d: e.ids for (d, _), e in zip(texts, want, strict=True)}


def test_writers_are_read_again():
    v = models.Vocab([b"<s>", *(bytes([b]) for b in range(97, 123)), b"ab", b"abc"])
    assert readers.load(writers.world_text(v)).tokens == v.tokens
    got = readers.parse_tekken(writers.tekken_json(v, 1, "x"))
    assert got["special"] == 1 and got["vocab"].tokens == [None, *v.tokens[1:]] and got["pattern"] == "x"


def test_flat_sink(spark, tmp_path):
    rows = spark.createDataFrame([(3, [7, 8]), (1, [1, 2, 3]), (2, []), (9, [65535])], "doc_id long, ids array<long>").repartition(3)
    path = f"file://{tmp_path}/flat"
    assert sum(r.n for r in sinks.write_flat(rows, path).collect()) == 6
    parts = sorted((r.part, list(r.ids)) for r in sinks.read_flat(spark, path).collect())
    assert [i for _, ids in parts for i in ids] == [1, 2, 3, 7, 8, 65535]
    assert not list((tmp_path / "flat").glob(".part*"))
    with pytest.raises(PythonException, match="OverflowError"):
        sinks.write_flat(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<long>"), f"file://{tmp_path}/bad").collect()


def test_npy_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i, i + 1]) for i in range(20)], "seq long, ids array<int>").repartition(4)
    assert sum(r.rows for r in sinks.write_npy(rows, f"file://{tmp_path}/npy").collect()) == 20
    arrays = [np.load(p) for p in sorted((tmp_path / "npy").glob("*.npy"))]
    assert np.concatenate([a for a in arrays if a.size]).tolist() == [[i, i + 1] for i in range(20)]
    assert sorted(tuple(r.ids) for r in sinks.read_npy(spark, f"file://{tmp_path}/npy").collect()) == [(i, i + 1) for i in range(20)]


def test_ids_outside_a_vocabulary_are_an_error(spark):
    v = models.Vocab([b"a", b"b"])
    good = spark.createDataFrame([(1, [0, 1, 1])], "doc_id long, ids array<long>")
    assert encode.transcoded(good, v, models.LITERAL).first().text == "abb"
    for bad in ([2], [-1], [0, 1]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            encode.transcoded(spark.createDataFrame([(5, bad)], "doc_id long, ids array<long>"), v, models.LITERAL, most=0).collect()


def test_cache_encodes_each_text_once(spark, tmp_path):
    v = models.Vocab([bytes([b]) for b in range(256)])
    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "c"), (4, None), (5, "")], "doc_id long, text string")
    ask = lambda df: {r.doc_id: (list(r.ids), r.hit) for r in encode.cached(df, v, f"file://{tmp_path}/c", scheme="identity").collect()}
    assert ask(rows.limit(2)) == {1: ([97, 98], False), 2: ([97, 98], False)}
    assert ask(rows) == {1: ([97, 98], True), 2: ([97, 98], True), 3: ([99], False)}
