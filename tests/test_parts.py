"""Workers look at some of a batch at a time, and give what they give for all of it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexmill.operators import encode, models


@pytest.mark.parametrize("kernel", ["ungreedy", "bpe", "bpe_whole", "longest"])
@pytest.mark.parametrize("size", [128, 256, 276])
def test_coder_is_the_kernel(kernel, size):
    rng, v = random.Random(3), models.Vocab(models.LITERAL.tokens[:size])
    words = ["the", " and", "in", "zz", " es", "\x0e", "ñ", " 7", ".", "  ", "thing", " de la"]
    for _ in range(50):
        piece = "".join(rng.choice(words) for _ in range(rng.randrange(0, 40))).encode()
        assert models.coder(kernel, v)(piece) == models.KERNELS[kernel](piece, v)
        if kernel == "ungreedy" and piece:
            assert models.choices(v)(piece) == models.ungreedy(piece, v)


def test_coder_keeps_little():
    code = encode.Coder(models.LITERAL, "longest", limit=1000)
    for i in range(20):
        texts = pa.array([f"{i} text {j}" for j in range(50)] + ["x" * 5000 + str(i)])
        assert [list(x) for x in code(texts).to_pylist()] == [models.longest_match(t.encode(), models.LITERAL) for t in texts.to_pylist()]
        assert sum(map(len, code.known)) <= 2000


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(encode, "BYTES", 100)
    texts = ["a" * 30, None, "b" * 500, "", "c" * 60, "d" * 30, "e" * 30]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    got = list(encode.text_parts(b, 1, 100))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts and max(p.num_rows for p in got) < 4
    pieces = pa.array([["the", " and"] * 400, ["in"], ["zz"] * 300], pa.list_(pa.string()))
    b = pa.RecordBatch.from_arrays([pa.array(range(3)), pieces], ["id", "pieces"])
    monkeypatch.setattr(encode.text_parts, "__defaults__", (1000,))
    made = list(encode._coded(iter([b]), models.LITERAL, "bpe", "id"))
    assert len(made) == 3
    want = [[i for p in own for i in models.bpe(p.encode(), models.LITERAL)] for own in pieces.to_pylist()]
    assert [x for m in made for x in m.column(1).to_pylist()] == want
    text = list(encode._decoded(iter(made), models.LITERAL, "id", "concat"))
    assert [x for m in text for x in m.column(1).to_pylist()] == ["".join(own).encode() for own in pieces.to_pylist()]
    assert np.all([m.num_rows == 1 for m in text])
