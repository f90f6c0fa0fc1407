"""A merge changes the counts around its places alone."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
import pytest

from lexmill.operators import training as TR


@pytest.mark.parametrize("bound", [None, " "])
def test_steps_count_what_changes(bound, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("aab ") for _ in range(rng.randrange(0, 14))).encode() for _ in range(60)]
    seq = TR.Sequences(words, [rng.randrange(1, 9) for _ in words], bound and TR.cuts_of(words, bound))
    used = []
    monkeypatch.setattr(TR.Sequences, "pairs", lambda self, only=None, real=TR.Sequences.pairs: used.append(only) or real(self, only))
    for new in range(256, 275):
        before = seq.pairs()
        if new == 266 and bound:
            seq.step(*TR.LIFT)
            continue
        pairs = sorted((k for k, n in before.items() if k >= 0 and n > 0), key=lambda k: (-before[k], k))
        if not pairs:
            break
        key = pairs[rng.randrange(min(3, len(pairs)))]
        used.clear()
        change = seq.step(key >> 32, key & 0xFFFFFFFF, new)
        assert not used  # no line is counted as a whole
        want = seq.pairs()
        want.subtract(before)
        assert change == Counter({k: v for k, v in want.items() if v})


def test_words_are_replayed_in_parts(monkeypatch):
    monkeypatch.setattr(TR, "REPLAYED", 10)
    b = pd.DataFrame({"word": [b"abc", b"x" * 30, b"", b"de", b"fghi", b"jklm", b"nop"], "n": range(7)})
    got = list(TR.word_parts(b))
    assert pd.concat(got).equals(b) and max(map(len, got)) < 5


def test_words_are_stored_for_all_cores(spark, monkeypatch):
    files = []
    monkeypatch.setattr(TR, "step_counts", lambda words, *a, real=TR.step_counts: files.append(len(words.inputFiles())) or real(words, *a))
    words = spark.createDataFrame([(f"word{i}", 1 + i % 3) for i in range(200)], "word string, n long").coalesce(1)
    assert len(TR.learn_bpe(words, 260).tokens) == 260
    assert files and min(files) >= 4
