"""The pipeline's stages against brute-force versions, each on its predecessor's rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm.common import documents, stored


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = documents(spark, sf_dir), {}
    out["input"] = docs
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = stored(f(spark, docs, sf_dir), name)
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_keeps_and_drops(spark, sf_dir, stages):
    kept = {r.doc_id for r in stages["toxicity"].collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.toxic == 0]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)
    assert sum(r.doc_id not in kept for r in labels if r.toxic == 1) >= 0.8 * sum(r.toxic == 1 for r in labels)


def test_near_duplicates_brute(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    v = [shingles(t) for _, t in rows]
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(v[i] & v[j])
        if v[i] == v[j] or both >= 0.8 * (len(v[i]) + len(v[j]) - both):
            home[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    stay = {d for i, (d, _) in enumerate(rows) if least[find(i)] == d}
    kept = {r.doc_id for r in stages["near_duplicates"].collect()}
    assert stay <= kept  # no clean text goes
    gone = {d for d, _ in rows} - stay
    assert len(gone & kept) <= 0.1 * len(gone)


def test_decontamination_brute(spark, sf_dir, stages):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    where = defaultdict(set)
    for i, w in items.items():
        for k in range(max(1, len(w) - 7)):
            where[tuple(w[k : k + 8])].add((i, k))
    gone = set()
    for r in stages["near_duplicates"].collect():
        hit = defaultdict(set)
        w = words(r.text)
        for k in range(len(w) - 7):
            for i, at in where[tuple(w[k : k + 8])]:
                hit[i].add(at)
        if any(len(s) >= 0.4 * max(1, len(items[i]) - 7) for i, s in hit.items()):
            gone.add(r.doc_id)
    before, after = ({r.doc_id for r in stages[n].collect()} for n in ("near_duplicates", "decontamination"))
    assert before - after == gone


def test_mixing_and_sharding(stages):
    docs = {r.doc_id: r for r in stages["decontamination"].collect()}
    mix = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(mix) <= set(docs) and max(mix.values()) <= 2
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(r.text) for r in docs.values())
    taken = sum(size(docs[d].text) * n for d, n in mix.items())
    longest = max(size(r.text) for r in docs.values())
    assert abs(taken - 1.5 * total) <= 20 * longest
    shards = stages["sharding"].collect()
    assert Counter(r.doc_id for r in shards) == mix
    slots, text = defaultdict(list), defaultdict(set)
    for r in shards:
        slots[r.shard].append(r.slot)
        text[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in text.values())


def test_run_agrees(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    assert key(got) == key(stages["sharding"])


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls in any column, blanks, ties, repeated rows, a long text, columns with clashing names, and empty tables."""
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "how many apples are left for the two of them after a week"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "dreadful words here"), (2, "kind words there"), (3, None), (4, ""), (5, " \n"), (None, "no id"), (6, "same text again"), (7, "same text again"), (6, "same text again"), (8, long), (9, "so how many apples are left for the two of them after a week then")]
    names = ["score", "predicted", "keep_id", "item", "item_id", "w", "taken", "size", "finish", "_turn", "_id", "_h", "shard", "slot", "key", "fp", "_gone", "_found", "t"]
    df = spark.createDataFrame([(*r, None, "s" if i % 3 else None, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.select("*", *(F.lit(1).alias(c) for c in names if c not in ("shard", "slot", "size")))
    kept = {}
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, wide, str(tmp_path))
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect())
        if name != "sharding":
            assert got.columns == wide.columns
        assert f(spark, wide.limit(0), str(tmp_path)).count() == 0
    ids = lambda name: [None if n else i for n, i in kept[name]]
    assert ids("near_duplicates") == [1, 2, 3, 6, 6, 8, 9, None]
    assert ids("decontamination") == [1, 2, 3, 4, 5, 6, 6, 7, 8, None]
    assert ids("sharding") == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, None]
    assert not set(ids("mixing")) & {3, 4, 5} and 8 in ids("mixing")
