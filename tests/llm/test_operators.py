"""Each operator against a brute-force version on small tables with nulls, blanks, long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import bwt, components, decontamination, exact_dedup, golay, language, line_dedup, mixing, sharding, simhash, substring_dedup, suffix_dedup, toxicity, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, h long, key int, n int, size string, doc string, shard int, a int, st int, salt int"
EXTRA = (1, "x", 2, 3, 4, "y", "z", 5, 6, 7, 8)
SPACE = r"[\x20\x09-\x0D]+"


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "Red", "blue", "green", "stone", "river", "é", "naïve", "12", "walks", "over", "|", "and", "then", "down"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randrange(5, 60)) for _ in range(12)]
    long = "\n".join(text(40) for _ in range(80))
    texts = [None, "", "  \t\n ", "x", *base, base[0], base[0] + " ", re.sub(" ", "\t ", base[0]), base[1].replace("the", "a", 1), long, long + " end", "start " + long[200:2500], long, "aaaa " * 300, "aaaa " * 200, text(500), text(3000), "\n".join([base[2], base[2], base[3]]), base[2].upper()]
    rows = [(i * 7 % 101, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), 0, *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], rows[0]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(SPACE, " ", t or "")


def test_exact_dedup(spark, docs, rows, empty, tmp_path):
    path = str(tmp_path / "d.parquet")
    docs.repartition(5).write.parquet(path)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = sorted((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), r[0] == min(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    for options in ({}, {"max_files": 1}):
        got = exact_dedup.streaming_exact_dedup(spark, path, **options).collect()
        assert sorted(tuple(r)[:5] for r in got) == want
    # a later call with the same checkpoint reads only what is new
    check = str(tmp_path / "state")
    assert exact_dedup.streaming_exact_dedup(spark, path, checkpoint=f"file://{check}").count() == len(rows)
    spark.createDataFrame([(-5, rows[4][1], *rows[4][2:])], SCHEMA).write.mode("append").parquet(path)
    assert exact_dedup.streaming_exact_dedup(spark, path, checkpoint=f"file://{check}").filter("keep_id = -5").count() == len(groups[norm(rows[4][1])]) + 1
    # a folder beside it whose name begins alike is another table; a single file may be read too
    spark.createDataFrame([(-9, rows[4][1], *rows[4][2:])], SCHEMA).coalesce(1).write.parquet(f"{path}_old")
    assert exact_dedup.streaming_exact_dedup(spark, path).filter("keep_id = -9").count() == 0
    assert exact_dedup.streaming_exact_dedup(spark, str(next((tmp_path / "d.parquet_old").glob("*.parquet")))).count() == 1
    empty.write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup.streaming_exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


def test_exact_dedup_collisions(spark, tmp_path):
    """A digest of the length alone: full bytes must tell texts apart."""
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(3, "ab"), (1, "cd"), (2, "ab"), (5, "xyz"), (4, None)], "doc_id long, text string").write.parquet(path)
    digest = F.unhex(F.lpad(F.hex(F.length(F.coalesce("text", F.lit("")))), 4, "0"))
    batch = F.unhex(F.lpad(F.hex(F.length(F.coalesce("t", F.lit("")))), 4, "0"))
    state = exact_dedup.digest_state(spark, path, spark.read.parquet(path).schema, f"file://{tmp_path}/s", digest)
    assert {(r.keep_id, r.group_size) for r in state.collect()} == {(1, 3), (5, 1), (4, 1)}
    original = exact_dedup.digest_state
    try:
        exact_dedup.digest_state = lambda *a, **k: state
        got = exact_dedup.streaming_exact_dedup(spark, path, digest=batch).collect()
    finally:
        exact_dedup.digest_state = original
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(3, 2, 2), (2, 2, 2), (1, 1, 1), (5, 5, 1), (4, 4, 1)}


def test_edit_distance():
    rng = random.Random(4)

    def slow(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, d in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
            p = q
        return p[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        want, limit = slow(a, b), rng.randrange(15)
        got = line_dedup.edit_distance(a, b, limit)
        assert got == want if want <= limit else got > limit
    for _ in range(40):
        text, others = "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 70))), ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 90))) for _ in range(rng.randrange(1, 9))]
        assert line_dedup.edit_distances(text, others).tolist() == [slow(text, x) for x in others]
        near = [text[:k] + "x" + text[k + 1 :] for k in range(min(6, len(text)))] + others
        for together in (1 << 20, 40):
            assert line_dedup.alike(text, near, 0.8, together) == [i for i, x in enumerate(near) if line_dedup.similar(x, text, 0.8)]


def test_line_limits():
    """A pair at just its limit is similar, however long; pairs compared together, and sketches and lines of bytes, are as those of one at a time."""
    rng = random.Random(5)
    asked, want, limits = [], [], 0
    for n in [9, 40, 63, 64, 65, 100, 130, 200] * 6:
        text = "".join(rng.choice("abc é") for _ in range(n))
        for more in (0, 1):  # so many letters beyond the limit that none of the text's equals
            edits = int(n * 0.2 + 1e-9) + more
            at = set(rng.sample(range(n), edits))
            other = "".join("z" if i in at else c for i, c in enumerate(text))
            asked.append((text, [other]))
            want.append([0] * (1 - more))
            limits += line_dedup.similar(text, other, 0.8) == (not more)
            spots = sorted(rng.sample(range(n), n // 4 + more))
            longer = "".join("z" * (i in spots) + c for i, c in enumerate(text))
            asked.append((text, [longer]))
            want.append([0] * (1 - more))
            limits += line_dedup.similar(longer, text, 0.8) == (not more)
    assert limits == len(asked)
    assert line_dedup.answers(asked, 0.8) == want
    assert line_dedup.answers(asked[:2], 0.8) == want[:2]
    assert not line_dedup.close_words(["a", "b"], ["c", "d"], 1) and line_dedup.close_words(["a", "b"], ["a", "d"], 2)
    long = " ".join(f"w{i}" for i in range(2000))
    assert line_dedup.answers([(long, [long.replace("w7", "v7"), long[::-1]])], 0.8) == [[0]]
    text = "ΑΣ Σ\r\n\t a \x0b\x0c  B \n\n\x1cc"
    assert line_dedup.normal_lines(text) == [line_dedup.normal(x).encode() for x in text.split("\n")]
    lines = [x for x, _ in asked] + [long]
    assert line_dedup.sketches(lines) == [line_dedup.sketches([x])[0] for x in lines]


def test_lines_compared_together():
    """Distances near the diagonal decide as whole tables do; unlike lines of a group are compared many at a time, and all links of it are kept."""
    rng = random.Random(6)
    a, b, limits = [], [], []
    for n in [30, 64, 150, 200, 333, 420] * 8:
        text = [rng.choice("abcd é") for _ in range(n)]
        other = list(text)
        for _ in range(rng.randrange(1, n // 4)):
            k = rng.randrange(len(other))
            other[k : k + rng.randrange(2)] = rng.choice(["", "a", "z", "bc"])
        x, y = "".join(text), "".join(other) or "a"
        true = line_dedup.edit_distance(x, y, len(x) + len(y))
        for limit in {max(0, true - 1), true, true + 20, rng.randrange(n)}:
            a.append(x)
            b.append(y)
            limits.append(limit)
    want = [line_dedup.edit_distance(x, y, len(x) + len(y)) <= k for x, y, k in zip(a, b, limits, strict=True)]
    for x, y in ((a, b), (b, a)):
        assert line_dedup.within(x, y, np.array(limits)).tolist() == want
        assert [bool(line_dedup.within([p], [q], np.array([k]))[0]) for p, q, k in zip(x, y, limits, strict=True)] == want

    class Rows:
        """Takes what verified() does in a task."""

        def same(self, *_):
            return self

        select = repartition = sortWithinPartitions = same

        def mapInArrow(self, run, _):
            return run

    lines = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(100)]
    lines += [x[:k] + "z" + x[k + 1 :] for x in lines[:30] for k in (5, 20, 40)]
    rng.shuffle(lines)
    rows = pa.RecordBatch.from_pydict({"root": np.zeros(len(lines), np.int64), "h": np.arange(len(lines)), "v": pa.array([bytes(32)] * len(lines)), "line": lines})
    rounds, answers = [], line_dedup.answers
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "answers", lambda asked, least: rounds.append(len(asked)) or answers(asked, least))
        links = [(x["a"], x["b"]) for t in line_dedup.verified(Rows(), ["root"], [None, 28], 0.8)(iter([rows])) for x in t.to_pylist()]

    def groups(pairs):
        home = list(range(len(lines)))
        for i, j in pairs:
            home = [home[i] if x == home[j] else x for x in home]
        return home

    def sets(home):
        return sorted(tuple(i for i, x in enumerate(home) if x == y) for y in set(home))

    assert all(line_dedup.similar(lines[i], lines[j], 0.8) for i, j in links)
    assert sets(groups(links)) == sets(groups((i, j) for i, j in combinations(range(len(lines)), 2) if line_dedup.similar(lines[i], lines[j], 0.8)))
    assert len(rounds) < 40  # one line at a time took a round for each


def test_line_keys_in_bundles(spark):
    """Keys dealt out in bundles give the components of keys dealt out one by one, and tell the keys past the limit once each."""
    rng = random.Random(7)
    base = [" ".join(rng.choice(["some", "word", "other", "text", "more", "line"]) + str(rng.randrange(9)) for _ in range(14)) for _ in range(15)]
    lines = sorted({x[: k + 30] + "!" + x[k + 31 :] for x in base for k in range(12)} | {"", "a", "ab", "abc"})
    made = line_dedup.sketches(lines)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "h long, sketch binary")

    def groups(found):
        links = [(r.a, r.b) for r in found if not r.hot]
        home = list(range(len(lines)))
        for i, j in links:
            home = [home[i] if x == home[j] else x for x in home]
        return sorted(tuple(i for i, x in enumerate(home) if x == y) for y in set(home))

    for most in (20_000, 8):
        want = simhash.linked(line_dedup.sketch_keys(df), ["key"], "h", ["v0", "v1"], [None, line_dedup.SKETCH], most).collect()
        for keyed, together in ((250_000, 1_000_000), (100, 1_000_000), (250_000, 50)):
            got = line_dedup.key_links(df.repartition(5), most, keyed, together).collect()
            assert groups(got) == groups(want)
            assert sorted(r.a for r in got if r.hot) == sorted(r.a for r in want if r.hot) and any(r.hot for r in got) == (most == 8)
    assert line_dedup.key_links(df.filter("h < 0")).count() == 0


def test_line_dedup(docs, rows, empty):
    mask, m = (1 << 64) - 1, int(windows.M)

    def mix(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & mask
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & mask
        return x ^ x >> 33

    def fp(line):
        ws = [w for w in line.encode().split(b" ")]
        hs = [mix(sum((c + 1) * pow(m, i, 1 << 64) for i, c in enumerate(w)) + len(w) & mask) for w in ws]
        own = [h for h, w in zip(hs, ws, strict=True) if any(c >= 128 or chr(c).isalnum() for c in w)] or [mix(sum(h * pow(m, i, 1 << 64) for i, h in enumerate(hs)) + len(hs) & mask)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))

    occ = defaultdict(set)
    for r in rows:
        for i, line in enumerate((r[1] or "").split("\n") if r[1] else []):
            if line_dedup.normal(line):
                occ[line_dedup.normal(line)].add((r[0], zlib.crc32(r[1].encode()), i))
    lines = list(occ)
    fps = [fp(x) for x in lines]
    home = list(range(len(lines)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, j in combinations(range(len(lines)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3 and line_dedup.similar(lines[i], lines[j], 0.8):
            home[find(i)] = find(j)
    groups = defaultdict(set)
    for i, x in enumerate(lines):
        groups[find(i)] |= occ[x]
    gone = defaultdict(set)
    for g in groups.values():
        for d, th, i in sorted(g)[1:]:
            gone[d, th].add(i)
    got = sorted((r.doc_id, r.n_lines, r.n_removed, tuple(r.removed_lines)) for r in line_dedup.dedup_lines(docs).collect())
    want = []
    for r in rows:
        out = sorted(gone[r[0], zlib.crc32((r[1] or "").encode())])
        want.append((r[0], len(r[1].split("\n")) if r[1] else 0, len(out), tuple(out)))
    assert got == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_bytes(docs, rows, empty, hot, monkeypatch):
    seen = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 39):
            seen[b[i : i + 40]] += 1
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        out = bytearray(len(b))
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                out[i : i + 40] = b"\1" * 40
        left = bytes(x for x, g in zip(b, out, strict=True) if not g)
        want.append((r[0], len(b), sum(out), len(re.findall(b"\1+", bytes(out))), hashlib.sha256(left).hexdigest()))
    got = suffix_dedup.drop_repeated_bytes(docs, window=40, gram=20, keep_bytes=False, hot=hot, bucket=3 if hot else 20_000, shard_bytes=300)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    monkeypatch.setattr(windows, "TOGETHER", 333)  # long texts in pieces
    got = suffix_dedup.drop_repeated_bytes(docs, window=40, gram=20, keep_bytes=False, hot=hot, shard_bytes=1 << 14)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert suffix_dedup.drop_repeated_bytes(empty).count() == 0
    r = suffix_dedup.drop_repeated_bytes(docs, window=40, gram=20).filter("n_removed > 0").first()
    assert len(r.kept) == r.n_bytes - r.n_removed and sum(s.end - s.first for s in r.spans) == r.n_removed


def test_merged_order():
    """Merged shards give the order that sorting all suffixes gives."""
    rng = random.Random(5)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(40)]
    got = bwt.merged(strings, 30, 200)
    whole = b"".join(bytes(c + 1 for c in s) + b"\0" for s in strings)
    cut = [whole[i : i + 30].split(b"\0")[0] for i in range(len(whole))]
    rank = got.ranks[-1]
    for i, j in combinations(rng.sample(range(len(whole)), 150), 2):
        if len(cut[i]) == 30 == len(cut[j]):
            assert (rank[i] == rank[j]) == (cut[i] == cut[j])
        if cut[i] != cut[j] and len(cut[i]) == 30 == len(cut[j]):
            assert (rank[i] < rank[j]) == (cut[i] < cut[j])
    assert sorted(got.order().tolist()) == list(range(len(whole)))
    assert sorted(got.transform().tolist()) == sorted(got.symbols.tolist())
    order, raw = got.order(), got.symbols.tolist()
    for i, j, n in zip(order[:-1].tolist(), order[1:].tolist(), got.common_prefixes().tolist(), strict=True):
        assert n == next((k for k in range(30) if not raw[i + k] or not raw[j + k] or raw[i + k] != raw[j + k]), 30)
    inside = [i for i in range(len(whole)) if len(cut[i]) == 30]
    seen = Counter(cut[i] for i in inside)
    assert [bool(got.repeated()[i]) for i in inside] == [seen[cut[i]] > 1 for i in inside]


def test_merged_order_decides(spark):
    """Where the segments of an anchor differ, what the merged order calls repeated goes, and nothing else does."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = text(90)
    df = spark.createDataFrame([(i, text(50) + core + text(50)) for i in range(6)], "doc_id long, text string").coalesce(1)
    ask = lambda: [r.n_removed for r in suffix_dedup.drop_repeated_bytes(df, window=40, gram=20, keep_bytes=False).collect()]
    assert min(ask()) >= 90
    texts = spark.createDataFrame([(1, 10, 0, 0, 51, 2, bytearray(core.encode())), (1, 11, 0, 5, 41, 2, bytearray(core[10:].encode())), (1, 12, 0, 0, 11, 2, bytearray(text(50).encode()))], "k long, doc long, th long, a int, n int, st byte, bytes binary")
    found = sorted(map(tuple, suffix_dedup.repeated_by_order(texts, 40, 60).select("doc", "a", "n").collect()))
    assert found == [(10, 10, 41), (11, 5, 41)]


def test_merged_order_of_equal_ends():
    """Strings with equal ends, dealt to many shards, are ordered alike whatever follows them."""
    for seed in range(20):
        rng = random.Random(seed)
        strings = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 25))) + rng.choice(["abab", "babbabba"])).encode() for _ in range(60)]
        for length in (14, 30):
            got, at, windows_ = bwt.merged(strings, length, 60).repeated(), 0, []
            for x in strings:
                windows_ += [(at + i, x[i : i + length]) for i in range(len(x) - length + 1)]
                at += len(x) + 1
            seen = Counter(w for _, w in windows_)
            assert [bool(got[i]) for i, _ in windows_] == [seen[w] > 1 for _, w in windows_]


def test_frequent_anchors_share_texts(spark, monkeypatch):
    """Windows of frequent anchors are taken from the same texts as those of others: documents are joined once for both."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, other = text(60), text(60)
    df = spark.createDataFrame([(i, text(30) + core + text(30) + (other if i < 2 else "")) for i in range(8)], "doc_id long, text string").coalesce(1)
    calls, made = [], suffix_dedup.segment_texts
    monkeypatch.setattr(suffix_dedup, "segment_texts", lambda *a: calls.append(1) or made(*a))
    ask = lambda **more: sorted(map(tuple, suffix_dedup.drop_repeated_bytes(df, window=40, gram=20, keep_bytes=False, **more).collect()))
    want = ask()
    assert len(calls) == 1 and min(r[2] for r in want) >= 60
    assert ask(bucket=3) == want and ask(hot=2) == want and len(calls) == 3


@pytest.mark.parametrize("hot", [None, 1])
def test_repeated_passages(docs, rows, empty, hot, monkeypatch):
    where = defaultdict(set)
    for r in rows:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - 12):
            where[tuple(w[i : i + 13])].add(r[0])
    want = []
    for r in rows:
        w = (r[1] or "").encode().split()
        out = [False] * len(w)
        for i in range(len(w) - 12):
            if min(where[tuple(w[i : i + 13])]) < r[0]:
                out[i : i + 13] = [True] * 13
        left = b" ".join(x for x, g in zip(w, out, strict=True) if not g)
        want.append((r[0], len(w), sum(out), hashlib.sha256(left).hexdigest()))
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").encode().split())
    for bucket, together in ((substring_dedup.BUCKET, windows.TOGETHER), (2, 50)):
        monkeypatch.setattr(windows, "TOGETHER", together)
        got = substring_dedup.drop_repeated_passages(docs, hot=hot, bucket=bucket).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want)
        for r in got:  # each factor stands where it points to, in a smaller document
            assert len(r.factors) == r.n_factors and (r.n_factors > 0) == (r.n_removed > 0)
            for f in r.factors:
                n = f.end - f.first
                assert f.ref < r.doc_id and n >= 13
                assert any(w[f.first : f.end] == x[f.ref_first : f.ref_first + n] for w in texts[r.doc_id] for x in texts[f.ref] if len(w) >= f.end)
    assert substring_dedup.drop_repeated_passages(empty).count() == 0


def test_golay():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 23, 3000)
    k = golay.keys(w)
    assert set((k >= 0).sum(1).tolist()) == {1, 6}
    for n in (0, 1, 2):
        e = np.array([sum(1 << int(p) for p in rng.choice(23, n, replace=False)) for _ in w])
        j = golay.keys(w ^ e)
        assert ((k[:, :, None] == j[:, None, :]) & (k >= 0)[:, :, None]).any((1, 2)).all()


def slow_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def test_simhash(docs, rows, empty):
    fps = [slow_fingerprint(r[1]) for r in rows]
    home = list(range(len(rows)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            home[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = sorted((r[0], f"{fps[i]:016x}", least[find(i)]) for i, r in enumerate(rows))
    assert sorted(map(tuple, simhash.simhash_components(docs).collect())) == want
    assert simhash.simhash_components(empty).count() == 0


def test_links_in_blocks(spark):
    """Keys with more rows than a task may hold give the same components."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    fps = sorted({int(b) ^ sum(1 << int(p) for p in rng.choice(62, 2, replace=False)) for b in base for _ in range(40)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def groups(links):
        home = {x: x for x in fps}

        def find(x):
            while home[x] != x:
                x = home[x]
            return x

        for a, b in links:
            home[find(a)] = find(b)
        out = defaultdict(set)
        for x in fps:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    want = groups([(a, b) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 4])
    links = simhash.linked(simhash.keyed(df), ["key"], "fp", ["fp"], [4], 10)
    found = links.collect()
    assert any(r.hot for r in found)
    blocks = line_dedup.in_blocks(simhash.keyed(df), "key", "fp", lambda r, by: simhash.linked(r, by, "fp", ["fp"], [4], None))
    assert groups([(r.a, r.b) for r in blocks.collect()]) == want
    assert groups([(r.a, r.b) for r in simhash.golay_links(df, "fp", ["fp"], [4]).collect()]) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    home = {x: x for e in edges for x in e}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in home)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:10]):
        c = list(b)
        c[rng.randrange(200)] = "changed"
        rows += [(100 + i, " ".join(c)), (200 + i, " ".join(b).upper())]
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {x: i for i in range(10) for x in (i, 100 + i, 200 + i)}


def test_sharding(docs, rows, empty):
    got = sharding.minimax_shards(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "h", "a", "st", "slot"}
    by_text, slots, total = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        by_text[r.text or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
        assert r["size"] == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.minimax_shards(empty).count() == 0


def test_smallest_capacity(spark):
    rng = random.Random(8)
    for _ in range(60):
        sizes, k = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 6)
        best = min((max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in combinations([i for i in range(len(sizes) + 1) for _ in range(2)], k - 1)), default=sum(sizes))
        cap = sharding.smallest_capacity(sizes, k)
        assert cap == best
        cuts = [0, *sharding.even_cuts(sizes, k, cap), len(sizes)]
        assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) == cap
    # refined from coarse sums, the cuts are those over all groups
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1, 500)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "h long, size long")
    order = sorted(rows)
    cap = sharding.smallest_capacity([s for _, s in order], 12)
    cuts = sharding.minimax_cuts(df, 12, first_bits=5)
    shards = Counter(sum(h >= c for c in cuts) for h, _ in order)
    sums = Counter()
    for h, s in order:
        sums[sum(h >= c for c in cuts)] += s
    assert len(shards) == 12 and max(sums.values()) == cap
    # with one group of a third of everything, in passes of few sums
    heavy = rows + [(rows[5][0], 1)] * 200 + [(rows[5][0], sum(s for _, s in rows) // 2)]
    groups = Counter()
    for h, s in heavy:
        groups[h] += s
    cap = sharding.smallest_capacity([groups[h] for h in sorted(groups)], 12)
    cuts = sharding.minimax_cuts(spark.createDataFrame(heavy, "h long, size long"), 12, most=128)
    sums = Counter()
    for h, s in heavy:
        sums[sum(h >= c for c in cuts)] += s
    assert max(sums.values()) == cap


def test_mixing(docs, rows, empty):
    got = mixing.fair_mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(t.given for t in r.turns)
    budget = sum(size.values()) * 150 // 100
    level = None
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(weight[s] for s in names if s not in capped)
        level = (budget - sum(2 * size[s] for s in capped)) / rest if rest else 0
        more = {s for s in names if s not in capped and weight[s] * level >= 2 * size[s]}
        if not more:
            break
        capped |= more
    for s in names:
        want = 2 * size[s] if s in capped else weight[s] * level
        assert abs(target[s] - want) < 1e-6 * max(1, want)
    # the queues, served one turn after another
    queues = defaultdict(list)
    for r in rows:
        queues[r[3]].append((hashlib.sha256(str(r[0]).encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[0]))
    turns = []
    for s, q in queues.items():
        at = 0
        for k in range(2):
            for _, n, i in sorted(q):
                at += n
                if n:
                    turns.append((at / target[s], s is None, s or "", at, n, (s, i, n)))
    want, left = Counter(), budget
    for *_, n, who in sorted(turns):
        want[who] += min(n, left)
        left -= min(n, left)
    for most in (mixing.CUT, 3):
        found = Counter()
        for r in mixing.fair_mix(docs, most=most).collect():
            found[r.source, r.doc_id, r["size"]] += r.taken
        assert +found == +want
    served = [r.doc_id for r in mixing.mixed(docs).collect()]
    order = sorted((f, w[1]) for f, *_, n, w in turns)
    assert set(served) <= {i for _, i in order} and len(served) > 20
    assert mixing.fair_mix(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit(1) for c in ("_id", "_size", "_turns", "_turn", "finish", "turn", "source_size")})
    assert mixing.mixed(clash).count() == len(served) and sharding.minimax_shards(clash.withColumns({c: F.lit(1) for c in ("_h", "_cell", "_part", "_before")})).count() == len(rows)


def test_language(spark, empty, docs):
    rng = random.Random(9)
    parts = {"en": ["th", "ing", "the", "and", "wh"], "de": ["sch", "ung", "der", "zu", "ß"], "fr": ["eau", "é", "le", "que", "ç"]}
    make = lambda p: " ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    train = [(i, make(p), lang) for lang, p in parts.items() for i in range(30)]
    test = [(i, make(p), lang) for lang, p in parts.items() for i in range(20)]
    t = spark.createDataFrame(train + [(99, "x y z", None), (98, None, "en")], "doc_id long, text string, lang string")
    q = spark.createDataFrame(test + [(1, None, "en"), (2, "12 .. 34", "fr"), (3, "", "de")], "doc_id long, text string, lang string")
    got = language.identify(q.withColumn("want", F.col("lang")), t, size=8192).collect()
    assert len(got) == 63
    scored = [r for r in got if r.lang_pred != "und"]
    assert len(scored) == 60 and sum(r.accepted for r in scored) > 55 and all(0 <= r.score <= 1 for r in got)
    ask = language.Classifier(language.dictionaries({k: [x for _, x, g in train if g == k] for k in parts}, 8192), 6, 0.01)
    assert sum(ask(x)[0] == g for _, x, g in test) >= 58
    assert language.identify(docs, empty).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(empty, t).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    bad = ["wretched", "stinking", "horrible"]

    def text(toxic):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1000, 1), (5, 7)], "doc_id long, toxic int")
    test = spark.createDataFrame([(i, text(i % 2)) for i in range(100)] + [(100, "some wretch3d stinkking thing is here"), (101, None), (102, " ".join(words * 20) + " wretched stinking horrible " + " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(test, df, labels).collect()}
    assert len(got) == 103 and sum(got[i].predicted == i % 2 for i in range(100)) >= 95
    assert got[100].score > 0.5 and got[101].predicted == 0 and got[102].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    none = toxicity.toxicity(docs, docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and len(none) == docs.count()
    assert toxicity.toxicity(empty, df, labels).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "Tom has 12 apples and gives 5 of them to his sister Anna, so how many apples are left for Tom after 12 days?", 0), (2, "river stone blue", 0), (3, None, 0), (4, "", 0), (5, "a train runs 40 km in 2 hours and then it runs on for 40 km more before it stops", 0)], "item_id long, text string, id int")
    rows = [
        (1, "intro words. Tom has 12 apples and gives 5 of them to his sister Anna, so how many apples are left for Tom after 12 days? more"),
        (2, "Once Tim has 30 apples and gives 7 of them to his sister Jane, so how many apples are left for Tim after 30 days?"),
        (3, "Tim has 30 apples and gives 7 of them to his sister Jane, so how many apples are left for Bob after 99 days?"),
        (4, "a quiet river stone blue as the sky"), (5, None), (6, ""), (7, "a train runs 55 miles in 3 hours and then it runs on for 55 miles more before it stops"),
        (8, "nothing of that kind is written here at all, but 12 apples are nice to have at 12 each"), (1, "intro words."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("item", F.lit(2))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(df, items).collect()}
    assert set(got) >= {(1, 1), (2, 1), (4, 2), (7, 5)} and not {d for d, _ in got} & {5, 6, 8}
    assert got[1, 1].exact and got[1, 1].share > 0.8 and not got[2, 1].exact and not got[7, 5].exact
    # inconsistent slots: one name stands for two
    assert (3, 1) not in got or got[3, 1].n_windows < got[2, 1].n_windows
    left = decontamination.decontaminated(df, items)
    assert {r.doc_id for r in left.collect()} >= {5, 6, 8} and left.columns == df.columns
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(empty, items).count() == 0


def templates(text):
    """Words of a text and what stands for them in its template."""
    marked = regex.sub(r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}[\p{L}\p{N}]*)", lambda m: m[0] if m[0] in decontamination.OPENERS else decontamination.NAME + m[0], text or "")
    words = regex.sub(r"[^\p{L}\p{N}\x01]+", " ", regex.sub(r"(\d)[.,](?=\d)", r"\1", marked.lower())).split()
    kind = lambda w: 1 if "0" <= w[0] <= "9" else 2 if w[0] == decontamination.NAME else 3 if w in decontamination.UNITS else 0
    return words, [kind(w) or w for w in words], kind


def brute_contaminated(docs, items, window=8, share=0.4):
    out = {}
    by_id = defaultdict(list)
    for d, t in docs:
        if d is not None:
            by_id[d].append(t)
    for item, text in items:
        theirs, plan, kind = templates(text)
        n = min(window, len(theirs))
        for d, texts in by_id.items():
            best = {}
            for t in texts:
                ours, mine, _ = templates(t)
                for p in range(len(plan) - n + 1) if n else ():
                    for q in range(len(mine) - n + 1):
                        if plan[p : p + n] == mine[q : q + n]:
                            slots = [(a, b) for a, b in zip(theirs[p : p + n], ours[q : q + n], strict=True) if kind(a)]
                            case = (any(a != b for a, b in slots), slots)
                            best[p] = min(best.get(p, case), case)
            left, right = defaultdict(set), defaultdict(set)
            for _, slots in best.values():
                for a, b in slots:
                    left[kind(a), a].add(b)
                    right[kind(a), b].add(a)
            good = [c for c in best.values() if all(len(left[kind(a), a]) == 1 and len(right[kind(a), b]) == 1 for a, b in c[1])]
            total = len(plan) - n + 1
            if good and len(good) / total >= share:
                out[d, item] = (len(good), len(good) / total, not any(c[0] for c in good))
    return out


def test_decontamination_brute(spark):
    """Against a direct version, with placeholders and slots; names that open sentences change as well."""
    rng = random.Random(8)
    names, verbs = ["Tom", "Mary", "Jo", "Anna", "Ben", "Eve"], ["has", "buys", "eats", "finds", "paints"]

    def story():
        a, b = rng.sample(names, 2)
        return " ".join(f"{rng.choice([a, b])} {rng.choice(verbs)} {rng.randrange(2, 9)} {rng.choice(['apples', 'kg', 'miles'])}." for _ in range(rng.randrange(1, 6)))

    items = [(i, story()) for i in range(15)] + [(20, None), (21, "one Two"), (22, "Tom has 5 apples. Mary has 3 apples. Tom gives Mary 2 apples, so Mary eats 1 apple.")]
    docs = [(i, f"{story()} and then {items[i % 15][1]}" if i % 3 else story()) for i in range(60)]
    docs += [(i, items[i % 15][1].replace("Tom", "Zoe").replace("Mary", "Kim").replace("3", "8")) for i in range(60, 80)]
    docs += [(90, None), (91, ""), (None, story()), (3, story()), (92, "Bob has 5 apples. Anna has 4 apples. Bob gives Anna 2 apples, so Anna eats 1 apple."), (93, "a one Two b"), (94, " ".join(["word"] * 30000) + " " + items[0][1])]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_windows, r.share, r.exact) for r in got} == want
    assert not want[92, 22][2] and want[93, 21][2] and (94, 0) in want


def test_near_duplicates_are_verified(spark, monkeypatch):
    """Similarity decides, in blocks of a group too; nulls, blanks, repeated ids and clashing columns have their defined results."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:290])), (3, " ".join(base + [rng.choice(words) for _ in range(120)]))]
    for i in range(40):
        own = list(base)
        own[7 * i] = f"other{i}"
        rows.append((10 + i, "  ".join(own)))
    rows += [(60, None), (61, " \n"), (62, ""), (None, " ".join(base)), (63, "one two"), (64, "One two"), (1, " ".join(base))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, w int")
    want = {1: 1, 2: 1, **{10 + i: 1 for i in range(40)}, 60: 60, 61: 60, 62: 60, 63: 63, 64: 63}
    for sets in (2000, 10):
        monkeypatch.setattr(simhash, "SETS", sets)
        assert {r.doc_id: r.keep_id for r in simhash.near_duplicates(df).collect()} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
