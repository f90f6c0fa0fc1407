"""Pure kernels against golden values, direct versions and invariants."""

from __future__ import annotations

import json
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as N
from lexmill.operators import analytics, chat, encode, models, packing, pretok, training
from lexmill.sources import readers, writers
from lexmill.streaming import encoder

V = models.LITERAL


def slow_merge(parts, ranks):
    parts = list(parts)
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.text(alphabet="thein gradls", max_size=40))
def test_models_agree_and_decode(t):
    b = t.encode()
    assert models.merge_parts([b[i : i + 1] for i in range(len(b))], V.ranks) == slow_merge([b[i : i + 1] for i in range(len(b))], V.ranks)
    for f in (models.bpe, models.longest_match, models.fewest, models.ungreedy, models.strict_match, models.char_bpe):
        assert models.decode(f(b, V), V) == b
    assert len(models.fewest(b, V)) <= min(len(models.bpe(b, V)), len(models.longest_match(b, V)))
    u = models.Vocab(V.tokens, scores=[-8.0] * 256 + [-2.0 - 0.1 * i for i in range(20)])
    best = sum(u.scores[i] for i in models.viterbi(b, u))
    assert models.decode(models.viterbi(b, u), u) == b
    assert models.decode(models.sampled(b, u, 0.5, 3), u) == b
    assert best >= sum(u.scores[i] for i in models.longest_match(b, u)) - 1e-9
    graph = models.merge_graph(V, [(V.by_bytes[a], V.by_bytes[c]) for a, c in writers.rank_merges(V)])
    assert models.decode(models.graph_bpe(b, V, graph), V) == b


@settings(max_examples=300)
@given(st.text(max_size=30))
def test_text_roundtrips(t):
    t = t.encode("utf-8", "replace").decode()
    if not set(t) & {N.CAP, N.WORD, N.DEL, "\x7f"}:
        assert N.uncaps_text(N.caps_text(t)) == t
        assert N.unspaced_text(N.spaced_text(t)) == t
    assert N.from_byte_level(N.to_byte_level(t)) == t


def test_bert_and_charsmap():
    assert N.bert_text("Héllo\u0000\tWörld 東京") == "hello world  東  京 "
    assert N.bert_text("Hé", lower=False) == "Hé"
    assert N.charsmap_text("then", {"th": "1", "the": "2"}) == "2n"


def test_origin_projection():
    out, origin = N.with_origin(lambda s: s.upper(), "aßb")
    assert out == "ASSB" and origin == [0, 1, 1, 3]
    assert N.project_span(origin, 1, 3, 4) == (1, 3)


def test_machine_code():
    assert [r[1:] for r in N.routes(bytes.fromhex("b801000000e80000000074059048c7c001000000c3"))] == [(5, "move", "immediate"), (5, "call", "relative"), (2, "branch", "relative"), (1, "nop", "none"), (7, "move", "immediate"), (1, "return", "none")]
    assert N.routes(b"\x0f") == [(0, 1, "unknown", "none")]


GOLDEN = {
    "cl100k": [("It's a test", ["It", "'s", " a", " test"]), ("12345", ["123", "45"]), ("   trailing", ["  ", " trailing"]), ("  \n  word", ["  \n", " ", " word"]), ("IT'S", ["IT", "'S"]), ("hi !!", ["hi", " !!"]), ("hi   ", ["hi", "   "]), ("café", ["café"])],
    "o200k": [("fooBar", ["foo", "Bar"]), ("HELLOworld", ["HELLOworld"]), ("they'll", ["they'll"]), ("123456789", ["123", "456", "789"]), ("a//b", ["a", "//", "b"])],
    "tekken": [("CamelCaseWord", ["Camel", "Case", "Word"]), ("hello123world", ["hello", "1", "2", "3", "world"]), ("abc/def//", ["abc", "/def", "//"])],
    "whitespace": [("a, b!!", ["a", ",", "b", "!", "!"])],
}


@pytest.mark.parametrize("scheme", GOLDEN)
def test_golden_pieces(spark, scheme):
    df = spark.createDataFrame(GOLDEN[scheme], "text string, want array<string>")
    for r in df.select("text", "want", pretok.pieces(F.col("text"), scheme).alias("got")).collect():
        assert r.got == r.want, r.text


def test_split_behaviours():
    want = {"removed": ["a", "b", "c"], "isolated": ["a", ",", ",", "b", ",", "c"], "contiguous": ["a", ",,", "b", ",", "c"], "merged_with_previous": ["a,", ",", "b,", "c"], "merged_with_next": ["a", ",", ",b", ",c"]}
    for k, v in want.items():
        assert pretok.split_text("a,,b,c", ",", k) == v
    assert pretok.split_text("ab12", r"\d", "removed", invert=True) == ["1", "2"]


def test_windows(spark):
    df = spark.range(1)
    got = lambda n, *a: [tuple(w) for w in df.select(packing.token_windows(F.lit(n), *a).alias("w")).first().w]
    assert got(10, 4) == [(0, 4), (4, 8), (8, 10)]
    assert got(10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert got(0, 4) == [] and got(3, 4) == [(0, 3)]
    for bad in ((0, 0), (4, 4)):
        with pytest.raises(ValueError):
            packing.token_windows(F.lit(1), *bad)


def test_packing(spark):
    docs = spark.createDataFrame([(0, [104, 105])], "doc_id long, ids array<long>")
    assert packing.pack(docs, "ids", 4, 1, 2).first().ids == [1, 104, 105, 2]
    five = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3, 4, 5])], "doc_id long, ids array<long>")
    assert sorted(r.ids for r in packing.pack(five, "ids", 2).collect()) == [[1, 2], [3, 4]]
    assert [r.ids for r in packing.pack(five, "ids", 2, pad=7).orderBy("seq").collect()] == [[1, 2], [3, 4], [5, 7]]


def test_sentences():
    text = "Dr. Smith paid 3.50 today. He left! Did he? 東京。次"
    ends = [i for i in range(1, len(text)) if packing.sentence_end(text, i)]
    cut = [text[:i].rstrip()[-6:] for i in ends]
    assert "today." in cut and " left!" in cut and not any(c.endswith("Dr.") for c in cut)
    assert packing.dictionary_words("thecatsat", {"the", "cat", "cats", "sat"}) == [3, 7, 8, 9]
    rng = random.Random(1)
    for kind in ("codepoint", "word", "paragraph", "sentence"):
        t = "".join(rng.choice("ab .\n") for _ in range(200))
        w = packing.snapped(t, 30, 0, kind)
        assert w[0][0] == 0 and w[-1][1] == len(t) and all(a < b <= a + 30 for a, b in w) and all(x[1] == y[0] for x, y in zip(w, w[1:], strict=False))


def slow_ngrams(ids, n, heads):
    m = (1 << 64) - 1

    def mix(x):
        x = x + 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    out = []
    for i in range(len(ids) - n + 1 if n > 0 else 0):
        for h in range(heads):
            x = mix(0x9E3779B97F4A7C15 ^ (h * 0x9E3779B97F4A7C15 & m)) ^ 0x9E3779B97F4A7C15
            for t in ids[i : i + n]:
                x = mix(x ^ t)
            x = mix(x ^ n)
            out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def test_ngrams(spark):
    assert slow_ngrams([1, 2], 2, 1) == [6839856135582511566]
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([7],), ([],)], "ids array<int>")
    for n, heads in ((2, 3), (1, 1), (6, 2), (0, 3), (2, 0)):
        for r in df.select("ids", analytics.ngram_hashes(F.col("ids"), n, heads).alias("h")).collect():
            assert r.h == slow_ngrams(r.ids, n, heads)


def test_fairness_and_cost(spark):
    df = spark.createDataFrame([("en", 100.0, 1000.0), ("fr", 150.0, 1000.0), ("th", 400.0, 1000.0), ("xx", 5.0, 0.0)], "lang string, tokens double, units double")
    r = analytics.fairness(df).first()
    assert r.n == 3 and abs(r["mean"] - 0.65 / 3) < 1e-12 and abs(r.max_premium - 4) < 1e-12
    r = analytics.fairness(spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 3.0, 1.0)], "lang string, tokens double, units double")).first()
    assert abs(r.gini - 8 / 36) < 1e-12
    assert spark.range(1).select(analytics.cost(F.lit(1_000_000), 0.5).alias("c")).first().c == 0.5


def test_levenshtein(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], [1, 2]), ([1], [2]), (list(range(20)), list(range(20, 40))), ([0xD7FF, 200_000, 5], [0xD7FE, 200_000, 0xDFFF]), ([0xD800, 1_000_000], [0xD800])], "a array<int>, b array<int>")
    assert [r.d for r in df.select(analytics.bounded_levenshtein(F.col("a"), F.col("b"), 5).alias("d")).collect()] == [1, 2, 1, 6, 2, 1]


def counted(spark, words):
    return spark.createDataFrame([(bytearray(w), n) for w, n in words], "word binary, n long")


def test_training_golden(spark):
    v = training.learn_bpe(counted(spark, [(b"ab", 4), (b"ac", 3), (b"bc", 2)]), 259)
    assert v.tokens[256:] == [b"ab", b"ac", b"bc"]
    assert training.learn_bpe(counted(spark, [(b"ab", 4), (b"ac", 3)]), 258, avoid=[b"ab"]).tokens[256:] == [b"ac"]
    # what spans a bound is only learned once bounds are lifted
    spanning = training.learn_bpe(counted(spark, [(b"ab cd", 5)]), 262, bound=" ", lift_at=258)
    assert spanning.tokens[256:260] == [b" c", b"ab", b" cd", b"ab cd"]
    assert training.learn_bpe(counted(spark, []), 300).tokens == [bytes([b]) for b in range(256)]


def slow_learn(words, size):
    tokens = [bytes([b]) for b in range(256)]
    seqs = [list(w) for w, _ in words]
    while len(tokens) < size:
        c = {}
        for s, (_, n) in zip(seqs, words, strict=True):
            for p in zip(s, s[1:], strict=False):
                c[p] = c.get(p, 0) + n
        if not c:
            break
        best = min(c, key=lambda p: (-c[p], p))
        tokens.append(tokens[best[0]] + tokens[best[1]])
        for s in seqs:
            k = 0
            while k + 1 < len(s):
                if (s[k], s[k + 1]) == best:
                    s[k : k + 2] = [len(tokens) - 1]
                k += 1
    return tokens


def slow_wordpiece(words, size):
    seqs = [[w[:1], *(b"##" + bytes([b]) for b in w[1:])] for w, _ in words]
    seen = sorted({b for w, _ in words for b in w})
    vocab = [b"[UNK]", *(bytes([b]) for b in seen), *(b"##" + bytes([b]) for b in seen)]
    while len(vocab) < size:
        one, two = Counter(), Counter()
        for s, (_, n) in zip(seqs, words, strict=True):
            for x in s:
                one[x] += n
            for p in zip(s, s[1:], strict=False):
                two[p] += n
        if not two:
            break
        a, b = min(two, key=lambda p: (-Fraction(two[p], one[p[0]] * one[p[1]]), two[p], p))
        if a + b[2:] not in vocab:
            vocab.append(a + b[2:])
        for s in seqs:
            k = 0
            while k + 1 < len(s):
                if (s[k], s[k + 1]) == (a, b):
                    s[k : k + 2] = [a + b[2:]]
                k += 1
    return vocab + [b"[PAD_%d]" % i for i in range(size - len(vocab))]


def test_training_is_exact(spark, monkeypatch):
    """The same as merging one by one, whatever the head of words proposes and however the words are dealt."""
    rng = random.Random(3)
    for round_ in range(4):
        words = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))).encode(), rng.randrange(1, 9)) for _ in range(40)]
        words = list(dict(words).items())
        df = counted(spark, words).repartition(1 + round_)
        monkeypatch.setattr(training, "HEAD", (3000, 0, 5, 1)[round_])
        assert training.learn_bpe(df, 280).tokens == slow_learn(words, 280)
        assert training.learn_wordpiece(df, 30).tokens == slow_wordpiece(words, 30)


def test_other_trainers(spark):
    words = [(b"lower", 5), (b"lowest", 2), (b"newer", 6), (b"wider", 3)]
    table = counted(spark, words)
    wp = training.learn_wordpiece(table, 24)
    assert len(wp.tokens) == 24 and all(models.wordpiece(w, wp) != [0] for w, _ in words)
    big = training.learn_bpe(table, 270)
    assert len(training.distill(table, big, 262, 0.3).tokens) == 262
    used = Counter()
    for w, n in words:
        for at in models.fewest(w, big):
            used[at] += n
    assert training.usage(table, big) == used
    want = Counter()
    for w, n in words:
        for at in set(models.fewest(w, big)):
            if len(big.tokens[at]) > 1:
                want[at] += n * (len(models.fewest(w, training.without(big, {at}))) - len(models.fewest(w, big)))
    assert +training.uses(table, lambda w, n: training.losses(w, n, big)) == +want
    assert len(training.path_pieces(table, big, 262, 4).tokens) == 262
    p = training.posterior(b"ab", models.Vocab([b"a", b"b", b"ab"], scores=[-1.0, -1.0, -1.0]))
    assert abs(p[2] - 1 / (1 + 2.718281828**-1)) < 1e-6 and abs(p[0] - p[1]) < 1e-12
    df = spark.createDataFrame([(w.decode(), n) for w, n in words], "word string, n long")
    assert len(training.learn_unigram(df, 260, start=30).tokens) == 260
    new, report = training.adapt(spark.createDataFrame([("zzz zzz zzz aaa",), (None,)], "text string"), V, bytes.split, 3)
    assert new and not set(new) & set(V.tokens) and report["chunks"] == 1


def test_ungreedy():
    """Cases that the score decides."""
    ids = lambda tokens, text: models.ungreedy(text, models.Vocab(tokens))
    assert ids([b"a", b"ab", b"c", b"abc"], b"abc") == [3]
    assert ids([b"<unk>", b" the", b"the", b" quick", b"quick"], b" the quick") == [1, 3]
    assert ids([b" a", b" ab", b"b c", b" cat", b"c", b"b", b"a", b"t", b" "], b" ab cat") == [1, 3]
    t = models.traits(b" the big")
    assert t.words == 2 and t.opens_space and t.closes_letter and not t.opens_letter
    assert models.pair_score(b" in", b"side", b"") == 7 + 2 + 100 - 103
    assert models.pair_score(b" a", b" b", b" ", 2) - models.pair_score(b" a", b" b", b" ") == 0


def test_formats():
    small = models.Vocab([b"a", b"b", b"c", b"ab", b"abc"])
    data = writers.ranks_text(small)
    assert readers.detect(data) == "ranks" and readers.load(data).tokens == small.tokens
    with pytest.raises(ValueError):
        readers.parse_ranks(data.replace(b" 4", b" 9"))
    j = writers.tokenizer_json(small)
    got = readers.parse_tokenizer_json(j)
    assert readers.detect(j) == "tokenizer_json" and got["vocab"].tokens == small.tokens and got["merges"] == [("a", "b"), ("ab", "c")]
    sp = models.Vocab([b"<unk>", b"a", b"b"], scores=[0.0, -1.0, -2.5])
    m = writers.piece_model(sp, [2, 1, 1])
    back = readers.parse_piece_model(m)
    assert readers.detect(m) == "piece_model" and back["vocab"].tokens == sp.tokens and back["vocab"].scores == sp.scores and back["types"] == [2, 1, 1]
    for version in (1, 2, 3):
        own = models.Vocab([b"a", b"bc", b" the", b""], unk=1)
        raw = writers.binary(own, version, "full", ["nfd", "trim"], [(1, b"BC")], [(2, b"D the", [(0, 1), (1, 2)])])
        got = readers.parse_binary(raw)
        assert raw[:4] == b"ZTM" + bytes([version]) and got["vocab"].tokens == own.tokens and got["vocab"].unk == 1 and got["capcode"] == "full" and got["normalizer"] == ["nfd", "trim"]
        assert got["aliases"] == ([(1, b"BC")] if version > 1 else []) and got["twins"] == ([(2, b"D the", [(0, 1), (1, 2)])] if version > 2 else [])
        assert readers.detect(raw) == "binary" and readers.load(raw).by_bytes.get(b"BC") == (1 if version > 1 else None)
        for cut in (3, 15, len(raw) - 1):
            with pytest.raises(ValueError):
                readers.parse_binary(raw[:cut])
    assert readers.load(b"1 'a' 1\n3 b'\\xff\\xfe' 2\n").tokens == [None, b"a", None, b"\xff\xfe"]
    tk = json.dumps({"config": {"pattern": "x", "default_vocab_size": 4, "default_num_special_tokens": 2}, "vocab": [{"rank": 1, "token_bytes": "Yg=="}, {"rank": 0, "token_bytes": "YQ=="}, {"rank": 2, "token_bytes": "Yw=="}]}).encode()
    assert readers.detect(tk) == "tekken" and readers.load(tk).tokens == [None, None, b"a", b"b"]
    assert readers.detect(b"hello there\n") == "unknown"
    assert readers.parse_tokenizer_config(b'{"bos_token": {"content": "<s>"}, "eos_token": "</s>"}')["special"] == {"bos_token": "<s>", "eos_token": "</s>"}


def test_rank_table(spark, tmp_path):
    (tmp_path / "v").write_bytes(writers.ranks_text(models.Vocab([b"a", b"b", b"ab"])))
    assert {(r.rank, r.hex) for r in readers.rank_table(spark, str(tmp_path / "v")).collect()} == {(0, "61"), (1, "62"), (2, "6162")}
    (tmp_path / "w").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        readers.rank_table(spark, str(tmp_path / "w"))


def test_chat():
    ms = [{"role": "user", "content": " hi "}, {"role": "assistant", "content": "yes"}]
    t = "{%- for m in messages -%}{% if m.role == 'user' and not loop.last %}[U]{{ m.content | trim }}{% elif m['role'] in ['assistant'] %}[A]{{ m.content.upper() }}{% else %}?{% endif %}{%- endfor %}{% set n = messages | length %}{{ n + 1 }}{{ 'x' if n > 5 else 'y' }}"
    assert chat.render(t, messages=ms) == "[U]hi[A]YES3y"
    text = chat.render(chat.CHATML, messages=ms, add_generation_prompt=False)
    assert [(m["role"], m["content"], m["partial"]) for m in chat.invert(text, "chatml")] == [("user", " hi ", False), ("assistant", "yes", False)]
    assert chat.invert(text[:-14], "chatml")[-1]["partial"]
    assert [m["role"] for m in chat.invert("<start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\nyo", "gemma")] == ["user", "assistant"]
    got = chat.invert("[INST] <<SYS>>\nbe kind\n<</SYS>>\n\nhi [/INST] yo</s>", "bracket")
    assert [(m["role"], m["content"]) for m in got] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]


def test_healing_and_wordpiece():
    v = models.Vocab([bytes([b]) for b in range(256)] + [b"world", b"ld"])
    ids = [v.by_bytes[bytes([b])] for b in b"hello wor"]
    assert models.heal(ids, v) == (ids[:-3], b"wor")
    assert models.wordpiece(b"unable", models.Vocab([b"?", b"un", b"##able"])) == [1, 2]
    assert models.wordpiece(b"unablex", models.Vocab([b"?", b"un", b"##able"])) == [0]
    assert models.decode([1, 2, 1], models.Vocab([b"?", b"un", b"##able"]), "wordpiece") == b"unable un"


def test_stream_advance():
    text = "ab\ncd\n\n ef\ngh"
    rng = random.Random(2)
    for _ in range(50):
        cuts = sorted(rng.sample(range(len(text)), 3))
        carry, out = "", []
        feeds = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        for i, f in enumerate(feeds):
            got, carry = encoder.advance(carry, [f], i == len(feeds) - 1)
            out += got
        assert "".join(out) == text and carry == ""


def test_added_tokens_and_template(spark):
    df = spark.createDataFrame([("a <s> b<s>c",)], "text string")
    assert df.select(pretok.added_token_segments(F.col("text"), [{"content": "<s>", "lstrip": True}]).alias("x")).first().x == ["a", " <s>", " b", "<s>", "c"]
    ids, types = encode.template([("special", 1, 0), ("text", "a", 0), ("special", 2, 0), ("text", "b", 1)], {"a": F.array(F.lit(7)), "b": F.array(F.lit(8), F.lit(9))})
    r = spark.range(1).select(ids.alias("i"), types.alias("t")).first()
    assert r.i == [1, 7, 2, 8, 9] and r.t == [0, 0, 0, 1, 1]
    one, two = encode.wrapped(F.array(F.lit(7)), F.array(F.lit(8)), 0, 2, doubled=True)
    r = spark.range(1).select(one.alias("i"), two.alias("t")).first()
    assert r.i == [0, 7, 2, 2, 8, 2] and r.t == [0] * 6
