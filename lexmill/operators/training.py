"""Vocabulary training.

What grows with the corpus stays in Spark: words, pairs, substrings, expected
and actual uses of tokens. The driver holds what grows with the vocabulary
alone. All distinct words count; none is left out.

Merges are learned in rounds. The driver proposes the next merges, guided by
what they would do to the HEAD most frequent words; Spark replays them over
all words and returns by how much each step changes each pair's count. The
driver then follows the steps with exact counts for as long as each proposed
merge is indeed the best one. So the result is that of merging one by one,
whatever was proposed, but a round settles many merges.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, pretok
from .models import Vocab
from .stored import stored


def word_counts(docs: DataFrame, scheme: str = "cl100k", avoid: list[str] = ()) -> DataFrame:
    """(word, n) of pieces; none that holds a pattern of avoid."""
    w = docs.select(F.explode(pretok.pieces(F.col("text"), scheme)).alias("word"))
    for p in avoid:
        w = w.filter(~F.contains("word", F.lit(p)))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n): adjacent bytes, weighted by the words' counts."""
    ids = F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit(".."), F.lit(0))
    pairs = words.select("n", ids.alias("b")).filter(F.size("b") > 1).select("n", F.explode(F.arrays_zip(F.slice("b", 1, F.size("b") - 1).alias("left"), F.expr("slice(b, 2, size(b) - 1)").alias("right"))).alias("p"))
    return pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))


def substrings(words: DataFrame, longest: int) -> DataFrame:
    """(piece, n): substrings of 2 to longest characters, weighted."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    cut = at.select("word", "n", "i", F.explode(F.sequence(F.lit(2), F.lit(longest))).alias("k")).filter(F.col("i") + F.col("k") - 1 <= F.length("word"))
    return cut.groupBy(F.expr("substring(word, i, k)").alias("piece")).agg(F.sum("n").alias("n"))


def seed(words: DataFrame, longest: int, k: int) -> DataFrame:
    """The k best substrings: by count times length, then length, then bytes."""
    s = substrings(words, longest)
    return s.orderBy((F.col("n") * F.length("piece")).desc(), F.length("piece").desc(), "piece").limit(k)


#: Most frequent words that proposals are made from. They only decide how many merges a round settles.
HEAD = 3000
#: Merges that a round proposes.
ROUND = 64
#: A step of a plan that lets merges cross bounds.
LIFT = (-1, -1, -1)


class Sequences:
    """Weighted sequences of token ids in one array. Tokens of a line are neighbours; tokens of a line's piece are so before bounds are lifted."""

    def __init__(self, words: list[bytes], weights: list[int], cuts: list[list[int]] | None = None, marked: bool = False):
        sizes = np.array([len(w) for w in words], np.int64)
        self.ids = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        self.line = np.repeat(np.arange(len(words)), sizes)
        self.weight = np.asarray(weights, np.int64)
        first = np.cumsum(sizes) - sizes
        heads = np.zeros(len(self.ids) + 1, np.int64)
        heads[first] = 1
        if cuts is not None:
            for at, own in zip(first.tolist(), cuts, strict=True):
                heads[[at + c for c in own]] = 1
        self.piece = np.cumsum(heads[:-1])
        self.lifted = cuts is None
        if marked:  # bytes that don't open their word are tokens of their own
            inner = np.ones(len(self.ids), bool)
            inner[first[sizes > 0]] = False
            self.ids += 256 * inner

    def copy(self) -> Sequences:
        other = Sequences([], [])
        other.__dict__ = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return other

    def pairs(self, only: np.ndarray | None = None) -> Counter:
        """Counts of neighbours, as left << 32 | right, and of single tokens, as -1 - id; of the lines only."""
        part = slice(None) if only is None else only[self.line]
        ids, line, group = self.ids[part], self.line[part], (self.line if self.lifted else self.piece)[part]
        near = np.flatnonzero(group[1:] == group[:-1])
        keys = np.concatenate([ids[near] << 32 | ids[near + 1], -1 - ids])
        weight = self.weight[np.concatenate([line[near], line])]
        kinds, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, at, weight)
        return Counter(dict(zip(kinds.tolist(), total.tolist(), strict=True)))

    def around(self, at: np.ndarray, width: int, group: np.ndarray) -> Counter:
        """pairs() of the tokens at some places and the width - 1 behind each alone, with what stands on either side."""
        places = at if width == 1 else np.stack([at + k for k in range(width)], axis=1).ravel()
        left = np.stack([at + k for k in range(-1, width)], axis=1).ravel()
        left = left[(left >= 0) & (left + 1 < len(self.ids))]
        left = left[np.concatenate([[True], left[1:] > np.maximum.accumulate(left)[:-1]])] if len(left) else left  # neighbours share a pair
        left = left[group[left] == group[left + 1]]
        keys = np.concatenate([self.ids[left] << 32 | self.ids[left + 1], -1 - self.ids[places]])
        kinds, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, where, self.weight[self.line[np.concatenate([left, places])]])
        return Counter(dict(zip(kinds.tolist(), total.tolist(), strict=True)))

    def step(self, left: int, right: int, new: int, count: bool = True) -> Counter:
        """Merge left and right to new, from the left; by how much counts change."""
        if (left, right, new) == LIFT:
            before = self.pairs() if count else Counter()
            self.lifted = True
            after = self.pairs() if count else Counter()
        else:
            group = self.line if self.lifted else self.piece
            hit = np.flatnonzero(self.ids[:-1] == left)
            hit = hit[(self.ids[hit + 1] == right) & (group[hit] == group[hit + 1])]
            if not len(hit):
                return Counter()
            if left == right:  # of a run of hits that overlap every second one counts
                new_run = np.concatenate([[True], np.diff(hit) != 1])
                start = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            before = self.around(hit, 2, group) if count else Counter()
            self.ids[hit] = new
            keep = np.ones(len(self.ids), bool)
            keep[hit + 1] = False
            self.ids, self.line, self.piece = self.ids[keep], self.line[keep], self.piece[keep]
            after = self.around(hit - np.arange(len(hit)), 1, self.line if self.lifted else self.piece) if count else Counter()
        after.subtract(before)
        return Counter({k: v for k, v in after.items() if v})


class BestPair:
    """The most frequent pair; of equals the one with the lower left, then right id. Pairs that would make a token with a pattern of avoid are barred."""

    marked = False

    def __init__(self, avoid: list[bytes] = ()):
        self.avoid = avoid

    def start(self, seen: set[int]) -> list[bytes]:
        return [bytes([b]) for b in range(256)]

    def made(self, a: bytes, b: bytes) -> bytes:
        return a + b

    def __call__(self, counts: Counter, tokens: dict[int, bytes]) -> tuple[int, int] | None:
        best = None
        for key, n in counts.items():
            if key >= 0 and n > 0 and (best is None or (-n, key) < best):
                if self.avoid and any(a in tokens[key >> 32] + tokens[key & 0xFFFFFFFF] for a in self.avoid):
                    continue
                best = (-n, key)
        return best and (best[1] >> 32, best[1] & 0xFFFFFFFF)


class BestScore:
    """The pair with the highest count over the product of its tokens' counts; of equals the rarer pair, then by left and right token. Bytes inside a word have ids from 256 on and a mark."""

    marked = True

    def made(self, a: bytes, b: bytes) -> bytes:
        return a + b[2:]

    def __call__(self, counts: Counter, tokens: dict[int, bytes]) -> tuple[int, int] | None:
        best = None
        for key, n in counts.items():
            if key >= 0 and n > 0:
                a, b = key >> 32, key & 0xFFFFFFFF
                d = counts[-1 - a] * counts[-1 - b]
                if best is None or n * best[1] > best[0] * d or n * best[1] == best[0] * d and (n, tokens[a], tokens[b]) < (best[0], tokens[best[2][0]], tokens[best[2][1]]):
                    best = (n, d, (a, b))
        return best and best[2]


#: Bytes of words that are replayed together.
REPLAYED = 1 << 20


def word_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch of words, about REPLAYED bytes of them at a time."""
    total, lo = np.cumsum(batch["word"].map(len).to_numpy(np.int64)), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + REPLAYED, side="right")))
        yield batch.iloc[lo:hi]
        lo = hi


def step_counts(words: DataFrame, plan: list[tuple[int, int, int]], settled: int, bound: str | None, marked: bool) -> list[Counter]:
    """By how much each step of the plan from settled on changes the counts over all words (word binary, n); with settled -1, the counts before the first step. The rows that come back are bounded by the vocabulary: tokens and pairs of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in word_parts(whole)):
            own = [bytes(w) for w in b["word"]]
            seq = Sequences(own, b["n"].tolist(), bound and cuts_of(own, bound), marked)
            found = [(-1, seq.pairs())] if settled < 0 else []
            found += [(i, seq.step(*p, count=i >= settled)) for i, p in enumerate(plan)]
            rows = [(i, k, n) for i, c in found for k, n in c.items() if i >= settled]
            yield pd.DataFrame(rows, columns=["i", "k", "n"]).astype({"i": "int32", "k": "int64", "n": "int64"})

    sums = words.select("word", "n").mapInPandas(run, "i int, k long, n long").groupBy("i", "k").agg(F.sum("n").alias("n")).filter("n <> 0")
    out = [Counter() for _ in range(len(plan) - settled)]
    for r in sums.collect():
        out[r.i - settled][r.k] = r.n
    return out


def cuts_of(lines: list[bytes], bound: str) -> list[list[int]]:
    """Where pieces begin inside lines: before each bound character."""
    return [[i for i, c in enumerate(w) if i and c == ord(bound)] for w in lines]


def merges(words: DataFrame, rule: BestPair | BestScore, size: Callable[[dict[int, bytes]], bool], bound: str | None = None, lift_at: int | None = None, first: dict[int, bytes] | None = None, progress: Callable[[int], None] | None = None, batch: int | None = None) -> dict[int, bytes]:
    """Tokens by id, learned over all of words (word binary, n), starting from first, until size(tokens) or no pair is left.

    Merges that cross bound come once lift_at tokens are learned, or when no other pair is left.
    """
    words = words.select(F.col("word").cast("binary").alias("word"), F.col("n").cast("long").alias("n"))
    # each round reads all words again: they are worked out once, and dealt to all cores however few bytes they are
    words = stored(words.repartition(2 * words.sparkSession.sparkContext.defaultParallelism), "words")
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    heads = [bytes(r.word) for r in top]
    head = Sequences(heads, [r.n for r in top], bound and cuts_of(heads, bound), rule.marked)
    tokens = dict(first or {i: bytes([i]) for i in range(256)})
    ids = {t: i for i, t in tokens.items()}
    plan: list[tuple[int, int, int]] = []
    lifted = bound is None
    counts = step_counts(words, [], -1, bound, rule.marked)[0]

    def following(counts: Counter, tokens: dict[int, bytes], ids: dict[bytes, int], lifted: bool) -> tuple[int, int, int] | None:
        if not lifted and lift_at is not None and len(tokens) >= lift_at:
            return LIFT
        pair = rule(counts, tokens)
        if pair is None:
            return None if lifted else LIFT
        made = rule.made(tokens[pair[0]], tokens[pair[1]])
        return (*pair, ids.get(made, max(tokens) + 1) if rule.marked else max(tokens) + 1)

    def take(step: tuple[int, int, int], change: Counter, counts: Counter, tokens: dict[int, bytes], ids: dict[bytes, int]) -> None:
        counts.update(change)
        if step != LIFT and step[2] not in tokens:
            tokens[step[2]] = rule.made(tokens[step[0]], tokens[step[1]])
            ids.setdefault(tokens[step[2]], step[2])

    while not size(tokens):
        guess, ahead, names, places, crossed = counts.copy(), head.copy(), dict(tokens), dict(ids), lifted
        steps = []
        while len(steps) < (batch or ROUND) and not size(names) and (step := following(guess, names, places, crossed)):
            steps.append(step)
            take(step, ahead.step(*step), guess, names, places)
            crossed |= step == LIFT
        if not steps:
            break
        for step, change in zip(steps, step_counts(words, plan + steps, len(plan), bound, rule.marked), strict=True):
            if following(counts, tokens, ids, lifted) != step:
                break
            take(step, change, counts, tokens, ids)
            head.step(*step, count=False)
            plan.append(step)
            lifted |= step == LIFT
        if progress:
            progress(len(tokens))
    return tokens


def learn_bpe(words: DataFrame, size: int, avoid: list[bytes] = (), bound: str | None = None, lift_at: int | None = None, progress: Callable[[int], None] | None = None) -> Vocab:
    """256 bytes, then the most frequent pair (ties: the lower left, then right id) merged left to right until size or no pair is left.

    Merges don't cross bound characters until lift_at tokens are learned, or until no other pair is left.
    """
    return Vocab(list(merges(words, BestPair(avoid), lambda t: len(t) >= size, bound, lift_at, progress=progress).values()))


def learn_spanning(lines: DataFrame, size: int, share: float = 0.9, bound: str = " ") -> Vocab:
    """Merges inside pieces for share of the merges, then across them; lines are hard bounds."""
    return learn_bpe(lines, size, bound=bound, lift_at=256 + int((size - 256) * share))


def learn_wordpiece(words: DataFrame, size: int) -> Vocab:
    """Seed: observed bytes in both forms. The pair with the highest count over the product of its parts' counts is joined (ties: rarer pair, left, right); what is missing from size is filled up with [PAD_n]."""
    hexes = words.select(F.explode(F.array_distinct(F.regexp_extract_all(F.hex(F.col("word").cast("binary")), F.lit(".."), F.lit(0)))).alias("h")).distinct()
    seen = sorted(int(r.h, 16) for r in hexes.collect())
    first = {b: bytes([b]) for b in range(256)} | {256 + b: b"##" + bytes([b]) for b in range(256)}
    found = merges(words, BestScore(), lambda t: len(t) - 512 + 1 + 2 * len(seen) >= size, first=first)
    vocab = [b"[UNK]", *(first[b] for b in seen), *(first[256 + b] for b in seen), *(t for i, t in found.items() if i >= 512)]
    return Vocab(vocab + [b"[PAD_%d]" % i for i in range(size - len(vocab))])


def expectations(words: DataFrame, v: Vocab) -> DataFrame:
    """(id, expected): E-step of a unigram model, forward-backward over words in Arrow batches, summed by Spark."""
    shared = words.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            total: Counter = Counter()
            for word, n in zip(b["word"], b["n"], strict=True):
                for at, p in posterior(word.encode("utf-8", "surrogatepass"), own).items():
                    total[at] += p * n
            yield pd.DataFrame({"id": list(total), "p": list(total.values())}, columns=["id", "p"])

    return words.select("word", "n").mapInPandas(run, "id long, p double").groupBy("id").agg(F.sum("p").alias("expected"))


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def posterior(word: bytes, v: Vocab) -> dict[int, float]:
    """Expected uses of each token in a word."""
    n = len(word)
    edges = [(i, i + k, at) for i in range(n) for k in range(1, min(v.longest, n - i) + 1) if (at := v.by_bytes.get(word[i : i + k])) is not None]
    head, tail = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, at in edges:
        head[j] = _add(head[j], head[i] + v.scores[at])
    for i, j, at in reversed(edges):
        tail[i] = _add(tail[i], tail[j] + v.scores[at])
    out: dict[int, float] = defaultdict(float)
    if head[n] > -math.inf:
        for i, j, at in edges:
            p = head[i] + v.scores[at] + tail[j] - head[n]
            if p > -60:
                out[at] += math.exp(p)
    return out


def maximized(expected: DataFrame, pinned: int = 256) -> DataFrame:
    """(id, score): M-step. Ids under pinned are raised to 0.5, others under 0.5 go; scores are log shares."""
    kept = expected.withColumn("e", F.when(F.col("id") < pinned, F.greatest("expected", F.lit(0.5))).otherwise(F.col("expected"))).filter("e >= 0.5")
    return kept.crossJoin(kept.agg(F.sum("e").alias("s"))).select("id", F.log(F.col("e") / F.col("s")).alias("score"))


def learn_unigram(words: DataFrame, size: int, longest: int = 6, start: int = 2000, shrink: float = 0.75, rounds: int = 32) -> Vocab:
    """Seed substrings, then EM and pruning of the lowest scores by turns until size; bytes stay."""
    pieces = [r.piece.encode("utf-8", "surrogatepass") for r in seed(words, longest, start).collect()]
    tokens = [bytes([b]) for b in range(256)] + [p for p in pieces if len(p) > 1]
    v = Vocab(tokens, scores=[-math.log(len(tokens))] * len(tokens))
    for _ in range(rounds):
        score = {r.id: r.score for r in maximized(expectations(words, v)).collect()}
        low = min(score.values(), default=0.0)
        keep = sorted((i for i in range(256, len(v.tokens)) if i in score), key=lambda i: (-score[i], i))
        keep = keep[: max(size - 256, int(len(keep) * shrink) if len(v.tokens) > size else len(keep))]
        ids = [*range(256), *keep]
        done = len(v.tokens) <= size
        v = Vocab([v.tokens[i] for i in ids], scores=[score.get(i, low) for i in ids])
        if done:
            break
    return v


def uses(words: DataFrame, kernel: Callable[[bytes, int], Iterator[tuple[int, int]]]) -> Counter:
    """Sum over all words (word, n) of what kernel says of each token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()  # as long as the vocabulary
        for b in batches:
            for w, n in zip(b["word"], b["n"], strict=True):
                for at, x in kernel(bytes(w), n):
                    total[at] += x
        yield pd.DataFrame({"id": list(total), "x": list(total.values())}).astype("int64")

    rows = words.select(F.col("word").cast("binary").alias("word"), "n").mapInPandas(run, "id long, x long")
    return Counter({r.id: r.x for r in rows.groupBy("id").agg(F.sum("x").alias("x")).collect()})


def usage(words: DataFrame, v: Vocab, kernel: Callable = models.fewest) -> Counter:
    return uses(words, lambda w, n: ((at, n) for at in kernel(w, v)))


def without(v: Vocab, ids: set[int]) -> Vocab:
    return Vocab([t for i, t in enumerate(v.tokens) if i not in ids])


def distill(words: DataFrame, v: Vocab, size: int, fraction: float = 0.1) -> Vocab:
    """Drop the tokens whose uses times what their bytes would cost otherwise, less one, are least, a fraction a round, until size."""
    while len(v.tokens) > size:
        used = usage(words, v, models.ungreedy)
        value = []
        for i, t in enumerate(v.tokens):
            if len(t) > 1:
                alone = Vocab([x for x in v.tokens if x != t and len(x) < len(t) and x in t])
                value.append((used[i] * (len(models.fewest(t, alone)) - 1), -len(t), i))
        drop = max(1, min(len(v.tokens) - size, int(len(value) * fraction)))
        v = without(v, {i for *_, i in sorted(value)[:drop]})
    return v


def losses(word: bytes, n: int, v: Vocab) -> Iterator[tuple[int, int]]:
    """For each token of the shortest segmentation, by how much the word gets longer without it, times n."""
    ids = models.fewest(word, v)
    for at in set(ids):
        t = v.tokens[at]
        if len(t) > 1:
            del v.by_bytes[t]
            yield at, (len(models.fewest(word, v)) - len(ids)) * n
            v.by_bytes[t] = at


def path_pieces(words: DataFrame, v: Vocab, size: int, batch: int = 16) -> Vocab:
    """Shortest segmentations; the tokens whose loss makes the words least longer go first, batch by batch, then the rest are ordered by use."""
    while len(v.tokens) > size:
        loss = uses(words, lambda w, n, v=v: losses(w, n, v))
        order = sorted((loss[i], i) for i, t in enumerate(v.tokens) if len(t) > 1)
        v = without(v, {i for _, i in order[: min(batch, len(v.tokens) - size)]})
    used = usage(words, v)
    order = sorted((i for i in range(len(v.tokens)) if len(v.tokens[i]) > 1), key=lambda i: (-used[i], i))
    return Vocab([t for t in v.tokens if len(t) == 1] + [v.tokens[i] for i in order])


def chunk_costs(docs: DataFrame, v: Vocab, words_of: Callable[[bytes], list[bytes]], chunk: int) -> DataFrame:
    """(size, cost, words) of the chunks of docs (text): bytes, tokens of v, and pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}

        def cost(w: bytes) -> int:
            if (n := known.get(w)) is None:
                if len(known) > 1 << 16:
                    known.clear()
                n = known[w] = len(models.bpe(w, v))
            return n

        for b in batches:
            rows = []
            for t in b["text"]:
                raw = (t or "").encode("utf-8", "surrogatepass")
                for i in range(0, len(raw), chunk):
                    own = words_of(raw[i : i + chunk])
                    rows.append((len(raw[i : i + chunk]), max(1, sum(map(cost, own))), own))
            yield pd.DataFrame(rows, columns=["size", "cost", "words"])

    return docs.select("text").mapInPandas(run, "size int, cost int, words array<binary>")


def adapt(docs: DataFrame, v: Vocab, words_of: Callable[[bytes], list[bytes]], add: int, chunk: int = 256) -> tuple[list[bytes], dict[str, float]]:
    """Up to add tokens for a domain, learned on the chunks of docs (text) that v takes most tokens for (bytes a token at the median or under), less what v has; and a report.

    There are at most chunk * chunk kinds of (size, cost), so the median is exact.
    """
    chunks = chunk_costs(docs, v, words_of, chunk)
    kinds = sorted((r["size"] / r.cost, r.n) for r in chunks.groupBy("size", "cost").agg(F.count("*").alias("n")).collect())
    total, at, middle = sum(n for _, n in kinds), 0, 0.0
    for ratio, n in kinds:
        at += n
        if at > total // 2:
            middle = ratio
            break
    hard = chunks.filter(F.col("size") / F.col("cost") <= middle).select(F.explode("words").alias("word"))
    learned = learn_bpe(hard.groupBy("word").agg(F.count("*").alias("n")), 256 + 2 * add)
    new = [t for t in learned.tokens[256:] if t not in v.by_bytes][:add]
    return new, {"chunks": total, "median_bytes_per_token": middle, "added": len(new)}
