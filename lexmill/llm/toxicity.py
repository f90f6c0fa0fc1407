"""Toxicity scores from subword-bag embeddings.

A word is the average of the embeddings of its character n-grams (hashed into
a fixed number of buckets), a passage is the average of its words, and a
linear softmax tells the classes apart; embeddings and softmax are trained
jointly, in numpy. So a misspelling that was never seen still shares
most of its n-grams with the word it stands for. A text is scored by its
worst passage of some tens of words, so that a long text can't hide one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, documents

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 4
    shortest: int = 3
    longest: int = 5
    passage: int = 8
    rounds: int = 60
    rate: float = 0.1
    decay: float = 1e-3
    #: Of the words that only one text of the sample has, one in so many is trained on; the others only count as words.
    rare_words: int = 4
    #: The training sample: so many toxic rows at most, and so many others for each toxic one.
    toxic_rows: int = 1000
    clean_for_each: int = 4
    #: Of a text of the sample, so many characters at most: those at its beginning and its end.
    sample_chars: int = 1 << 18


def grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs of many words at once: of each word itself and of its character n-grams, the ends marked."""
    parts = [f"<{w.strip(EDGES) or w}>" for w in words]
    sizes = np.array([len(p) for p in parts])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(code))  # characters from here to the word's end
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=1)), P, np.uint64))
        whole = np.add.reduceat(code * powers[left - 1], starts)
        found = [(np.arange(len(words)), _bucket(whole, s.buckets))]
        h = code
        for n in range(2, s.longest + 1):
            h = h[:-1] * P + code[n - 1 :]
            if n >= s.shortest:
                at = np.flatnonzero(left[: len(h)] >= n)
                found.append((own[at], _bucket(h[at] + np.uint64(n), s.buckets)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


P = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


#: Entries that are gathered at a time in training.
TOGETHER = 1 << 20


def _sums(values: np.ndarray, index: np.ndarray, starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of values[index] (times weights) over the runs that begin at starts, some runs at a time."""
    out = np.empty((len(starts), values.shape[1]), values.dtype)
    ends = np.append(starts[1:], len(index))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + TOGETHER, side="right")))
        at = slice(starts[lo], ends[hi - 1])
        part = values[index[at]]
        if weights is not None:
            part *= weights[at, None]
        out[lo:hi] = np.add.reduceat(part, starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return out


def _turned(index: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of index turned round, by what they index: targets, their starts, and the runs and weights in that order."""
    order = np.argsort(index, kind="stable").astype(np.int32)
    to = index[order]
    starts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1])
    run = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    return to[starts], starts, run, (1 / sizes).astype(np.float32)[run]


def train(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weight of each bucket in the logit of class 1, and the bias."""
    words: dict[str, int] = {"": 0}
    seen: dict[str, int] = {}
    for d, text in enumerate(texts):
        for w in text.lower().split():
            if seen.setdefault(w, d) != d or zlib.crc32(w.encode("utf-8", "surrogatepass")) % s.rare_words == 0:
                words.setdefault(w, len(words))
    tokens, sizes, owner = [], [], []
    for d, text in enumerate(texts):
        own = text.lower().split()
        for i in range(0, len(own), s.passage):
            part = own[i : i + s.passage]
            tokens += [words.get(w, 0) for w in part]
            sizes.append(len(part))
            owner.append(d)
    if not sizes or len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
        return np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share)))
    tokens, sizes, owner = np.asarray(tokens, np.int32), np.asarray(sizes), np.asarray(owner)
    token_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, parts = list(words)[1:], []
    for i in range(0, len(names), 20_000):
        own, bucket = grams(names[i : i + 20_000], s)
        order = np.argsort(own, kind="stable")
        parts.append((np.bincount(own, minlength=min(20_000, len(names) - i)), bucket[order].astype(np.int32)))
    # the words left out, word 0, have a bucket of their own
    gram_sizes = np.concatenate([[1], *(n for n, _ in parts)])
    gram_index = np.concatenate([np.array([s.buckets], np.int32), *(x for _, x in parts)])
    gram_starts = np.cumsum(gram_sizes) - gram_sizes
    used, gram_index = np.unique(gram_index, return_inverse=True)
    gram_index = gram_index.astype(np.int32)
    word_back, gram_back = _turned(tokens, sizes), _turned(gram_index, gram_sizes)

    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.1, (len(used), s.dim)).astype(np.float32), rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    target = labels[owner].astype(np.float32)
    firsts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    runs = np.repeat(np.arange(len(firsts)), np.diff(np.concatenate([firsts, [len(owner)]])))
    for step in range(s.rounds):
        e, u, b = params
        wordvec = _sums(e, gram_index, gram_starts) / gram_sizes[:, None].astype(np.float32)
        mean = _sums(wordvec, tokens, token_starts) / sizes[:, None].astype(np.float32)
        logits = mean @ u + b
        p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        weight = np.ones(len(p), np.float32)
        if step >= s.rounds // 3:  # from here on only the worst passage of a text with label 1 counts as such
            worst = np.maximum.reduceat(p, firsts)[runs]
            weight[(target == 1) & (p < worst)] = 0
        weight /= np.bincount(owner, weights=weight)[owner]  # each text counts once
        weight = np.where(target == 0, np.maximum(weight, 0.2), weight)
        g = (weight * (p - target) / len(firsts)).astype(np.float32)
        dlogits = np.stack([-g, g], axis=1)
        dmean = dlogits @ u.T
        dword = np.zeros_like(wordvec)
        to, starts, run, w = word_back
        dword[to] = _sums(dmean, run, starts, w)
        de = np.zeros_like(e)
        to, starts, run, w = gram_back
        de[to] = _sums(dword, run, starts, w)
        for q, d, (m, v) in zip(params, (de, mean.T @ dlogits, dlogits.sum(0)), moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= s.rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8) + s.rate * s.decay * q
    e, u, b = params
    weights = np.zeros(s.buckets, np.float32)
    weights[used[:-1]] = (e @ (u[:, 1] - u[:, 0]))[:-1]
    return weights, float(b[1] - b[0])


class Scorer:
    """Scores of texts. Word weights are kept for up to limit words."""

    def __init__(self, weights: np.ndarray, bias: float, s: Settings, limit: int = 600_000):
        self.weights, self.bias, self.s, self.limit = weights, bias, s, limit
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        if words:
            own, bucket = grams(words, self.s)
            self.known.update(zip(words, (np.bincount(own, weights=self.weights[bucket]) / np.bincount(own)).tolist(), strict=True))

    def word(self, w: str) -> float:
        self.learn([w])
        return self.known[w]

    def __call__(self, texts: list[str | None], together: int = 100_000) -> list[float]:
        out, held, size = [], [], 0
        for text in texts:
            held.append((text or "").lower().split())
            size += len(held[-1])
            if size >= together:
                out += self._score(held)
                held, size = [], 0
        return out + self._score(held)

    def _score(self, held: list[list[str]]) -> list[float]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        self.learn(list({w for words in held for w in words if w not in known}))
        logits = []
        for words in held:
            if not words:
                logits.append(self.bias)
                continue
            total = np.zeros(len(words) + 1)
            np.cumsum([known[w] for w in words], out=total[1:])
            n = min(self.s.passage, len(words))
            at = np.append(np.arange(0, len(words) - n + 1, max(1, n // 4)), len(words) - n)
            logits.append(((total[at + n] - total[at]) / n).max() + self.bias)
        return (1 / (1 + np.exp(np.clip(-np.array(logits, dtype=float), -30, 30)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Train on a bounded sample: for each class the labelled ids with the smallest hash. Ids are drawn before any text is read, so no text is shuffled but the sample's. The task that trains holds the sample; the driver gets one number for each bucket."""
    ids = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    draw = F.xxhash64("id", F.lit(3))
    sample = ids.filter("y = 1").orderBy(draw, "id").limit(settings.toxic_rows).unionByName(ids.filter("y = 0").orderBy(draw, "id").limit(settings.toxic_rows * settings.clean_for_each))
    half = settings.sample_chars // 2
    part = F.when(F.length("t") > 2 * half, F.concat(F.substring("t", 1, half), F.lit(" "), F.substring("t", -half, half))).otherwise(F.col("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id").filter("t IS NOT NULL").select("y", part.alias("t")).repartition(1).sortWithinPartitions(F.xxhash64("t", F.lit(3)), "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for b in batches:
            texts += b["t"].tolist()
            labels += b["y"].tolist()
        y = np.asarray(labels, np.int64)
        rank = np.zeros(len(y), np.int64)
        for c in (0, 1):
            rank[y == c] = np.arange((y == c).sum())
        keep = np.flatnonzero((y == 1) | (rank < settings.clean_for_each * max(1, (y == 1).sum())))
        weights, bias = train([texts[i] for i in keep], y[keep], settings)
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    got = rows.mapInPandas(run, "weights binary, bias double").first()
    if got is None:
        return np.zeros(settings.buckets, np.float32), -5.0
    return np.frombuffer(got.weights, np.float32), got.bias


def toxicity(df: DataFrame, docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """df with score and predicted added, learned from the texts of docs that labels (id, label) covers.

    A bounded sample is learned from (Settings.toxic_rows, clean_for_each and
    sample_chars; of words that one text of it has alone, one in rare_words); every text of df is scored whole. A null or blank text has no words and gets
    the score of the bias alone. With no labelled rows, or one class only, all
    texts get one score. Labels other than 0 and 1 are passed over; of several
    labels of an id the largest counts. Columns score and predicted of df itself
    are replaced; repeated rows stay repeated.
    """
    spark = df.sparkSession
    weights, bias = fit(docs, labels, settings, id_col, text_col, label_col)
    shared = spark.sparkContext.broadcast(weights)  # four bytes a bucket

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = Scorer(shared.value, bias, settings)
        for b in batches:
            yield pd.Series(ask(b.tolist()), dtype="float64")

    return df.drop("score", "predicted").withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc_fold(F.col("doc_id")) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, docs.filter(~held), labels.filter(~held)).select("doc_id", held.alias("held_out"), "score", "predicted")
