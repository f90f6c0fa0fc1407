"""Subword models as pure kernels over bytes. A vocabulary is a list of byte strings; an id is a place in it."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Stands for a byte that no token covers.
NONE = (1 << 32) - 1


@dataclass
class Vocab:
    """tokens by id; ranks default to ids; scores for unigram models. Sparse ids are None."""

    tokens: list[bytes | None]
    ranks: dict[bytes, int] | None = None
    scores: list[float] | None = None
    unk: int = 0
    byte_fallback: bool = False
    prefix: bytes = b"##"
    max_word: int = 100
    by_bytes: dict[bytes, int] = field(init=False, repr=False)
    longest: int = field(init=False)
    fallback: list[int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.by_bytes = {}
        for i, t in enumerate(self.tokens):
            if t:
                self.by_bytes.setdefault(t, i)
        if self.ranks is None:
            self.ranks = self.by_bytes
        self.longest = max(map(len, self.by_bytes), default=0)
        self.fallback = [self.by_bytes.get(b"<0x%02X>" % b, self.by_bytes.get(bytes([b]), NONE)) for b in range(256)]


#: 256 bytes and twenty pieces for English, Spanish and French, small enough to be replayed in SQL.
PIECES = ["th", "the", " t", " the", "in", "ing", "er", "on", "an", "and", " a", " and", "es", "en", "de", " de", "le", " le", "la", " la"]
LITERAL = Vocab([bytes([b]) for b in range(256)] + [p.encode() for p in PIECES])


def merge_parts(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Join the adjacent pair of lowest rank, the leftmost of equals, until none is left. A heap keeps long inputs near linear."""
    n = len(parts)
    if n < 2:
        return parts
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    now: list[bytes | None] = list(parts)
    heap = [(r, i, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i] if now[i] is not None else n
        if j >= n or len(now[i]) + len(now[j]) != size:
            continue
        now[i] += now[j]
        now[j] = None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(now[i] + now[right[i]])) is not None:
                heapq.heappush(heap, (r, i, len(now[i]) + len(now[right[i]])))
        if left[i] >= 0 and (r := ranks.get(now[left[i]] + now[i])) is not None:
            heapq.heappush(heap, (r, left[i], len(now[left[i]]) + len(now[i])))
    return [x for x in now if x is not None]


def bpe(piece: bytes, v: Vocab) -> list[int]:
    """Byte-pair merges; a byte that isn't a token gets its fallback or NONE."""
    out = []
    for part in merge_parts([piece[i : i + 1] for i in range(len(piece))], v.ranks):
        at = v.by_bytes.get(part)
        out += [at] if at is not None else [v.fallback[b] if v.byte_fallback else NONE for b in part]
    return out


def bpe_whole(piece: bytes, v: Vocab) -> list[int]:
    """A piece that is a token itself is not merged."""
    at = v.by_bytes.get(piece)
    return [at] if at is not None else bpe(piece, v)


def merge_graph(v: Vocab, merges: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(left, right) to (rank, result) of an ordered list of merges."""
    return {(a, b): (rank, v.by_bytes[v.tokens[a] + v.tokens[b]]) for rank, (a, b) in reversed(list(enumerate(merges)))}


def graph_bpe(piece: bytes, v: Vocab, graph: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    ids = [v.by_bytes.get(bytes([b]), NONE) for b in piece]
    while len(ids) > 1:
        best = min(((graph[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in graph), default=None)
        if best is None:
            break
        i = best[1]
        ids[i : i + 2] = [graph[ids[i], ids[i + 1]][1]]
    return ids


def longest_match(piece: bytes, v: Vocab) -> list[int]:
    out, i = [], 0
    while i < len(piece):
        for n in range(min(v.longest, len(piece) - i), 0, -1):
            at = v.by_bytes.get(piece[i : i + n])
            if at is not None:
                out.append(at)
                i += n
                break
        else:
            out.append(v.fallback[piece[i]])
            i += 1
    return out


def strict_match(piece: bytes, v: Vocab) -> list[int]:
    """Greedy longest match over a byte vocabulary with gaps; no match is an error."""
    out = longest_match(piece, v)
    if NONE in out:
        raise ValueError("no token matches")
    return out


def fewest(piece: bytes, v: Vocab) -> list[int]:
    """As few tokens as possible; of equals the longer last token, then the lower id."""
    n = len(piece)
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for end in range(1, n + 1):
        choice = None
        for size in range(1, min(v.longest, end) + 1):
            at = v.by_bytes.get(piece[end - size : end])
            if at is None:
                if size > 1:
                    continue
                at = v.fallback[piece[end - 1]]
            key = (best[end - size][0] + 1, -size, at)
            if choice is None or key < choice:
                choice = key
        best.append(choice)
    out, end = [], n
    while end:
        out.append(best[end][2])
        end += best[end][1]
    return out[::-1]


def char_bpe(piece: bytes, v: Vocab) -> list[int]:
    """Merges that start from code points; what is no token falls back to bytes or is unknown."""
    out = []
    for part in merge_parts([c.encode("utf-8", "surrogatepass") for c in piece.decode("utf-8", "surrogatepass")], v.ranks):
        at = v.by_bytes.get(part)
        out += [at] if at is not None else [v.fallback[b] for b in part] if v.byte_fallback else [v.unk]
    return out


def _steps(piece: bytes) -> list[int]:
    """Length of the code point that starts at each byte, 0 inside one."""
    return [0 if 0x80 <= b < 0xC0 else 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in piece]


def viterbi(piece: bytes, v: Vocab) -> list[int]:
    """The best sum of scores. An uncovered code point costs the lowest score less 10; neighbouring unknowns are one, or bytes with fallback."""
    n, steps = len(piece), _steps(piece)
    low = min(v.scores, default=0.0) - 10
    best = [0.0] + [-math.inf] * n
    back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for i in range(n):
        if best[i] == -math.inf or not steps[i]:
            continue
        whole = False
        for size in range(1, min(v.longest, n - i) + 1):
            at = v.by_bytes.get(piece[i : i + size])
            if at is None:
                continue
            whole |= size == steps[i]
            if best[i] + v.scores[at] > best[i + size]:
                best[i + size], back[i + size] = best[i] + v.scores[at], (i, at)
        if not whole and i + steps[i] <= n and best[i] + low > best[i + steps[i]]:
            best[i + steps[i]], back[i + steps[i]] = best[i] + low, (i, -1)
    out, end = [], n
    while end > 0:
        i, at = back[end]
        out.append((at, piece[i:end]))
        end = i
    ids: list[int] = []
    last = None
    for at, part in reversed(out):
        if at >= 0:
            ids.append(at)
        elif v.byte_fallback:
            ids += [v.fallback[b] for b in part]
        elif last != -1:
            ids.append(v.unk)
        last = at
    return ids


def sampled(piece: bytes, v: Vocab, alpha: float, seed: int) -> list[int]:
    """A segmentation drawn with probability proportional to exp(alpha * score); alpha of 0 or less is the best one."""
    if alpha <= 0:
        return viterbi(piece, v)
    n, steps, draw = len(piece), _steps(piece), random.Random(seed)
    low = min(v.scores, default=0.0) - 10
    edges: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        if not steps[i]:
            continue
        found = [(i, at, v.scores[at]) for size in range(1, min(v.longest, n - i) + 1) if (at := v.by_bytes.get(piece[i : i + size])) is not None and edges[i + size].append((i, at, v.scores[at])) is None]
        if not any(len(v.tokens[at]) == steps[i] for _, at, _ in found) and i + steps[i] <= n:
            edges[i + steps[i]].append((i, v.unk, low))
    total = [0.0] + [-math.inf] * n
    for end in range(1, n + 1):
        terms = [total[i] + alpha * s for i, _, s in edges[end] if total[i] > -math.inf]
        if terms:
            m = max(terms)
            total[end] = m + math.log(sum(math.exp(x - m) for x in terms))
    out, end = [], n
    while end:
        scored = [(total[i] + alpha * s - math.log(-math.log(draw.random() or 1e-300)), i, at) for i, at, s in edges[end] if total[i] > -math.inf]
        _, end, at = max(scored)
        out.append(at)
    return out[::-1]


def wordpiece(word: bytes, v: Vocab) -> list[int]:
    """Longest match first, later parts with the prefix; a word with any miss, or over max_word bytes, is unknown."""
    if len(word) > v.max_word:
        return [v.unk]
    out, i = [], 0
    while i < len(word):
        for end in range(len(word), i, -1):
            at = v.by_bytes.get((v.prefix if i else b"") + word[i:end])
            if at is not None:
                out.append(at)
                i = end
                break
        else:
            return [v.unk]
    return out


@dataclass(frozen=True)
class Traits:
    """What a token looks like: words that begin in it, and what it opens and closes with."""

    words: int
    opens_letter: bool
    closes_letter: bool
    opens_space: bool
    opens_marker: bool
    closes_marker: bool
    uniform: bool


#: The bytes that mark capitals and deleted spaces.
MARKERS = (0x0E, 0x0F, 0x11, 0x7F)


def _kind(c: str) -> str:
    return "marker" if ord(c) in MARKERS else "letter" if c.isalpha() else "number" if c.isnumeric() else "space" if c == " " else "other"


@lru_cache(1 << 17)
def traits(token: bytes) -> Traits:
    kinds = [_kind(c) for c in token.decode("utf-8", "replace")]
    words = sum(a == "space" and b in ("letter", "number") for a, b in zip(kinds, kinds[1:], strict=False))
    first, last = (kinds[0], kinds[-1]) if kinds else ("", "")
    inner = set(kinds[1:] if first == "space" and len(kinds) > 1 else kinds)
    uniform = inner <= {"letter"} or inner <= {"other"} or inner <= {"number", "space"}
    return Traits(words, first == "letter", last == "letter", first == "space", first == "marker", last == "marker", bool(kinds) and uniform)


#: What counts for and against two tokens in a row.
WORD, SPLIT_WORD, SPLIT_MARKER, CUT_WORD, SHORTER, NO_FURTHER = 100, 103, 100, 3, 100, 10_000


def pair_score(first: bytes, second: bytes, after: bytes, longest: int | None = None) -> int:
    """How good it is to take first and then second, with after behind them. For an alternative, longest is the length of the longest first token."""
    a, b = traits(first), traits(second)
    ahead = _kind(after[:1].decode("latin-1")) if after else ""
    reach = len(first) + len(second)
    score = reach + a.uniform + (b.uniform if second else 0) + max(0, a.words - 1) + max(0, b.words - 1) + b.opens_space + (ahead == "space")
    score += WORD * (a.words + b.words + (ahead not in ("", "letter")))
    score -= SPLIT_WORD * (a.closes_letter and b.opens_letter) + SPLIT_MARKER * (a.closes_marker and b.opens_marker) + CUT_WORD * (b.closes_letter and ahead == "letter")
    if longest is not None:
        score -= SHORTER * (reach < longest) + NO_FURTHER * (reach == longest)
    return score


def ungreedy(piece: bytes, v: Vocab, alternates: int = 5) -> list[int]:
    """Longest match with a look ahead: the longest token and up to some shorter ones are scored together with the longest token that follows each; the first of the best wins. Markers are ordinary bytes: no token is put in that deletes a space."""

    out, i, reach = [], 0, 2 * v.longest + 1
    while i < len(piece):
        size, at = first_choice(piece[i : i + reach], v, alternates)
        out.append(at)
        i += size
    return out


def first_choice(piece: bytes, v: Vocab, alternates: int = 5) -> tuple[int, int]:
    """(size, id) of the first token that ungreedy() takes."""

    def matches(i: int) -> list[tuple[int, int]]:
        return [(size, at) for size in range(min(v.longest, len(piece) - i), 0, -1) if (at := v.by_bytes.get(piece[i : i + size])) is not None]

    found = matches(0)[: alternates + 1]
    if not found:
        return 1, v.fallback[piece[0]]
    best, choice = -math.inf, found[0]
    for k, (end, at) in enumerate(found):
        then = next(iter(matches(end)), (0, 0))[0]
        score = pair_score(piece[:end], piece[end : end + then], piece[end + then : end + then + 1], found[0][0] if k else None)
        if score > best:
            best, choice = score, (end, at)
    return choice


KERNELS = {"bpe": bpe, "bpe_whole": bpe_whole, "longest": longest_match, "strict": strict_match, "fewest": fewest, "char_bpe": char_bpe, "unigram": viterbi, "wordpiece": wordpiece, "ungreedy": ungreedy}


#: Windows whose choices are kept, and the longest tokens for which that is worth it; the longest that fit a number, and pieces for which arrays are worth it.
CHOICES, NEAR, PACKED, LONG = 1 << 15, 16, 7, 128


def choices(v: Vocab, alternates: int = 5) -> Callable[[bytes], list[int]]:
    """ungreedy() of long pieces: what it would choose at each byte is worked out in arrays, and followed from the first."""
    none = len(v.tokens)
    own = [traits(t or b"") for t in v.tokens] + [traits(b"")]
    words, opens, closes, spaced, marks, marked, uniform = (np.array([getattr(t, k) for t in own], np.int64) for k in ("words", "opens_letter", "closes_letter", "opens_space", "opens_marker", "closes_marker", "uniform"))
    alone, second = uniform + np.maximum(0, words - 1) + WORD * words, uniform + np.maximum(0, words - 1) + spaced + WORD * words
    kinds = {"letter": 1, "number": 2, "space": 3, "marker": 4, "other": 5}
    kind, fallback = np.array([kinds[_kind(chr(b))] for b in range(256)], np.int64), np.array(v.fallback, np.int64)
    tables = []
    for size in range(1, v.longest + 1):
        found = sorted((int.from_bytes(t, "little"), i) for t, i in v.by_bytes.items() if len(t) == size)
        tables.append((np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found], np.int64)))

    def run(piece: bytes) -> list[int]:
        raw = np.frombuffer(piece, np.uint8)
        n = len(raw)
        at_byte = np.concatenate([raw, np.zeros(v.longest, np.uint8)]).astype(np.uint64)
        key, hits = np.zeros(n, np.uint64), []
        longest, first = np.zeros(n + 1, np.int64), np.full(n + 1, none)
        for size, (keys, ids) in enumerate(tables, 1):
            key |= at_byte[size - 1 : size - 1 + n] << np.uint64(8 * (size - 1))
            hit = np.full(n, -1)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.where(keys[place] == key, ids[place], -1)
                hit[max(0, n - size + 1) :] = -1
            hits.append(hit)
            ok = np.flatnonzero(hit >= 0)
            longest[ok], first[ok] = size, hit[ok]
        ahead = np.concatenate([kind[raw], [0]])
        best, sizes, out, rank = np.full(n, -(1 << 60)), np.ones(n, np.int64), fallback[raw], np.zeros(n, np.int64)
        for size in range(v.longest, 0, -1):
            i = np.flatnonzero((hits[size - 1] >= 0) & (rank <= alternates))
            a, end = hits[size - 1][i], i + size
            b, reach = first[end], size + longest[end]
            then = ahead[i + reach]
            score = reach + alone[a] + second[b] + (then == 3) + WORD * (then > 1)
            score -= SPLIT_WORD * (closes[a] & opens[b]) + SPLIT_MARKER * (marked[a] & marks[b]) + CUT_WORD * (closes[b] & (then == 1))
            score -= np.where(rank[i] > 0, SHORTER * (reach < longest[i]) + NO_FURTHER * (reach == longest[i]), 0)
            rank[i] += 1
            better = score > best[i]
            i = i[better]
            best[i], sizes[i], out[i] = score[better], size, a[better]
        steps, places, i = sizes.tolist(), [], 0
        while i < n:
            places.append(i)
            i += steps[i]
        return out[places].tolist()

    return run


def coder(kernel: str, v: Vocab) -> Callable[[bytes], list[int]]:
    """The kernel with what it needs to know of a vocabulary looked up once, for pieces of any length."""
    f = KERNELS[kernel]
    if kernel in ("bpe", "bpe_whole") and v.longest <= 1 and all(len(t) <= 1 for t in v.ranks):  # nothing merges
        own = [v.by_bytes.get(bytes([b]), v.fallback[b] if v.byte_fallback else NONE) for b in range(256)]
        return lambda piece: [own[b] for b in piece]
    if kernel != "ungreedy" or v.longest > NEAR:
        return lambda piece: f(piece, v)
    # a choice depends on two tokens and the byte behind them alone
    reach, known = 2 * v.longest + 1, {}
    whole = choices(v) if 0 < v.longest <= PACKED else None

    def run(piece: bytes) -> list[int]:
        if whole is not None and len(piece) >= LONG:
            return whole(piece)
        out, i, n = [], 0, len(piece)
        while i < n:
            window = piece[i : i + reach]
            choice = known.get(window)
            if choice is None:
                if len(known) >= CHOICES:
                    known.clear()
                choice = known[window] = first_choice(window, v)
            out.append(choice[1])
            i += choice[0]
        return out

    return run


def decode(ids: list[int], v: Vocab, kind: str = "concat") -> bytes:
    parts = [v.tokens[i] or b"" for i in ids if i < len(v.tokens)]
    if kind == "concat":
        return b"".join(parts)
    if kind == "wordpiece":
        return b"".join(p[len(v.prefix) :] if p.startswith(v.prefix) else (b" " if k else b"") + p for k, p in enumerate(parts))
    raise ValueError(kind)


def heal(ids: list[int], v: Vocab, most: int = 3) -> tuple[list[int], bytes]:
    """Drop the longest tail of up to most tokens whose bytes begin some longer token: what stays, and the bytes to go on from."""
    for n in range(min(most, len(ids)), 0, -1):
        tail = decode(ids[-n:], v)
        if any(len(t) > len(tail) and t.startswith(tail) for t in v.by_bytes):
            return ids[:-n], tail
    return ids, b""


def fingerprint(kind: str, v: Vocab, encode) -> str:
    """SHA-256 over a model's kind, size and the ids of four fixed inputs."""
    import hashlib

    h = hashlib.sha256(kind.encode() + len(v.tokens).to_bytes(8, "little"))
    for text in ("", "Hello, world!", "The quick brown fox\njumps over 12 lazy dogs.", "naïve café — 東京 🙂"):
        for i in encode(text):
            h.update(i.to_bytes(4, "little"))
    return h.hexdigest()
