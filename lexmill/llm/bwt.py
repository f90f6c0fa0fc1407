"""Suffix orders of text shards and their merging by interleave refinement.

A shard is a set of strings with its suffix order (and so its Burrows-Wheeler
transform). Two shards are merged without sorting suffixes again: their
interleave is known for the first few symbols, and is refined from depth to
depth. At each depth both shards list their classes of equal prefixes in
order; a class is told by the merged ranks, one depth before, of its first and
of its second part, so one merge of two ordered lists of classes gives the
interleave at the next depth. Depths double, as a refinement symbol by symbol
would take as many passes as the match length. The classes of all depths give
the common prefixes of neighbours in the merged order; suffixes in one class
at the last depth have that many symbols in common and form a repeated interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FIRST, BITS = 7, 9


def depths(length: int) -> list[int]:
    out = [min(FIRST, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordered distinct keys, a position of each, and each position's rank among them."""
    order = np.argsort(keys)
    by = keys[order]
    new = np.concatenate([[True], by[1:] != by[:-1]])
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new) - 1
    return by[new], order[new].astype(np.int32), rank


@dataclass
class Shard:
    """symbols: bytes + 1, each string ended by 0; room: how far ahead that 0 is. ranks and heads by depth: the class of each position, and a position of each class.

    What stands after a string's end counts as 0. So a class stays what it was, and
    where it was, when more strings follow in a merged shard.
    """

    length: int
    symbols: np.ndarray
    room: np.ndarray
    keys: np.ndarray
    ranks: list[np.ndarray]
    heads: list[np.ndarray]

    @classmethod
    def of(cls, strings: list[bytes], length: int) -> Shard:
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = np.cumsum([len(x) + 1 for x in strings]) - 1
        raw[ends] = 0
        room = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(raw))).astype(np.int32)
        steps = depths(length)
        padded = np.concatenate([raw.astype(np.uint64), np.zeros(FIRST, np.uint64)])
        packed = np.zeros(len(raw), np.uint64)
        for j in range(steps[0]):
            packed = packed << np.uint64(BITS) | np.where(room >= j, padded[j : j + len(raw)], np.uint64(0))
        keys, head, rank = _classes(packed)
        ranks, heads = [rank], [head]
        for k in range(1, len(steps)):
            _, head, rank = _classes(cls._pair(ranks[-1], room, np.arange(len(raw)), steps[k] - steps[k - 1]))
            ranks.append(rank)
            heads.append(head)
        return cls(length, raw, room, keys, ranks, heads)

    @staticmethod
    def _pair(rank: np.ndarray, room: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Key of the two parts of positions at; beyond the string's end the second part is 0."""
        second = np.zeros(len(at), np.int64)
        inside = room[at] >= step
        second[inside] = rank[at[inside] + step] + 1
        return rank[at].astype(np.int64) << 32 | second

    def order(self) -> np.ndarray:
        """Positions in the order of their first length symbols."""
        return np.argsort(self.ranks[-1], kind="stable")

    def transform(self) -> np.ndarray:
        """The Burrows-Wheeler transform: the symbol before each suffix, in suffix order."""
        return np.roll(self.symbols, 1)[self.order()]

    def common_prefixes(self) -> np.ndarray:
        """Length of the common prefix, within their strings, of each suffix and the next in suffix order, up to length. The classes of the refinement's depths tell it; no text is compared but for the last symbols."""
        order = self.order()
        i, j = order[:-1].copy(), order[1:].copy()
        n, out = len(self.symbols), np.zeros(max(len(order) - 1, 0), np.int64)
        for rank, depth in zip(reversed(self.ranks), reversed(depths(self.length)), strict=True):
            inside = (j < n) & (i < n) & (out + depth <= self.length)
            same = np.zeros(len(out), bool)
            same[inside] = rank[i[inside]] == rank[j[inside]]
            for x in (i, j, out):
                x[same] += depth
        for _ in range(FIRST):
            inside = (j < n) & (i < n) & (out < self.length)
            same = np.zeros(len(out), bool)
            same[inside] = self.symbols[i[inside]] == self.symbols[j[inside]]
            if not same.any():
                break
            for x in (i, j, out):
                x[same] += 1
        ends = np.flatnonzero(self.symbols == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        return np.minimum(out, np.minimum(left[order[:-1]], left[order[1:]]))

    def repeated(self) -> np.ndarray:
        """Whether each position lies in a repeated interval: one of suffixes that have their first length symbols in common, and more than one of them."""
        rank = self.ranks[-1]
        return np.bincount(rank)[rank] > 1

    def merge(self, other: Shard) -> Shard:
        steps, n = depths(self.length), len(self.symbols)
        a, b, keys = _interleave(self.keys, other.keys)
        ranks = [np.concatenate([a[self.ranks[0]], b[other.ranks[0]]]).astype(np.int32)]
        heads = [_heads(a, b, self.heads[0], other.heads[0] + n, len(keys))]
        for k in range(1, len(steps)):
            step = steps[k] - steps[k - 1]
            mine, theirs = (self._pair(r, s.room, s.heads[k], step) for r, s in ((ranks[-1][:n], self), (ranks[-1][n:], other)))
            a, b, both = _interleave(mine, theirs)
            ranks.append(np.concatenate([a[self.ranks[k]], b[other.ranks[k]]]).astype(np.int32))
            heads.append(_heads(a, b, self.heads[k], other.heads[k] + n, len(both)))
        return Shard(self.length, np.concatenate([self.symbols, other.symbols]), np.concatenate([self.room, other.room]), keys, ranks, heads)


def _interleave(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ordered distinct a and b: the place of each in the merged list of distinct values, and that list."""
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside.nonzero()[0]]
    fresh = ~same
    before = np.cumsum(fresh) - fresh  # values of b alone that stand before
    place_b = at + before
    place_a = np.arange(len(a)) + np.searchsorted(at[fresh], np.arange(len(a)), side="right")
    merged = np.empty(len(a) + int(fresh.sum()), a.dtype)
    merged[place_a] = a
    merged[place_b[fresh]] = b[fresh]
    return place_a, place_b, merged


def _heads(a: np.ndarray, b: np.ndarray, head_a: np.ndarray, head_b: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    out[b] = head_b
    out[a] = head_a
    return out


def merged(strings: list[bytes], length: int, shard_bytes: int = 1 << 18) -> Shard:
    """The order of all strings' suffixes: of shards of some shard_bytes, merged with their neighbours of the same size as they are made, so few shards are held at once."""
    held: list[tuple[int, Shard]] = []

    def join() -> None:
        (_, b), (level, a) = held.pop(), held.pop()
        held.append((level + 1, a.merge(b)))

    part: list[bytes] = []
    size = 0
    for i, x in enumerate(strings):
        part.append(x)
        size += len(x) + 1
        if size >= shard_bytes or i + 1 == len(strings):
            held.append((0, Shard.of(part, length)))
            part, size = [], 0
            while len(held) > 1 and held[-1][0] == held[-2][0]:
                join()
    while len(held) > 1:
        join()
    return held[0][1]
