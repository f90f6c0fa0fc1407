"""The perfect binary Golay code as a fuzzy hash of 23-bit words.

Each 23-bit word lies within 3 bits of one codeword. A word at exactly 3 bits
also has five codewords at 4 bits. The indices of these codewords are the
word's keys: one if the codeword is nearer than 3 bits, else six. Any two
words that differ in at most 2 bits have a key in common.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # of degree 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """syndromes of the bytes of a word, (3, 256); errors by syndrome, (2048, 6), with -1 where there is none."""
    rest = np.zeros(23, np.int64)
    for i in range(23):
        x = 1 << i
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        rest[i] = x
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * k + i < 23:
                    by_byte[k, v] ^= rest[8 * k + i]
    errors = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= int(rest[i])
            first = errors[s, 0]
            if weight < 4 or first >= 0 and bin(int(first)).count("1") == 3:
                errors[s, filled[s]] = sum(1 << i for i in places)
                filled[s] += 1
    return by_byte, errors


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of n 23-bit words, -1 where there is none."""
    by_byte, errors = tables()
    words = words.astype(np.int64)
    e = errors[by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16]]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)
