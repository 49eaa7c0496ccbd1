"""The binary Golay code of length 23, as lookup keys for near words.

Words are at most three bits from exactly one of the 4096 codewords. The keys
of a word are the codewords within four bits: one if the nearest is within two
bits, else six. Any two words that differ in at most two bits share a key."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, PARITY_BITS = 23, 11
KEYS = 6
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for at in range(BITS - 1, PARITY_BITS - 1, -1):
        if word >> at & 1:
            word ^= _GENERATOR << (at - PARITY_BITS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by byte of the word; per remainder the error patterns of up
    to four bits that lead to a codeword, and how many there are."""
    by_byte = np.array([[_remainder(v << 8 * k) if v << 8 * k < 1 << BITS else 0 for v in range(256)]
                        for k in range(3)], dtype=np.int64)
    patterns = np.zeros((1 << PARITY_BITS, KEYS), dtype=np.int64)
    count = np.zeros(1 << PARITY_BITS, dtype=np.int64)
    single = [_remainder(1 << at) for at in range(BITS)]
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            rest = word = 0
            for at in bits:
                rest ^= single[at]
                word |= 1 << at
            patterns[rest, count[rest]] = word
            count[rest] += 1
    return by_byte, patterns, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword numbers (12 bits) of each word, ``(n, 6)``, and a mask of the
    valid ones."""
    by_byte, patterns, count = _tables()
    words = words.astype(np.int64)
    rest = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    found = (words[:, None] ^ patterns[rest]) >> PARITY_BITS
    return found, np.arange(KEYS) < count[rest][:, None]
