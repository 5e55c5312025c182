"""The binary Golay code of length 23 as a fuzzy hash, in numpy.

Every 23-bit word lies within three bits of exactly one codeword. A word's keys are the code
words that it or a word one bit away decodes to: one key if its own error has at most two
bits, else six. Two words that differ in at most two bits have a word between them, one bit
from each, so they share a key. For two words one bit apart, each one's own decoding is among
the keys of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, INFO = 23, 12
_CHECK = LENGTH - INFO
_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, _CHECK - 1, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - _CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits by information; masks that turn information into keys, and their number, by syndrome."""
    check = np.array([_remainder(i << _CHECK) for i in range(1 << INFO)], np.int64)
    error = np.zeros(1 << _CHECK, np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            error[_remainder(pattern)] = pattern
    masks, sizes = np.zeros((1 << _CHECK, 6), np.int64), np.zeros(1 << _CHECK, np.int64)
    for syndrome in range(1 << _CHECK):
        near = [error[syndrome] >> _CHECK]
        for bit in range(LENGTH):
            flipped = syndrome ^ _remainder(1 << bit)
            near.append((1 << bit ^ error[flipped]) >> _CHECK)
        keys = list(dict.fromkeys(near))
        masks[syndrome, : len(keys)], sizes[syndrome] = keys, len(keys)
    return check, masks, sizes


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six key slots of each word, its own decoding first, and which slots are in use."""
    check, masks, sizes = _tables()
    words = words.astype(np.int64)
    info = words >> _CHECK
    syndrome = check[info] ^ (words & ((1 << _CHECK) - 1))
    return info[:, None] ^ masks[syndrome], np.arange(6) < sizes[syndrome][:, None]
