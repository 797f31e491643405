"""Word shingles of many texts at once, as 64-bit hashes, without a Python step a word.

A word of up to LONG_WORD bytes is hashed as a polynomial modulo 2**64 over random numbers a
byte. Longer ones, which are rare, by BLAKE2b: modulo a power of two the polynomials of long
words can be equal by construction (a Thue-Morse word and its complement).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed in one go; a longer text is cut at white space.
PIECE = 1 << 18
SHINGLE = 5
#: Bytes beyond which a word is hashed by BLAKE2b.
LONG_WORD = 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input reaches each bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in `data`, and each text's first word.

    `starts` has each text's first byte and, last, len(data). Words are the stretches
    without white space (space, 9-13), with A-Z lower-cased.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    ink = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    inverse = pow(_BASE, -1, 2**64)
    sums = np.cumsum(_BYTE[low] * _power(_BASE, n), dtype=np.uint64)
    before = np.where(a > 0, sums[np.maximum(a - 1, 0)], np.uint64(0))
    hashes = mix((sums[z] - before) * _power(inverse, n)[a] + (z - a + 1).astype(np.uint64))
    for i in np.flatnonzero(z - a >= LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(low[a[i] : z[i] + 1].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(a, starts)


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """The words of one text, in pieces of PIECE bytes that end at white space or, within a longer word, with that word."""
    out, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and not (data[to] == 32 or 9 <= data[to] <= 13):
            more = data[to : to + PIECE]
            white = np.flatnonzero((more == 32) | ((more >= 9) & (more <= 13)))
            to += int(white[0]) if len(white) else len(more)
        piece = data[at:to]
        out.append(word_hashes(piece, np.array([0, len(piece)]))[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words.

    A text of fewer words has one: all its words. Null and blank texts have none.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        starts = offsets[at : to + 1] - offsets[at]
        piece = bytes_[offsets[at] : offsets[to]]
        if len(piece) > PIECE:
            words = long_word_hashes(piece)
            firsts = np.array([0, len(words)])
        else:
            words, firsts = word_hashes(piece, starts)
        m = len(words) - size + 1
        rolled = np.zeros(max(m, 0), np.uint64)
        for k in range(size if m > 0 else 0):
            rolled += words[k : k + m] * _PLACE[k]
        rolled = mix(rolled)
        for i in range(to - at):
            a, z = firsts[i], firsts[i + 1]
            if z - a >= size:
                yield np.unique(rolled[a : z - size + 1])
            elif z > a:
                short = (words[a:z] * _PLACE[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = to
