"""Words of whole texts as 64-bit hashes, many documents at a time.

Words are the runs of bytes other than space and \\x09-\\x0D of the UTF-8 text. The hash
of a word is a polynomial of its bytes, mixed; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20_011)
#: A random number for each byte, and 0 for white space.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * ~_SPACE
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = (_RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Texts are worked on together up to this many bytes, so that arrays stay in the cache.
TOGETHER = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def groups(texts: list[bytes], size: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each word, end of each word, words before each text)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.empty(len(raw) + 1, bool)
    inside[0] = False
    np.logical_not(_SPACE[raw], out=inside[1:])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return raw, starts, ends, np.searchsorted(starts, begins)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text) of some texts together."""
    raw, starts, ends, firsts = word_bounds(texts)
    if not len(starts):
        return np.empty(0, np.uint64), firsts
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    longest = int(place.max()) + 1
    powers = np.cumprod(np.full(longest, _STEP, np.uint64))
    sums = np.add.reduceat(_BYTE[raw] * powers[place], starts)
    return mix(sums + (ends - starts).astype(np.uint64)), firsts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; ``len(words) - n + 1`` of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = words[:count] * _PLACE[0]
    for i in range(1, n):
        h += words[i:i + count] * _PLACE[i]
    h += np.uint64(n)
    return mix(h)
