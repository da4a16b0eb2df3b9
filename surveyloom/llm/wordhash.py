"""64-bit hashes of all words of many texts at once, by tabulation over bytes: numpy passes, no Python loop over words."""

from __future__ import annotations

import numpy as np

_DEPTH = 64
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, size=_DEPTH * 256, dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: A-Z become a-z, other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words of letters and digits: a-z, 0-9 and every byte of a non-ASCII character.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Words between white space: all but space and U+0009 to U+000D.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words of each text. Equal words have equal hashes in any call."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = np.cumsum(sizes) - sizes
    real = begins[sizes > 0]
    starts[real] = inside[real]  # a word ends with its text
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(starts)
    head = np.flatnonzero(starts[at])  # where each word begins among the bytes of words
    lengths = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, lengths)
    h = _TABLE[((place & (_DEPTH - 1)) << 8) + data[at]]
    if lengths.max() > _DEPTH:
        h = h * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    counts = np.searchsorted(first, begins + sizes) - np.searchsorted(first, begins)
    return mix(np.add.reduceat(h, head) + lengths.astype(np.uint64)), counts


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by its first word's place; an array of fewer words gives none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out + words[j : j + n] + np.uint64(j + 1))
    return out
