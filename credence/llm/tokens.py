"""Words of many texts at once, as hashes: the common ground of the operators on word shingles."""

from __future__ import annotations

import numpy as np

from .shared import CHUNK_BYTES

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of words: digits, letters with A-Z lower-cased, and everything outside ASCII. All others separate words.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    key = int(base)
    if len(_powers.get(key, ())) < n:
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16) - 1, base, np.uint64)]))
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in data and begin at starts (one more: the end),
    and where each text begins among them. Long stretches are handled in blocks that end between words."""
    found, begins, at, stop = [], [], int(starts[0]), int(starts[-1])
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    while at < stop:
        end = min(at + CHUNK_BYTES, stop)
        if end < stop:
            cuts = np.flatnonzero(LETTERS[data[at:end]] == 0)
            while not len(cuts) and end < stop:  # a word longer than a block
                end = min(end + CHUNK_BYTES, stop)
                cuts = np.flatnonzero(LETTERS[data[at:end]] == 0)
            if end < stop:
                end = at + int(cuts[-1]) + 1
        x = LETTERS[data[at:end]]
        real = np.zeros(len(x) + 2, bool)
        real[1:-1] = x > 0
        edge = real[1:] != real[:-1]
        first = edge & real[1:]
        last = edge & real[:-1]
        inner = starts[(starts > at) & (starts < end)] - at  # a word never runs from one text into the next
        split = inner[real[inner] & real[inner + 1]]
        first[split] = last[split] = True
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        total = np.concatenate([[np.uint64(0)], np.cumsum(table[x] * _power(_P, len(x)))])
        found.append(mix((total[b] - total[a]) * _power(_INVERSE, len(x))[a] ^ (b - a).astype(np.uint64)))
        begins.append(a + at)
        at = end
    hashes = np.concatenate([np.zeros(0, np.uint64), *found])
    return hashes, np.searchsorted(np.concatenate([np.zeros(0, np.int64), *begins]), starts)


def text_words(text: str | None) -> np.ndarray:
    """Hashes of the words of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, one for each place; those that would run past the end are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _P + hashes[i : i + len(out)]
    return mix(out)
