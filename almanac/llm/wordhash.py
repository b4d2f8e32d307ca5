"""64-bit hashes of words and word shingles, for whole batches of texts at once.

Texts are handled as one byte array, so that nothing runs per word in Python. Hashes are fixed
functions of the bytes: the same in every process and run.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(1)
_POSITIONS = 4096

# Bytes of text whose words are handled at once; the numbers beside them take up to some 25 times as much.
WORD_BYTES = 1_000_000

# Letters hashed at once, at 8 bytes and more each; one longer word is hashed by itself.
_LETTERS = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = random_words(256, 1)
_PLACE = random_words(_POSITIONS, 2) | _ODD
_LATER = random_words(_POSITIONS, 3) | _ODD
_LATER[0] = 1  # so that a word's hash does not depend on whether a longer one is hashed beside it

# A-Z to a-z; all other bytes stay, so that text in UTF-8 stays UTF-8.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# What is no part of a word when punctuation does not count: ASCII other than letters and digits.
NO_LETTER = np.zeros(256, dtype=bool)
NO_LETTER[:128] = True
NO_LETTER[48:58] = NO_LETTER[65:91] = NO_LETTER[97:123] = False


class Words:
    """The words of a batch of texts: ``hash`` per word, ``first`` word of each text (one more at the end)."""

    def __init__(self, texts: list[str | None], gaps: np.ndarray = SPACE, lower: bool = True):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(encoded) + b" "
        raw = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            raw = LOWER[raw]
        sizes = np.fromiter((len(e) + 1 for e in encoded), dtype=np.int64, count=len(encoded))
        ends_of_texts = np.cumsum(sizes)
        inside = ~gaps[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]  # the closing space ends the last word
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends_of_texts)))
        self.text_start = np.concatenate(([0], ends_of_texts))
        self.hash = _word_hashes(raw, self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words, and the first of each text (one more at the end).

        A text with fewer words has its whole sequence as the only one; one without words has none.
        """
        counts = np.diff(self.first)
        per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        total = int(bounds[-1])
        text = np.repeat(np.arange(len(counts)), per_text)
        word = np.arange(total) - bounds[text] + self.first[text]
        width = np.minimum(counts, n)[text]
        out = width.astype(np.uint64)
        padded = np.concatenate((self.hash, np.zeros(n, dtype=np.uint64)))
        with np.errstate(over="ignore"):
            for k in range(n):
                out = np.where(k < width, _mixed(out * np.uint64(0x9E3779B97F4A7C15) + padded[word + k]), out)
        return out, bounds


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), dtype=np.uint64)
    before = np.concatenate(([0], np.cumsum(end - start)))
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(before, before[first] + _LETTERS, side="right")) - 1)
        out[first:last] = _hashed_at_once(raw, start[first:last], end[first:last])
        first = last
    return out


def _hashed_at_once(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    bounds = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    letters = raw[place + np.repeat(start, size)]
    with np.errstate(over="ignore"):
        weight = _PLACE[place % _POSITIONS]
        if size.max() > _POSITIONS:
            weight = weight * _LATER[(place // _POSITIONS) % _POSITIONS]
        sums = np.add.reduceat(_BYTE[letters] * weight, bounds[:-1])
        return _mixed(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct_by_text(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text, ascending."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def signatures(hashes: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash: per text with shingles, the least of ``coordinates`` different rehashes, 32 bits each.

    One row per text; texts without shingles have a row of zeros.
    """
    n = len(bounds) - 1
    out = np.zeros((n, coordinates), dtype=np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return out
    starts = bounds[:-1][filled]
    factors, shifts = random_words(coordinates, 4) | _ODD, random_words(coordinates, 5)
    with np.errstate(over="ignore"):
        for c in range(coordinates):
            x = (hashes ^ shifts[c]) * factors[c]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[filled, c] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out
