"""Word shingles of whole texts as 64-bit hashes, with array operations over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .tokenise import mix, powers

SIZE = 5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return lower, white


LOWER, WHITE = _tables()


class Words:
    """All words of all texts in order: hashes, where each begins and ends in data, and how many each text has.

    Words are runs of bytes other than ASCII white space, A-Z in lower case for
    their hashes. data holds the texts' UTF-8, a space after each.
    """

    def __init__(self, texts: list[str]):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.data = data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.text_begins = np.cumsum(lengths) - lengths
        white = WHITE[data]
        self.begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        self.counts = np.diff(np.append(np.searchsorted(self.begins, self.text_begins), len(self.begins)))
        self.ends = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
        self.hashes = np.zeros(0, np.uint64)
        if len(self.begins):
            size = self.ends - self.begins
            chars = LOWER[data[~white]]
            first = np.cumsum(size) - size
            pos = np.arange(len(chars)) - np.repeat(first, size)
            with np.errstate(over="ignore"):
                h = (chars.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[pos]
                self.hashes = mix(np.add.reduceat(h, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    words = Words(texts)
    return words.hashes, words.counts


def shingle_hashes(words: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hash of each run of `size` words; the whole sequence as one with fewer; none without words."""
    n = len(words)
    k = min(size, n)
    if not k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
        return mix(h)


def shingle_sets(texts: list[str], size: int = SIZE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, in rising order of hash."""
    words, counts = word_hashes(texts)
    at = 0
    for n in counts.tolist():
        yield np.unique(shingle_hashes(words[at : at + n], size))
        at += n
