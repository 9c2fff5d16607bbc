"""Byte-level BPE over whole batches of texts: split with arrays, look words up in a table.

A text is cut into words by the vocabulary's own pattern; a word's ids depend on
the word alone. So words are hashed with array operations and their ids taken
from a table of the words seen so far; only unseen words go through the
tokenizer library. Texts that hold an apostrophe before one of the pattern's
suffix letters, or the content of an added token, go through the library whole.

The table is a cache of bounded size and is emptied when full. Two of its words
would have to share a 64-bit hash and a length for a wrong id.
"""

from __future__ import annotations

import numpy as np

#: Words that the table holds before it is emptied.
TABLE_WORDS = 1 << 20
#: Texts are taken in groups of about so many characters.
GROUP_CHARS = 1 << 18


def worker_cache(key, make):
    """A value kept in this worker process under key, made when missing."""
    import pyspark

    held = pyspark.__dict__.setdefault("_strandline_cache", {})
    if key not in held:
        held[key] = make()
    return held[key]


def char_classes() -> np.ndarray:
    """By code point: 0 other, 1 letter, 2 number, 3 white space, as the pattern's classes are."""

    def make():
        import unicodedata

        import regex

        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            k = unicodedata.category(chr(i))[0]
            if k == "L":
                out[i] = 1
            elif k == "N":
                out[i] = 2
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, k in ((r"\p{L}", 1), (r"\p{N}", 2), (r"\s", 3)):
            out[[ord(c) for c in regex.findall(pattern, everything)]] = k
        return out

    return worker_cache("classes", make)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""

    def make():
        with np.errstate(over="ignore"):
            return np.cumprod(np.full(1 << 20, 0x9E3779B97F4A7C15, np.uint64))

    got = worker_cache("powers", make)
    if n > len(got):
        with np.errstate(over="ignore"):
            return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    return got


def segment_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment values[starts[i]:starts[i + 1]]; no segment is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    pos = np.arange(len(values)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        h = mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h *= powers(int(lengths.max()))[pos]
        return mix(np.add.reduceat(h, starts) + lengths.astype(np.uint64))


def word_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin, in texts that lie one after another (none empty, no contraction)."""
    n = len(cp)
    kind = char_classes()[cp]
    first = np.zeros(n, bool)
    first[text_starts] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    last = np.zeros(n, bool)  # last of its white space, with something after it in the text
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    # A plain space goes with what follows.
    after = np.flatnonzero(last & (cp == 32)) + 1
    start[after] = False
    return np.flatnonzero(start)


class Tokeniser:
    """encode(texts): (ids of all texts joined, number of ids of each text, bytes of each id)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.model = self.lib.model
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + i for i, b in enumerate(rest)}
        self.clear()
        self.recent: dict[str, np.ndarray] = {}

    def clear(self) -> None:
        self.bits = (TABLE_WORDS * 2).bit_length() - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(TABLE_WORDS, np.uint64)
        self.at = np.zeros(TABLE_WORDS, np.int64)
        self.n = np.zeros(TABLE_WORDS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.words = self.filled = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The table's word for each key, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            got = self.slots[slot[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return out

    def put(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        mask = (1 << self.bits) - 1
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lengths.sum())
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        new = np.arange(self.words, self.words + len(ids))
        self.keys[new], self.n[new] = keys, lengths
        self.at[new] = self.filled + np.cumsum(lengths) - lengths
        slot = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(ids))
        while len(todo):
            free = self.slots[slot[todo]] < 0
            here, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.slots[here] = new[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            taken = self.slots[slot[todo]] >= 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & mask
        self.words += len(ids)
        self.filled += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and how many each has."""
        joined = "".join(texts)
        doubtful = "'" in joined or self.special(joined)
        if doubtful and len(texts) > 1:
            odd = [self.contracted(x) or self.special(x) for x in texts]
            if any(odd):
                plain_ids, plain_n = self.encode([x for x, o in zip(texts, odd) if not o]) if not all(odd) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                counts, parts, at, k = np.zeros(len(texts), np.int64), [], 0, 0
                for i, o in enumerate(odd):
                    if o:
                        parts.append(self.whole(texts[i]))
                    else:
                        parts.append(plain_ids[at : at + plain_n[k]])
                        at, k = at + plain_n[k], k + 1
                    counts[i] = len(parts[-1])
                return np.concatenate(parts), counts
        elif doubtful and (self.contracted(joined) or self.special(joined)):
            ids = self.whole(joined)
            return ids, np.array([len(ids)])
        counts = np.zeros(len(texts), np.int64)
        if not joined:
            return np.zeros(0, np.uint32), counts
        cp = code_points(joined)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        starts = word_starts(cp, begins[lengths > 0])
        ends = np.append(starts[1:], len(cp))
        keys = segment_hashes(cp, starts)
        ids, n = self.looked_up(joined, keys, starts, ends)
        offset = np.cumsum(n) - n
        upto = np.append(offset, len(ids))[np.searchsorted(starts, np.append(begins, len(cp)))]
        return ids, np.diff(upto)

    def looked_up(self, joined: str, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words joined, and how many each has. More words than the table holds are taken in halves."""
        found = self.find(keys)
        if (missing := np.flatnonzero(found < 0)).size:
            new, first = np.unique(keys[missing], return_index=True)
            if self.words + len(new) > TABLE_WORDS:
                self.clear()
                new, first = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            if len(new) > TABLE_WORDS:
                half = len(keys) // 2
                parts = [self.looked_up(joined, keys[x], starts[x], ends[x]) for x in (slice(0, half), slice(half, None))]
                return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            at = missing[first]
            words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            spell, letters = self.model.tokenize, self.letters
            self.put(new, [[t.id for t in spell(w.encode().decode("latin-1").translate(letters))] for w in words])
            found = self.find(keys)
        n = self.n[found].astype(np.int64)
        offset = np.cumsum(n) - n
        total = int(n.sum())
        return self.pool[np.arange(total) + np.repeat(self.at[found] - offset, n)], n

    @staticmethod
    def contracted(text: str) -> bool:
        import re

        return re.search(r"'(?:[stmd]|re|ve|ll)", text) is not None

    def special(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def whole(self, text: str) -> np.ndarray:
        """By the library alone; long texts with the pattern's suffixes are rare, copies of them are kept."""
        got = self.recent.get(text)
        if got is None:
            got = np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
            if len(text) < 5000:
                if len(self.recent) > 200:
                    self.recent.clear()
                self.recent[text] = got
        return got


def tokeniser(path: str) -> Tokeniser:
    return worker_cache(("tokeniser", path), lambda: Tokeniser(path))


def groups(texts: list[str], chars: int = GROUP_CHARS):
    """Slices of texts with about so many characters each, one text at least."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
