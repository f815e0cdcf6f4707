"""Words of many texts at once in numpy, without a dictionary of words, so that memory is bounded by the batch.

A word is a maximal run of letters, digits and underscores of the text in lower case.
"""

from __future__ import annotations

import functools

import numpy as np

WORDLIKE, LETTER = 1, 2
_u = np.uint64
#: Lower texts are joined up to about this many characters.
BATCH_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + _u(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


@functools.lru_cache(maxsize=2)
def _classes(size: int) -> np.ndarray:
    """What each code point below size is."""
    out = np.zeros(size, dtype=np.uint8)
    for i in range(size):
        c = chr(i)
        if c == "_":
            out[i] = WORDLIKE
        elif c.isalnum():
            out[i] = WORDLIKE if c.isdecimal() else WORDLIKE | LETTER
    return out


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    """n odd multipliers, one for each place in a word."""
    return mix(np.arange(n, dtype=np.uint64)) | _u(1)


class Words:
    """The words of texts: `codes` (lower-case code points, a line feed after each text), `first` and `end` (exclusive)
    of each word in them, `text` (the text that it is of) and `sizes` (words of each text)."""

    def __init__(self, texts: list[str], with_letter: bool = False):
        lower = [t.lower() for t in texts]
        self.codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        top = int(self.codes.max()) if len(self.codes) else 0
        kind = _classes(0x10000 if top < 0x10000 else 0x110000)[self.codes]
        inside = (kind & WORDLIKE).astype(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))  # the last character is a line feed, so every word ends
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if with_letter and len(self.first):
            some = np.bitwise_or.reduceat(kind, self.first) & LETTER > 0  # what lies between words is of no class
            self.first, self.end = self.first[some], self.end[some]
        ends = np.cumsum([len(t) + 1 for t in lower])
        self.text = np.searchsorted(ends, self.first, side="right")
        self.sizes = np.bincount(self.text, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = self.end - self.first
        if not len(n):
            return np.zeros(0, dtype=np.uint64)
        stop = np.cumsum(n)
        at = np.arange(int(stop[-1])) - np.repeat(stop - n, n)  # place of each character in its word
        chars = self.codes[at + np.repeat(self.first, n)].astype(np.uint64)
        longest = 1 << int(n.max()).bit_length()
        terms = (chars * _u(0x9E3779B97F4A7C15) ^ (chars << _u(29)) ^ _u(0x5851F42D4C957F2D)) * _powers(max(64, longest))[at]
        return mix(np.add.reduceat(terms, stop - n) ^ mix(n.astype(np.uint64)))


def subwords(words: Words, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): for every word its own hash and those of its character n-grams of these sizes, with its ends marked,
    as rows below `buckets`, a power of two; word by word for each size."""
    n, mask = words.end - words.first, buckets - 1
    if not len(n):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    rows, owners = [(words.hashes() & _u(mask)).astype(np.int32)], [np.arange(len(n), dtype=np.int32)]
    marked = n + 2
    stop = np.cumsum(marked)
    start = stop - marked
    word = np.repeat(owners[0], marked)
    at = np.arange(int(stop[-1])) - np.repeat(start, marked)
    left = np.repeat(marked, marked) - at  # characters from here to the word's end
    chars = words.codes[np.maximum(at + np.repeat(words.first - 1, marked), 0)].astype(np.uint32)
    chars[start], chars[stop - 1] = 1, 2  # control characters: no word has them
    chars = chars * np.uint32(0x9E3779B1)
    h = chars
    for k in range(1, max(sizes)):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[k:]
        if k + 1 in sizes:
            ok = left[: len(h)] > k
            g = h[ok]
            g = (g ^ (g >> np.uint32(16))) * np.uint32(0xC2B2AE35) + np.uint32(k)
            rows.append(((g ^ (g >> np.uint32(13))) & np.uint32(mask)).astype(np.int32))
            owners.append(word[: len(h)][ok])
    return np.concatenate(rows), np.concatenate(owners)


def by_chars(texts: list[str | None], chars: int = BATCH_CHARS):
    """Slices of the texts of about so many characters."""
    low = size = 0
    for high, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= chars or high == len(texts):
            yield slice(low, high)
            low, size = high, 0
