"""Canonical length-limited Huffman codes: lengths by package-merge, packing and table-driven unpacking in numpy."""

from __future__ import annotations

import numpy as np

#: Longest code where there are at most 2 ** 17 symbols; the unpacking table has 2 ** (longest code) entries.
LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The bits of each symbol's code: the best total for these counts with none above the limit; 0 for counts of 0."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        sort = np.argsort(merged, kind="stable")
        levels.append(sort < len(weights))
        merged = merged[sort]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    # Of the last level the first 2n - 2 items are taken; a package in it takes two items of the level before.
    take, bits = 2 * len(used) - 2, np.zeros(len(used), dtype=np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


class Codebook:
    """Codes in order of length, then symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        bits = self.lengths[order].astype(np.int64)
        self.longest = int(bits[-1]) if len(bits) else 1
        room = np.int64(1) << (self.longest - bits)
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[order] = ((np.cumsum(room) - room) >> (self.longest - bits)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.longest, dtype=np.uint32)
        filled = np.repeat(order, room)
        self.symbol[: len(filled)] = filled
        self.taken = self.lengths[self.symbol].astype(np.int64)

    def pack(self, symbols: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """The codes in a row as bytes, highest bit first, and the bit at which each `every`-th symbol starts."""
        if not len(symbols):
            return b"", np.zeros(0, dtype=np.uint32)
        bits = self.lengths[symbols].astype(np.int64)
        end = np.cumsum(bits)
        start = end - bits
        word = start >> 5
        window = self.codes[symbols] << (64 - (start & 31) - bits).astype(np.uint64)
        n = int(end[-1] + 31 >> 5) + 1
        # Codes share no bit, so the sums are the words; floats hold them exactly.
        words = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n + 1)
        words += np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
        return words.astype(np.uint64).astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], start[::every].astype(np.uint32)

    def unpack(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], every: int) -> list[np.ndarray]:
        """The symbols of each payload; every stretch between checkpoints is a lane, and all lanes move together."""
        padded = [p + bytes(-len(p) % 4 + 8) for p in payloads]
        words = np.frombuffer(b"".join(padded), dtype=">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        first = np.cumsum([0, *[len(p) * 8 for p in padded]])
        at = np.concatenate([c.astype(np.int64) + f for c, f in zip(checkpoints, first, strict=False)]) if checkpoints else np.zeros(0, dtype=np.int64)
        out = np.zeros((every, len(at)), dtype=np.uint32)
        shift = np.uint64(64 - self.longest)
        last = len(pairs) - 1
        for i in range(every):
            code = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift
            out[i] = self.symbol[code]
            at = at + self.taken[code]
        flat, lane, found = out.T.reshape(-1), 0, []
        for c, n in zip(checkpoints, sizes, strict=True):
            found.append(flat[lane * every : lane * every + n])
            lane += len(c)
        return found
