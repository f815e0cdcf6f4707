"""Token ids of whole texts by the tokenizers library, with the ids of space-delimited pieces kept on the worker.

A byte-level pre-tokenizer starts a new pre-token at every single space or line feed that stands between two other
characters, and merges never cross pre-tokens. So where all white space of a text is of that kind, its ids are those of
its pieces (a space or line feed and what follows it up to the next one) in a row, and the library encodes each distinct
piece once, many pieces in one call. Any other text goes to the library as a whole, and so does one that holds an added
token, such as "<|endoftext|>", which the library takes out of a text before it cuts pre-tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flaglens.llm.worker import hold

#: Pieces that a worker keeps, twice over, at about 200 bytes each where parts are counted; fewer cost only time.
REMEMBERED = 600_000
#: Pieces that one call of the library encodes.
LEARNED = 1 << 15
#: Pieces whose ids are put in a row at once.
GATHERED = 1 << 17


def single_spaced(text: str) -> bool:
    """Whether all white space of a text is single spaces and line feeds between other characters."""
    plain = text.replace("\n", " ")
    if plain.isprintable():  # no white space but spaces
        return plain[:1] not in ("", " ") and plain[-1] != " " and "  " not in plain
    # As many characters of white space as spaces and line feeds, and one word more.
    words, marks = text.split(), plain.count(" ")
    return len(words) == marks + 1 and len(text) - len("".join(words)) == marks


class _Shelf:
    """The ids of pieces met lately, in arrays: those of piece i are flat[starts[i] : starts[i] + sizes[i]]."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.turn, self.pieces = most, 0, pa.array([], pa.large_string())
        self.flat, self.starts, self.sizes, self.met = np.zeros(0, dtype=dtype), *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def _part(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _clear(self) -> None:
        """Keep the half that was met last."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        self.pieces, self.met, sizes = self.pieces.take(pa.array(kept)), self.met[kept], self.sizes[kept]
        self.flat = self._part(self.starts[kept], sizes)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def places(self, pieces: pa.Array, encoded) -> np.ndarray:
        """Where each of these distinct pieces is; encoded(new pieces, mark) tells the ids of those that aren't there."""
        if len(self.pieces) > self.most:
            self._clear()
        at = pc.index_in(pieces, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacks = np.flatnonzero(at < 0)
        fresh = pieces.take(pa.array(lacks))
        feeds = pc.starts_with(fresh, "\n").to_numpy(zero_copy_only=False).astype(bool)
        for own, mark in ((lacks[feeds], "\n"), (lacks[~feeds], " ")):
            names = pieces.take(pa.array(own))
            ids, sizes = encoded(names.to_pylist(), mark)
            at[own] = len(self.pieces) + np.arange(len(own))
            self.pieces = pa.concat_arrays([self.pieces, names])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.zeros(len(own), dtype=np.int64)])
        self.turn += 1
        self.met[at] = self.turn
        return at


class PieceEncoder:
    """encode(texts) gives the ids of each as bytes of `dtype`, little-endian; unit_counts(parts) only their numbers, part by
    part. Each keeps up to 2 * `remembered` pieces (and those of one call): those met lately and those met before them,
    which go when as many new ones have come."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.remembered, self.known, self.before = remembered, {}, {}
        self.shelf = _Shelf(self.dtype, 2 * remembered)
        self.starts = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.starts[i] = token.startswith("Ġ")  # the byte-level alphabet's sign for a space
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")  # a text with one of these is encoded whole
        self.feed = self._ids("\n")
        whole = [*self.feed.tolist(), *self._ids("a").tolist(), *self._ids(" b").tolist()]
        self.fits = len(self.feed) == 1 and self._ids("\na b").tolist() == whole and not any(re.search(r"\s", t) for t in added)

    def _ids(self, text: str) -> np.ndarray:
        # The call for batches is the one that leaves out offsets.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _encoded(self, pieces: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has; mark: the line feed that all begin with, or the space before them."""
        ids, sizes = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(pieces), LEARNED):
            group = pieces[i : i + LEARNED]
            found = self._ids("".join(group) if mark == "\n" else " " + " ".join(group))
            at = np.flatnonzero(found == self.feed[0] if mark == "\n" else self.starts[found])
            if len(at) == len(group) and at[0] == 0:
                ids.append(found)
                sizes.append(np.diff(at, append=len(found)))
            else:
                each = [self._ids(p if mark == "\n" else " " + p) for p in group]
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> None:
        for mark, group in (("\n", [p for p in pieces if p[0] == "\n"]), (" ", [p for p in pieces if p[0] != "\n"])):
            ids, sizes = self._encoded(group, mark)
            raw, cuts = ids.tobytes(), [0, *(np.cumsum(sizes) * self.dtype.itemsize).tolist()]
            self.known.update((p, raw[cuts[i] : cuts[i + 1]]) for i, p in enumerate(group))

    def _know(self, pieces: set[str]) -> None:
        """Have these pieces, none of which was met lately, among the known ones."""
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        self.known.update((p, self.before[p]) for p in pieces if p in self.before)
        self._learn([p for p in pieces if p not in self.before])

    def _splits(self, text: str) -> bool:
        """Whether the ids of the text are those of its pieces."""
        return self.fits and single_spaced(text) and not self.added.search(text)

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        ids = list(map(self.known.get, pieces))
        if None in ids:
            fresh = [i for i, x in enumerate(ids) if x is None]
            self._know({pieces[i] for i in fresh})
            get = self.known.get
            for i in fresh:
                ids[i] = get(pieces[i])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        once = dict.fromkeys(texts)  # copies, as a mix has them, are encoded once
        cut = [t for t in once if self._splits(t)]
        once.update(zip(cut, self._joined(cut), strict=True))
        return [self._ids(t).tobytes() if once[t] is None else once[t] for t in texts]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are those of their pieces; only pieces not met before become Python objects."""
        if not texts:
            return []
        # Each text as after a line feed, whose one id is cut off again.
        whole = "".join(f"\n{t}" for t in texts).replace("\n", " \n")
        pieces = pc.split_pattern(pa.array([whole], pa.large_string()), " ").values.slice(1).dictionary_encode()
        del whole
        at = self.shelf.places(pieces.dictionary, self._encoded)
        starts, sizes, flat = self.shelf.starts[at], self.shelf.sizes[at], self.shelf.flat
        which, out = pieces.indices.to_numpy(), []
        for i in range(0, len(which), GATHERED):
            own = which[i : i + GATHERED]
            n = sizes[own]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(starts[own] - (ends - n), n) + np.arange(ends[-1])])
        last = np.cumsum([t.count(" ") + t.count("\n") + 1 for t in texts])
        width = self.dtype.itemsize
        stops = (np.cumsum(sizes[which])[last - 1] * width).tolist()
        raw = np.concatenate(out).tobytes()
        return [raw[a + width : b] for a, b in zip([0, *stops], stops, strict=False)]

    def unit_counts(self, parts: list[str]) -> np.ndarray:
        """The number of ids of each of the parts of a text, cut before single spaces and line feeds."""
        if not parts:
            return np.zeros(0, dtype=np.int64)
        bare = parts[0][0] not in " \n"
        if self._splits(("" if bare else "x") + "".join(parts)):
            keys = [p[1:] if p[0] == " " else p for p in parts]
            keys[0] = f"\n{parts[0]}" if bare else keys[0]
            counts = self._known_counts(keys)
            counts[0] -= bare
            return counts
        return np.array([len(self._ids(p)) for p in parts], dtype=np.int64)

    def _known_counts(self, keys: list[str]) -> np.ndarray:
        ids = self._of_pieces(keys)
        return np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    hold("encoding", _encoders.clear)
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    own = _encoders[path]
    own.remembered, own.shelf.most = remembered, 2 * remembered
    return own
