"""Token counts that follow edits: a segment tree of pre-token counts for each document.

A document is cut where a single space or line feed stands between two other characters; a byte-level pre-tokenizer
always starts a new pre-token there, so the count of the text is the sum of the counts of its units. `LEAF` units in a
row are a leaf, and a binary tree of sums (characters and tokens) stands above the leaves. An edit finds its place by
the character sums, joins the units that it touches with one unit of context on either side, cuts and counts only that
region again and adds the difference along the path to the root; when a leaf has grown fourfold the tree is rebuilt from
the counts it holds. Encoding is left to the tokenizers library; counts of units are kept on the worker.

Trees are kept: `build` gives a table of them, with the texts and counts of leaves and the sums above them, and `edit`
applies a table of edits to such a table and gives the trees that follow, so that a later edit finds counts and sums as
they were left. Of a tree that is read, only leaves that an edit touches are cut into units again.

Null and empty texts have 0 tokens before their edits. Places beyond the text are its end. Edits of one doc_id are made in
order of `ord`, ties by their start. Repeated rows give repeated results, each edited by all edits of its doc_id; rows with
a null doc_id have trees, but no edits. A tree, and so a very long text, is held whole by one task. Other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.encoding import PieceEncoder, encoder, single_spaced
from flaglens.llm.store import Workspace
from flaglens.llm.token_file import vocabulary_path
from flaglens.session import ship

LEAF = 64
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def units(text: str) -> list[str]:
    """The text cut before each single space or line feed."""
    if single_spaced(text):
        parts = text.replace("\n", " \n").split(" ")
        return [parts[0], *(p if p[0] == "\n" else f" {p}" for p in parts[1:])]
    return CUT.split(text) if text else []


class _Leaves(list):
    """The units of each leaf; a leaf that was read is kept as (text, characters of each unit) until it is asked for."""

    def __getitem__(self, i: int) -> list[str]:
        leaf = list.__getitem__(self, i)
        if isinstance(leaf, tuple):
            text, ends = leaf[0], np.cumsum(np.frombuffer(leaf[1], dtype="<u4")).tolist()
            leaf = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            self[i] = leaf
        return leaf

    def __iter__(self) -> Iterator[list[str]]:
        return (self[i] for i in range(len(self)))

    def count(self, i: int) -> int:
        leaf = list.__getitem__(self, i)
        return len(leaf[1]) // 4 if isinstance(leaf, tuple) else len(leaf)

    def kept(self) -> Iterator[tuple[str, bytes]]:
        for leaf in list.__iter__(self):
            yield leaf if isinstance(leaf, tuple) else ("".join(leaf), np.fromiter(map(len, leaf), dtype="<u4", count=len(leaf)).tobytes())


class TokenTree:
    def __init__(self, text: str, encoder: PieceEncoder):
        self.encoder, self.encoded = encoder, 0
        self._build(units(text))

    @classmethod
    def read(cls, leaves: list[str], sizes: list[bytes], counts: list[bytes], sums: list[bytes], encoder: PieceEncoder) -> TokenTree:
        """The tree that kept() gave."""
        tree = cls.__new__(cls)
        tree.encoder, tree.encoded = encoder, 0
        tree.leaves = _Leaves(zip(leaves, sizes, strict=True))
        tree.counts = [np.frombuffer(c, dtype="<u4").astype(np.int64) for c in counts]
        levels = [np.frombuffer(x, dtype="<i8").copy() for x in sums]
        tree.levels = [[chars, tokens] for chars, tokens in zip(levels[::2], levels[1::2], strict=True)]
        return tree

    def kept(self) -> tuple[list[str], list[bytes], list[bytes], list[bytes]]:
        """Texts of leaves, characters and tokens of their units, and the sums of each level."""
        leaves, sizes = zip(*self.leaves.kept(), strict=True)
        return list(leaves), list(sizes), [c.astype("<u4").tobytes() for c in self.counts], [x.astype("<i8").tobytes() for level in self.levels for x in level]

    def _count(self, parts: list[str]) -> np.ndarray:
        self.encoded += len(parts)
        return self.encoder.unit_counts(parts)

    def _build(self, parts: list[str], tokens: np.ndarray | None = None) -> None:
        tokens = self._count(parts) if tokens is None else tokens
        chars = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        at = np.arange(0, max(1, len(parts)), LEAF)
        self.leaves = _Leaves(parts[i : i + LEAF] for i in at)
        self.counts = [tokens[i : i + LEAF] for i in at]
        low = [np.add.reduceat(x, at) if len(x) else np.zeros(1, dtype=np.int64) for x in (chars, tokens)]
        self.levels = [low]
        while len(low[0]) > 1:
            low = [np.add.reduceat(x, np.arange(0, len(x), 2)) for x in low]
            self.levels.append(low)

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0][0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][1][0])

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, unit, characters before that unit) of the unit that holds a place, or of the last unit."""
        node = before = 0
        for chars, _ in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(chars) and place >= before + chars[node]:
                before += int(chars[node])
                node += 1
        while node and not self.leaves.count(node):  # emptied by an edit
            node -= 1
            before -= int(self.levels[0][0][node])
        parts = self.leaves[node]
        for i, p in enumerate(parts):
            if place < before + len(p) or i == len(parts) - 1:
                return node, i, before
            before += len(p)
        return node, 0, before

    def _set(self, leaf: int, parts: list[str], counts: np.ndarray) -> None:
        change = (sum(map(len, parts)) - int(self.levels[0][0][leaf]), int(counts.sum()) - int(self.levels[0][1][leaf]))
        self.leaves[leaf], self.counts[leaf] = parts, counts
        for level in self.levels:
            for sums, by in zip(level, change, strict=True):
                sums[leaf] += by
            leaf //= 2

    def _neighbour(self, leaf: int, unit: int, step: int) -> tuple[int, int] | None:
        unit += step
        while not 0 <= unit < self.leaves.count(leaf):
            leaf += step
            if not 0 <= leaf < len(self.leaves):
                return None
            unit = 0 if step > 0 else self.leaves.count(leaf) - 1
        return leaf, unit

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end, exclusive, by new."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        leaf, unit, before = self._find(start)
        if not self.leaves[leaf]:
            self._build(units(new))
            return
        last, last_unit, _ = self._find(max(start, end - 1))
        if left := self._neighbour(leaf, unit, -1):
            leaf, unit = left
            before -= len(self.leaves[leaf][unit])
        if right := self._neighbour(last, last_unit, 1):
            last, last_unit = right
        head, tail = self.leaves[leaf][:unit], self.leaves[last][last_unit + 1 :]
        head_n, tail_n = self.counts[leaf][:unit], self.counts[last][last_unit + 1 :]
        region = [*self.leaves[leaf][unit : last_unit + 1 if leaf == last else None], *(p for i in range(leaf + 1, last) for p in self.leaves[i]), *(self.leaves[last][: last_unit + 1] if last > leaf else ())]
        text = "".join(region)
        again = units(text[: start - before] + new + text[end - before :])
        counts = self._count(again)
        if leaf == last:
            self._set(leaf, head + again + tail, np.concatenate([head_n, counts, tail_n]))
        else:
            self._set(leaf, head + again, np.concatenate([head_n, counts]))
            for i in range(leaf + 1, last):
                self._set(i, [], counts[:0])
            self._set(last, tail, tail_n)
        if len(self.leaves[leaf]) > 4 * LEAF:
            self._build([p for x in self.leaves for p in x], np.concatenate(self.counts))


TREE = "leaves array<string>, sizes array<binary>, counts array<binary>, sums array<binary>"
_TREE = [pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary())]
EDITS = "array<struct<ord:int,start:bigint,stop:bigint,text:string>>"
RESULT = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_units long, n_reencoded long"


def build(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_chars, TREE): the tree of each document, to be written."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            trees = [TokenTree(t or "", own) for t in b.column(1).to_pylist()]
            columns = zip(*(t.kept() for t in trees), strict=True) if trees else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.chars for t in trees], pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, _TREE, strict=True))], ["doc_id", "n_chars", "leaves", "sizes", "counts", "sums"])

    return ship(spark) and docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_chars long, {TREE}")


def apply(spark: SparkSession, trees: DataFrame, vocabulary: str | None = None, keep: bool = True) -> DataFrame:
    """RESULT, and with `keep` also n_chars and TREE, of (doc_id, TREE, edits) after each tree's edits, a column of EDITS."""
    path = vocabulary or vocabulary_path()
    names = [c.split()[0] for c in f"{RESULT}, n_chars long, {TREE}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for *kept, edits in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                tree = TokenTree.read(*kept, own)
                before = tree.tokens
                for e in edits or ():
                    tree.edit(e["start"], e["stop"], e["text"] or "")
                row = [before, len(edits or ()), tree.tokens, sum(map(tree.leaves.count, range(len(tree.leaves)))), tree.encoded]
                for column, v in zip(out, [*row, tree.chars, *tree.kept()] if keep else row, strict=False):
                    column.append(v)
            kinds = [pa.int64()] * 6 + _TREE
            n = len(names) - 1 if keep else 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out[:n], kinds, strict=False))], names[: n + 1])

    slim = trees.select("doc_id", "leaves", "sizes", "counts", "sums", "edits")
    return ship(spark) and slim.mapInArrow(run, f"{RESULT}, n_chars long, {TREE}" if keep else RESULT)


def edit(spark: SparkSession, trees: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """apply() of a table of edits (doc_id, ord, start, stop, text) to kept trees."""
    one = F.struct(F.col("ord").cast("int").alias("ord"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "text")
    per = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(one)).alias("edits"))
    return apply(spark, trees.join(per, F.col("doc_id") == F.col("of"), "left"), vocabulary)


def script(n: Column) -> Column:
    """The edits that the query makes to a text of n characters, in order: a note put first, a stretch cut out, a word redacted, a line added."""
    third, half = F.floor(n / 3).cast("long"), F.floor(n / 2).cast("long")
    rows = [(F.lit(0), F.lit(0), "Draft. "), (third + 7, third + 47, ""), (half, half + 12, "[redacted]"), (n + 1000, n + 1000, "\nEnd of text.")]
    return F.array(*[F.struct(F.lit(i).alias("ord"), a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(t).alias("text")) for i, (a, b, t) in enumerate(rows)]).cast(EDITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are written; then they are read and edited."""
    trees = build(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = Workspace(spark, "token-trees").keep(trees, "trees", compression="zstd")
    return apply(spark, kept.withColumn("edits", script(F.col("n_chars"))), keep=False)
