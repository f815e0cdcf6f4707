"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index. An item is a document of an inverted index: postings of a term hold its BM25 impact on each item, divided by the
item's score for its own text, so that one threshold, `THETA`, serves all items. Numbers of items, their mean length and
in how many of them a term occurs are those of the whole benchmark. Postings are held in shards of about `SHARD` items;
a shard is sent to the executors, and every shard meets all documents. Items lie in blocks of `BLOCK`, and a term has its
highest impact on each block where it occurs at all.

Queries. A document's words are cut into stretches of S words and a passage is two stretches in a row, where S is the
length of the longest item of its length class; so any S words in a row lie within a passage. All passages are queried
by block-max WAND with that fixed threshold, as all items above it are wanted. Which blocks are live, because the block
maxima of a passage's terms add up to the threshold, is told for all passages of a batch at once in numpy. In a live
block a cursor for each term moves over its postings: cursors are kept in order of their items, the pivot is the first at
which the maxima of the lists so far reach the threshold, lists before it skip to the pivot's item, and only items that
all lists up to the pivot stand on are scored. So every item above the threshold is retrieved, for every passage.

Verification. An item's answer is its last sentence where that has some words and more come before it, its question the
rest. A retrieved item is confirmed if, near the passage, at least `OVERLAP` of the question's shingles of five words
and of the answer's words occur (each as often as in the item at most), or of all the item's shingles.

Null and empty texts match nothing, items without a word are left out, items of fewer than five words are one shingle;
a very long text takes memory in proportion to it. Matches with equal scores are ordered by item_id. Repeated rows are
separate rows with the same matches; other columns pass through, whatever their names; an empty table of either kind
gives no matches. Words are runs of letters, digits and underscores in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.store import Workspace, columns_ddl, fresh
from flaglens.llm.worker import lean
from flaglens.session import ship

K1, B = 1.2, 0.75
THETA, OVERLAP, SHINGLE = 0.6, 0.8, 5
SHARD, BLOCK = 4096, 8
BATCH_WORDS = 150_000
#: Blocks of the terms of passages, and sums of passages and blocks, that are held at once.
CELLS = 1_000_000
WORD = re.compile(r"\w+")
MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _shingles(w: list[str]) -> Counter:
    return Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()


def _share(part: Counter, whole: Counter) -> float:
    """How much of part occurs in whole."""
    return sum(min(n, whole[k]) for k, n in part.items()) / part.total() if part else 1.0


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer."""
    parts = [w for w in map(words, re.split(r"[.!?\n]+", text)) if w]
    return ([x for p in parts[:-1] for x in p], parts[-1]) if len(parts) > 1 and len(parts[-1]) >= 3 else ([x for p in parts for x in p], [])


class LengthClass:
    """The postings of the items of a shard that are of similar length."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n: int, mean: float):
        self.ids = [i for i, _ in items]
        every = [words(t) for _, t in items]
        self.stretch = max(len(w) for w in every)
        self.parts = [question_and_answer(t) for _, t in items]
        self.whole = [_shingles(w) for w in every]
        vocabulary: dict[str, int] = {}
        term, item, impact = [], [], []
        for at, w in enumerate(every):
            own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            total = sum(own.values())
            for t, x in own.items():
                term.append(vocabulary.setdefault(t, len(vocabulary)))
                item.append(at)
                impact.append(x / total)
        self.vocabulary, self.blocks = vocabulary, -(-len(items) // BLOCK)
        # Postings by term, then item; of these the highest impact of each term in each block.
        order = np.lexsort((item, term))
        term, self.items, self.impacts = np.array(term)[order], np.array(item)[order], np.array(impact)[order]
        key = term * self.blocks + self.items // BLOCK
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.key = key[starts]
        self.posting = np.append(starts, len(term))  # where the postings of a term in a block start
        self.block = self.items[starts] // BLOCK
        self.block_max = np.maximum.reduceat(self.impacts, starts)
        self.first = np.searchsorted(term[starts], np.arange(len(vocabulary) + 1))  # a term's first block
        self.top = np.maximum.reduceat(self.block_max, self.first[:-1])

    def retrieve(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(document, passage, item, score) of every item that a passage retrieves."""
        get, s, v = self.vocabulary.get, self.stretch, len(self.vocabulary)
        sizes = np.array([len(w) for w in docs])
        term = np.concatenate([np.fromiter(map(get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in docs])
        doc = np.repeat(np.arange(len(docs)), sizes)
        first = np.cumsum(sizes) - sizes
        passages = np.maximum(1, -(-sizes // s) - 1)
        base = np.cumsum(passages) - passages
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return
        term, doc = term[known], doc[known]
        at = (known - first[doc]) // s
        highest = passages[doc] - 1
        pairs = np.concatenate([(base[doc] + np.minimum(at, highest)) * v + term, (base[doc] + np.clip(at - 1, 0, highest)) * v + term])
        pairs = np.unique(pairs)
        passage, term = pairs // v, pairs % v
        good = np.bincount(passage, self.top[term])[passage] >= THETA
        passage, term = passage[good], term[good]
        if not len(passage):
            return
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(passage))
        spread = np.cumsum(self.first[term + 1] - self.first[term])  # blocks of all terms so far
        lo = 0
        while lo < len(starts):
            # As many passages as have CELLS blocks to add up, and sums to hold, at most; one passage at least.
            begun = spread[starts[lo] - 1] if starts[lo] else 0
            hi = min(int(np.searchsorted(spread[ends - 1], begun + CELLS, side="right")), lo + CELLS // self.blocks)
            hi = max(lo + 1, hi)
            for i, block in self._live(passage[starts[lo] : ends[hi - 1]], term[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]):
                p = int(passage[starts[lo + i]])
                d = int(np.searchsorted(base, p, side="right")) - 1
                for item, score in self._pivot(term[starts[lo + i] : ends[lo + i]], block):
                    yield d, p - int(base[d]), item, score
            lo = hi

    def _live(self, passage: np.ndarray, term: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(number of the passage, block) where block maxima reach the threshold; starts: where each passage's terms start."""
        n = self.first[term + 1] - self.first[term]
        stop = np.cumsum(n)
        entry = np.arange(int(stop[-1])) + np.repeat(self.first[term] - (stop - n), n)
        which = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(term)))
        sums = np.bincount(np.repeat(which, n) * self.blocks + self.block[entry], self.block_max[entry], len(starts) * self.blocks)
        for at in np.flatnonzero(sums >= THETA - 1e-9).tolist():
            yield divmod(at, self.blocks)

    def _pivot(self, terms: np.ndarray, block: int) -> Iterator[tuple[int, float]]:
        """WAND within a block: (item, score) of its items that reach the threshold."""
        key = terms * self.blocks + block
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = at[self.key[at] == key]
        # [item now, most that the list adds, place in the postings, its end]
        cursors = [list(c) for c in zip(self.items[self.posting[at]].tolist(), self.block_max[at].tolist(), self.posting[at].tolist(), self.posting[at + 1].tolist(), strict=True)]

        def move(c: list, item: int) -> None:
            """To the list's first posting of this item or a later one."""
            while c[2] < c[3] and self.items[c[2]] < item:
                c[2] += 1
            c[0] = int(self.items[c[2]]) if c[2] < c[3] else -1

        while cursors:
            cursors.sort()
            most, pivot = 0.0, None
            for i, c in enumerate(cursors):
                most += c[1]
                if most >= THETA - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                return
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                on = [c for c in cursors if c[0] == item]
                score = float(sum(self.impacts[c[2]] for c in on))
                if score >= THETA:
                    yield item, score
                for c in on:
                    move(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    move(c, item)
            cursors = [c for c in cursors if c[0] >= 0]

    def confirm(self, w: list[str], passage: int, item: int) -> tuple[float, float] | None:
        """The overlaps of an item's question and answer near a passage, if they confirm it."""
        near = w[max(0, (passage - 1) * self.stretch) : (passage + 3) * self.stretch]
        there, (question, answer) = _shingles(near), self.parts[item]
        q, a = _share(_shingles(question), there), _share(Counter(answer), Counter(near))
        return (q, a) if q >= OVERLAP and a >= OVERLAP or _share(self.whole[item], there) >= OVERLAP else None


def build(items: list[tuple[int | None, str]], df: dict[str, int] | None = None, n: int = 0, mean: float = 0.0) -> list[LengthClass]:
    """The index of a shard, by classes of length that grow fourfold; df, n and mean are those of all items, which are
    these where not given."""
    items = [(i, t) for i, t in items if words(t)]
    if not items:
        return []
    if df is None:
        df, n = Counter(t for _, x in items for t in set(words(x))), len(items)
        mean = sum(len(words(t)) for _, t in items) / n
    by: dict[int, list] = {}
    for i, t in items:
        by.setdefault(int(np.ceil(np.log(max(1, len(words(t)) / 16)) / np.log(4))), []).append((i, t))
    return [LengthClass(x, df, n, mean) for _, x in sorted(by.items())]


def matches(index: list[LengthClass], texts: list[str | None]) -> list[list[dict]]:
    """The confirmed items of each text, each once with its best score, in order of score."""
    docs = [words(t) for t in texts]
    found: list[dict] = [{} for _ in docs]
    full = [i for i, w in enumerate(docs) if w]
    for part in index if full else []:
        for d, passage, item, score in part.retrieve([docs[i] for i in full]):
            d, key = full[d], (id(part), item)
            ok = part.confirm(docs[d], passage, item)
            if ok and (key not in found[d] or (ok, score) > (found[d][key][0], found[d][key][1]["score"])):
                found[d][key] = ok, {"item_id": part.ids[item], "score": min(1.0, score), "question_overlap": ok[0], "answer_overlap": ok[1]}
    return [sorted((m for _, m in x.values()), key=lambda m: (-m["score"], m["item_id"] is None, m["item_id"])) for x in found]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, length) of each distinct term of each item; a null term with the item's length once an item."""
    for b in batches:
        rows = [(shard, t, n) for shard, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in [words(text)] if w for t, n in [(None, len(w)), *((t, 0) for t in set(w))]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], ["shard", "term", "length"])


def flag(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`, MATCHES, of confirmed items; one pass over docs for each shard of items."""
    work = Workspace(ship(spark), "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    shards = -(-items.count() // SHARD)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))))
    out = docs.withColumn(name, F.array().cast(MATCHES))
    if not shards:
        return out
    terms = items.select("shard", "text").mapInArrow(_terms, "shard long, term string, length long").groupBy("shard", "term").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    terms = work.keep(terms, "terms")
    df = terms.groupBy("term").agg(F.sum("n").alias("df"), F.sum("length").alias("length"))
    of_shards = work.keep(terms.select("shard", "term").join(df.withColumnRenamed("term", "of"), F.col("term").eqNullSafe(F.col("of"))).select("shard", "term", "df", "length"), "df")
    for i in range(shards):
        # About SHARD items and their terms; the null term has the number and the length of all items.
        known = {r["term"]: (r["df"], r["length"]) for r in of_shards.where(F.col("shard") == i).collect()}
        n, length = known.pop(None, (0, 0))
        rows = items.where(F.col("shard") == i).orderBy("item_id", "text").collect()
        index = build([(r["item_id"], r["text"]) for r in rows], {t: k for t, (k, _) in known.items()}, n, length / max(1, n))
        out = _meet(spark, out, spark.sparkContext.broadcast(index), name)
    work.drop_all()
    return out


def _meet(spark: SparkSession, docs: DataFrame, index, name: str) -> DataFrame:
    place = [c.lower() for c in docs.columns].index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, had, added = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), []
            lo = size = 0
            for hi, t in enumerate(texts, 1):
                size += len(t or "") // 6 + 1
                if size >= BATCH_WORDS or hi == len(texts):
                    added += matches(index.value, texts[lo:hi])
                    lo, size = hi, 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x + y for x, y in zip(had, added, strict=True)], kind)], b.schema.names)

    return docs.mapInArrow(lean("decontaminate", run), columns_ddl(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = flag(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "m").select("doc_id", F.explode("m").alias("m"))
    return found.select("doc_id", "m.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    name = fresh("matches", docs.columns)
    return flag(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name).where(F.size(name) == 0).select(*docs.columns)
