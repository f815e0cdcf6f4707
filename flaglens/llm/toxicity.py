"""Toxicity scores from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (`NGRAMS` long, with word ends marked) and of itself, all
hashed into `BUCKETS` rows; a text is the average of its words and of `NEUTRAL` words that say nothing, so that a few
words don't tell more than a long text; a linear softmax reads that average. Rows count by smooth inverse frequency,
`RARE` / (`RARE` + the row's share of the sample), as else the commonest words would make up the average, and less where
few texts of the sample hold them, n^2 / (n^2 + `FEW`^2), as else chance finds of one text would count. Vectors and
softmax are fitted together by Adam on the mean log loss, with both classes weighing the same. A misspelling that no
text of the sample holds still shares n-grams with the words it stands for.

Scoring takes whole texts. As averages and softmax are linear, an n-gram's vector, its weight and the softmax fold into
one number for scoring.

The model is fitted on the driver on at most `SAMPLE` labelled documents, half of them toxic where there are as many,
chosen by a hash of doc_id from those whose crc32(doc_id as text) mod 5 isn't 0; that bound is a parameter. `FOLDS`
models are fitted, each without a fold of the sample, and their mean is used; the scores of both classes by the model
that wasn't fitted on them set the bias (see threshold). Where these scores don't tell the classes apart, as with very
few examples, the bias is above all of them. Everything else covers all rows. Labels, lang, source and doc_id are no
inputs of a score.

Null and empty texts score as an average of nothing does; very long texts take memory in proportion to one text. Without
labelled rows of both classes every score is 0. Repeated rows get the same score, ties are equal scores; of sampled rows
that share a doc_id the greatest text is fitted on, so repeats don't grow the sample. Rows with a null doc_id are
treated as if the id were the text "null" (not held out). An empty table gives an empty result; other columns are not
read, and those that `score` keeps clash with none of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.store import columns_ddl, fresh
from flaglens.llm.words import Words, by_chars, subwords
from flaglens.llm.worker import lean
from flaglens.session import ship

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
NEUTRAL = 50
RARE, FEW = 3e-5, 10
SAMPLE = 3000
FOLDS = 4
STEPS = 100
#: Characters of the texts whose n-grams are held at once.
CHARS = 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def _shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, row, share): how much of each text's average its n-grams make up, each once for a text."""
    words = Words(texts, with_letter=True)
    row, word = subwords(words, NGRAMS, BUCKETS)
    of = np.bincount(word, minlength=len(words.text)) * (words.sizes[words.text] + NEUTRAL)
    key, at = np.unique(words.text[word] * BUCKETS + row, return_inverse=True)
    return key // BUCKETS, (key % BUCKETS).astype(np.int32), np.bincount(at, 1 / of[word], len(key)).astype(np.float32)


class Bags:
    """Texts as rows of a sparse matrix of shares, by text and by n-gram row."""

    def __init__(self, texts: list[str]):
        parts = [(p.start, _shares(texts[p])) for p in by_chars(texts, CHARS)]
        text = np.concatenate([at + t for at, (t, _, _) in parts]).astype(np.int32)
        self.row, self.share = np.concatenate([r for _, (_, r, _) in parts]), np.concatenate([s for _, (_, _, s) in parts])
        parts.clear()
        self.n, self.texts, self.starts = len(texts), *_runs(text)
        order = np.argsort(self.row, kind="stable").astype(np.int32)
        self.text_of, self.rows, self.row_starts = text[order], *_runs(self.row[order])
        self.share_of = self.share[order]
        weight = np.zeros(BUCKETS)
        weight[self.rows] = np.add.reduceat(self.share_of, self.row_starts) if len(self.rows) else 0
        of = np.zeros(BUCKETS)
        of[self.rows] = np.diff(self.row_starts, append=len(self.share_of))
        self.weight = RARE / (RARE + weight / max(1, self.n)) * of**2 / (of**2 + FEW**2)

    def averages(self, by_row: np.ndarray) -> np.ndarray:
        """The weighted average of a number of each row over each text."""
        out = np.zeros(self.n)
        if len(self.texts):
            out[self.texts] = np.add.reduceat(self.share * (by_row * self.weight).astype(np.float32)[self.row], self.starts)
        return out

    def back(self, by_text: np.ndarray) -> np.ndarray:
        """The transpose: what each row gets from a number of each text."""
        out = np.zeros(BUCKETS)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(self.share_of * by_text.astype(np.float32)[self.text_of], self.row_starts)
        return out * self.weight


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array and where each starts."""
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    return x[starts], starts


class _Adam:
    """Adam; `together`: with one scale for the whole array, so that what few documents ask for moves little."""

    def __init__(self, x: np.ndarray, rate: float, together: bool = False):
        self.x, self.rate, self.together, self.m, self.v, self.t = x, rate, together, np.zeros_like(x), 0.0, 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v = self.v + 0.01 * (((g * g).max() if self.together else g * g) - self.v)
        self.x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-12)


class Model:
    """`ngram`: what each row adds to the log odds; `bias`: the log odds of a text without words."""

    def __init__(self, ngram: np.ndarray, bias: float):
        self.ngram, self.bias = ngram, bias

    def odds(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for part in by_chars(texts, CHARS):
            words = Words(texts[part], with_letter=True)
            row, word = subwords(words, NGRAMS, BUCKETS)
            n = len(words.text)
            each = np.bincount(word, self.ngram[row], n) / np.bincount(word, minlength=n)
            out[part] += np.bincount(words.text, each, part.stop - part.start) / (words.sizes + NEUTRAL)
        return out


def loss_and_gradients(bags: Bags, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The weighted log loss and what it changes by with the vectors, the softmax and its bias.

    With two classes only the difference of the softmax's columns counts, so texts' averages are taken of one number a row.
    """
    apart = soft[:, 1] - soft[:, 0]
    z = bags.averages(vectors @ apart) + bias[1] - bias[0]
    loss = float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
    d = (1 / (1 + np.exp(-z)) - y) * weight
    rows = bags.back(d)
    toward = vectors.T @ rows
    return loss, np.outer(rows, apart), np.stack([-toward, toward], 1), np.array([-d.sum(), d.sum()])


def fit(bags: Bags, y: np.ndarray, use: np.ndarray, seed: int = 3) -> Model | None:
    """Fitted on the texts that `use` marks; None if these aren't of two classes."""
    n = [int((use & (y == k)).sum()) for k in (0, 1)]
    if not all(n):
        return None
    weight = np.where(use, np.where(y == 1, 0.5 / n[1], 0.5 / n[0]), 0.0)
    vectors, soft, bias = np.random.default_rng(seed).normal(0, 0.02, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2)
    soft[0] = -0.5, 0.5
    adams = [_Adam(vectors, 1.0, together=True), _Adam(soft, 0.03), _Adam(bias, 0.03)]
    for _ in range(STEPS):
        for adam, g in zip(adams, loss_and_gradients(bags, y, weight, vectors, soft, bias)[1:], strict=True):
            adam.step(g)
    return Model((vectors @ (soft[:, 1] - soft[:, 0])) * bags.weight, float(bias[1] - bias[0]))


def threshold(odds: np.ndarray, toxic: np.ndarray) -> float:
    """The log odds from which on a document counts as toxic, halfway between two of these.

    It is that with the most of the toxic documents found less the share of clean ones lost, both shrunk towards a half
    by two made-up documents and lowered by two standard errors; if that is nowhere above 0, it is above all odds.
    """
    values = np.unique(odds)
    cuts = (values[1:] + values[:-1]) / 2
    share, noise = [], 0.0
    for y in (1, 0):
        of = np.sort(odds[toxic == y])
        share.append((len(of) - np.searchsorted(of, cuts) + 1) / (len(of) + 2))
        noise = noise + share[-1] * (1 - share[-1]) / (len(of) + 2)
    gain = share[0] - share[1] - 2 * np.sqrt(noise)
    return float(cuts[gain.argmax()]) if len(cuts) and gain.max() > 0 else float(values[-1]) + 1e-6


def cross_fit(ids: list[int], texts: list[str], toxic: list[int]) -> Model | None:
    """The mean of the models of all folds, with the bias set; None if no fold has two classes to be fitted on."""
    fold, y = np.array([zlib.crc32(f"aside:{i}".encode()) % FOLDS for i in ids]), np.array(toxic)
    if len(set(toxic)) < 2:
        return None
    bags, models = Bags(texts), []
    odds = np.full(len(ids), np.nan)
    for k in range(FOLDS):
        model = fit(bags, y, fold != k)
        if model is not None:
            models.append(model)
            aside = np.flatnonzero(fold == k)
            odds[aside] = model.odds([texts[i] for i in aside])
    if not models:
        return None
    scored = ~np.isnan(odds)
    cut = threshold(odds[scored], y[scored]) if scored.any() else 0.0
    return Model(np.mean([m.ngram for m in models], axis=0), float(np.mean([m.bias for m in models])) - cut)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labelled documents that aren't held out: a row for each doc_id."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id IS NOT NULL AND _toxic IN (0, 1)")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = F.xxhash64(F.col("_id"), F.lit(11))
    sample = None
    for label in (0, 1):
        part = known.where(F.col("_toxic") == label).orderBy(order, "_id").limit(SAMPLE // 2)
        sample = part if sample is None else sample.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = found.groupBy("_id", "_toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()  # at most SAMPLE
    rows.sort(key=lambda r: r["_id"])
    return cross_fit([r["_id"] for r in rows], [r["text"] for r in rows], [r["_toxic"] for r in rows])


def score(spark: SparkSession, docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns in `keep`, then score and predicted, under names that clash with none of them."""
    names = [fresh("score", keep), fresh("predicted", keep)]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]))
    shared = ship(spark).sparkContext.broadcast(model)  # BUCKETS doubles, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = shared.value.odds([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names[:-1], *names])

    slim = docs.select(*keep, F.col("text").alias(fresh("text", keep)))
    return slim.mapInArrow(lean("toxicity", run), f"{columns_ddl(slim.select(*keep))}, `{names[0]}` double, `{names[1]}` int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(spark, docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with their own columns."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(spark, docs, model, docs.columns).where(F.col(fresh("predicted", docs.columns)) == 0).select(*docs.columns)
