"""Exact top-k inner products by a vector-approximation file.

Components become integers, floor(1024 * x). Each dimension's range over all vectors is cut into `CELLS` intervals of
equal width, and the file holds one byte a component, the cell, beside the exact vector in a column of its own. A
query set runs against all rows, in blocks of about `QUERY_BLOCK` queries, in two scans a block:

1. over cells alone: cell edges give a lower and an upper bound of every inner product; the k-th highest lower bound
   that any partition finds is a score that the query's k-th result reaches for certain;
2. over cells again: rows whose upper bound doesn't reach that score are passed over; for the others the exact vectors
   are read in descending order of the bound, until the next bound is below the k-th exact score found.

Bounds carry a slack for rounding, so results are exact; scores are exact integers (held within 64 bits). Ties go to
the smaller vec_id. Vectors that are null or hold null, NaN or infinite components take no part, and neither do rows
without a vec_id; vectors of different length don't meet. Repeated rows are candidates each for itself; of rows that
share a query's vec_id the query is the lowest vector, and none of them is its candidate. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flaglens.llm.store import Workspace
from flaglens.session import ship

SCALE = 1024
CELLS = 64
QUERY_BLOCK = 2048
#: Rows whose bounds are computed at once: QUERY_BLOCK * SLICE doubles, 32 MB.
SLICE = 2048
#: Exact vectors read at once for a query, in order of their bounds.
STEP = 64
RESULT = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return df.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, matrix) for each length of list in the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    lengths, values = np.diff(offsets), np.asarray(column.values)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, values[offsets[at][:, None] + np.arange(d)]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest component of each dimension in a partition."""
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, m in _rows(b.column(0)):
            low[d] = np.minimum(low[d], m.min(0)) if d in low else m.min(0)
            high[d] = np.maximum(high[d], m.max(0)) if d in high else m.max(0)
    for d in low:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(low[d], pa.int64()), pa.array(high[d], pa.int64())], ["d", "i", "low", "high"])


def _grid(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions, where the cells of each dimension start and how wide they are."""
    found = df.select("v").mapInArrow(_edges, "d int, i int, low long, high long").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    grid = {}
    for d in {r["d"] for r in found}:
        rows = sorted((r for r in found if r["d"] == d), key=lambda r: r["i"])
        low, high = np.array([float(r["low"]) for r in rows]), np.array([float(r["high"]) for r in rows])
        grid[d] = (low, np.maximum(1.0, np.ceil((high - low + 1) / CELLS)))
    return grid


def build(spark: SparkSession, vectors: DataFrame, work: Workspace) -> tuple[DataFrame, dict]:
    """The file, (vec_id, d, cells, v), and its grid."""
    exact = work.keep(integers(vectors), "vectors")
    grid = _grid(exact)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [b""] * b.num_rows, np.zeros(b.num_rows, dtype=np.int32)
            for d, at, m in _rows(b.column(1)):
                if d:
                    low, width = grid[d]
                    cell = np.clip((m.astype(np.float64) - low) // width, 0, CELLS - 1).astype(np.uint8)
                    for i, row in zip(at, cell, strict=True):
                        out[i] = row.tobytes()
                dims[at] = d
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims), pa.array(out, pa.binary()), b.column(1)], ["vec_id", "d", "cells", "v"])

    file = work.keep(exact.mapInArrow(cells, "vec_id long, d int, cells binary, v array<long>"), "vafile")
    work.drop(exact)
    return file, grid


class _Block:
    """The queries of a block that have the same number of dimensions, and the bounds that they give."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray):
        self.ids, self.exact = ids, q
        x = q.astype(np.float64)
        self.up, self.down, self.low, self.width = np.maximum(x, 0), np.minimum(x, 0), low, width
        self.slack = 1e-12 * (np.abs(x) @ np.maximum(np.abs(low), np.abs(low + CELLS * width))) if len(low) else np.zeros(len(ids))

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self.low + cells * self.width
        high = low + self.width - 1
        return self.up @ low.T + self.down @ high.T - self.slack[:, None], self.up @ high.T + self.down @ low.T + self.slack[:, None]


def _blocks(rows: list, grid: dict) -> dict[int, _Block]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r)
    return {d: _Block(np.array([r["vec_id"] for r in rs], dtype=np.int64), np.array([r["v"] for r in rs], dtype=np.int64).reshape(len(rs), d), *(grid[d] if d in grid else (np.zeros(0), np.zeros(0)))) for d, rs in by.items()}


def _slices(b: pa.RecordBatch, blocks: dict[int, _Block]) -> Iterator[tuple[_Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, rows of the batch, their ids, their cells), SLICE rows at a time."""
    ids, dims = np.asarray(b.column(0)), np.asarray(b.column(1))
    for d in np.unique(dims):
        if int(d) in blocks:
            at = np.flatnonzero(dims == d)
            raw = b.column(2)
            for i in range(0, len(at), SLICE):
                part = at[i : i + SLICE]
                yield blocks[int(d)], part, ids[part], np.frombuffer(b"".join(raw[int(j)].as_py() for j in part), dtype=np.uint8).reshape(len(part), int(d))


def _inner(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, held within 64 bits."""
    if rows.size and float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).sum()) >= 2**62:
        return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in rows], dtype=np.int64)
    return rows @ q


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """RESULT: for each row that is_query (a Column) selects, its k best other rows."""
    work = Workspace(ship(spark), "vafile")
    file, grid = build(spark, vectors, work)
    queries = file.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = -(-queries.count() // QUERY_BLOCK)
    queries = work.keep(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks)))), "queries")
    out = work.path("results")
    for i in range(n_blocks):
        blocks = spark.sparkContext.broadcast(_blocks(queries.where(F.col("block") == i).select("vec_id", "v").collect(), grid))
        _search_block(file, blocks, k).write.mode("append").parquet(out)
        blocks.destroy()
    like = spark.createDataFrame([], RESULT)
    return work.read(out, like) if n_blocks else like


def _search_block(file: DataFrame, blocks, k: int) -> DataFrame:
    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for block, _, ids, cells in _slices(b, blocks.value):
                low, _ = block.bounds(cells)
                low[block.ids[:, None] == ids[None, :]] = -np.inf
                d = cells.shape[1]
                low = np.hstack([best[d], low]) if d in best else low
                best[d] = -np.partition(-low, k - 1, axis=1)[:, :k] if low.shape[1] > k else low
        for d, low in best.items():
            if low.shape[1] >= k:
                yield pa.RecordBatch.from_arrays([pa.array(blocks.value[d].ids), pa.array(low.min(1))], ["query_id", "least"])

    least = dict(file.select("vec_id", "d", "cells").mapInArrow(certain, "query_id long, least double").groupBy("query_id").agg(F.max("least")).collect())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for block, part, ids, cells in _slices(b, blocks.value):
                _, high = block.bounds(cells)
                floor = np.array([max(least.get(int(q), -np.inf), found[q][-1][0] if len(found.get(int(q), ())) >= k else -np.inf) for q in block.ids])
                high[block.ids[:, None] == ids[None, :]] = -np.inf
                some = high >= floor[:, None]
                some &= high > -np.inf
                if not some.any():
                    continue
                used = np.flatnonzero(some.any(0))
                vectors = np.zeros((len(part), cells.shape[1]), dtype=np.int64)
                for j in used:
                    vectors[j] = b.column(3)[int(part[j])].values.to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(some.any(1)):
                    q, at = int(block.ids[i]), np.flatnonzero(some[i])
                    at = at[np.argsort(-high[i, at], kind="stable")]
                    top = found.setdefault(q, [])
                    for j in range(0, len(at), STEP):
                        now = at[j : j + STEP]
                        if len(top) >= k and high[i, now[0]] < top[-1][0]:
                            break
                        scores = _inner(vectors[now], block.exact[i])
                        top.extend(zip(scores.tolist(), (-ids[now]).tolist(), strict=True))
                        top.sort(reverse=True)
                        del top[k:]
        rows = [(q, -v, s) for q, top in found.items() for s, v in top]
        if rows:
            q, v, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    near = file.select("vec_id", "d", "cells", "v").mapInArrow(exact, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM q, e WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
