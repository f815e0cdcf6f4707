"""Token-id files: canonical length-limited Huffman codes of ids, in blocks that decode on their own.

A file is a folder with three Parquet tables, so that it lies in any store that Spark writes to and its writing
survives lost executors:

* `codebook`: one row, `lengths`, a byte for each id: the bits of its canonical code (0: the id doesn't occur);
* `blocks`: in each part, documents in ascending order of doc_id; a row is a block of whole documents, closed at
  `BLOCK` ids or more: part, block, offset (ids in the part before it), doc_ids, doc_tokens (ids of each), payload
  (codes in a row, highest bit first) and checkpoints (unsigned 32-bit little-endian: the bit at which every `EVERY`-th
  id starts);
* `parts`: part, base: ids in all parts before it.

Writing takes two passes: texts are encoded once, and their ids kept and counted; the counts over all documents give the
codebook; ids move to ranges of doc_id, are sorted and packed. The codebook and the parts, one row for an id of the
vocabulary or a part, are all that reaches the driver. Reading unpacks by table look-up, all stretches between
checkpoints of a block together.

Null and empty texts hold the end id alone. Rows with a null doc_id come first; rows that share a doc_id are ordered by
a hash of their ids, then by these, and may lie in several parts. A text and its ids are held whole in memory. An empty table gives a file without blocks and an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.encoding import encoder
from flaglens.llm.huffman import Codebook, code_lengths
from flaglens.llm.store import Workspace
from flaglens.llm.worker import lean
from flaglens.session import ship

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
BLOCK, EVERY = 1 << 16, 128
#: Pieces that a worker keeps, twice over, at about 50 bytes each; fewer cost only time.
KEPT = 300_000
#: Bytes of texts that are encoded together.
HELD = 6 << 20
#: Tasks that add up the vectors of all others.
MERGERS = 8
#: Blocks whose lanes are decoded together.
TOGETHER = 8
BLOCKS = "part int, block int, offset long, doc_ids array<long>, doc_tokens array<int>, payload binary, checkpoints binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _squeeze(raw: bytes, width: int) -> bytes:
    """Ids by byte place, compressed: for the way from the encoders to the sorted parts alone."""
    return zstandard.compress(np.frombuffer(raw, dtype=np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unsqueeze(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _groups(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in a row that have `held` bytes together, or little more."""
    group: list[pa.RecordBatch] = []
    for b in batches:
        group.append(b)
        if sum(x.nbytes for x in group) >= held:
            yield group
            group = []
    if group:
        yield group


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, remembered: int = KEPT, held: int = HELD) -> tuple[DataFrame, int]:
    """(doc_id, ids, counts): the squeezed ids of every document with the end id, and a row of counts alone for each task, how
    often each id occurs in its documents; and the bytes of an id."""
    path = vocabulary or vocabulary_path()
    width = encoder(path).dtype.itemsize
    names, kinds = ["doc_id", "ids", "counts"], (pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, remembered)
        end, counts = np.array([end_id], dtype=own.dtype).tobytes(), np.zeros(max(len(own.starts), end_id + 1), dtype=np.int64)
        for group in _groups(batches, held):
            ids = own.encode([t or "" for b in group for t in b.column(1).to_pylist()])
            for b in group:
                some, ids = ids[: b.num_rows], ids[b.num_rows :]
                counts += np.bincount(np.frombuffer(b"".join(some), dtype=own.dtype), minlength=len(counts))
                counts[end_id] += len(some)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_squeeze(x + end, width) for x in some], pa.binary()), pa.nulls(len(some), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, zstandard.compress(counts.tobytes(), 1)), kinds, strict=True)], names)

    return ship(spark) and docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean("encoding", run), "doc_id long, ids binary, counts binary"), width


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: the tasks' vectors, added up by groups of tasks, then on the driver."""

    def of(vectors: Iterator[bytes]) -> np.ndarray:
        total = np.zeros(1, dtype=np.int64)
        for v in vectors:
            total = total + np.frombuffer(zstandard.decompress(v), dtype=np.int64)
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(x.as_py() for b in batches for x in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], ["counts"])

    tasks = ids.where("counts IS NOT NULL").select("counts")
    merged = tasks.repartition(MERGERS).mapInArrow(lean("token_file", add), "counts binary").collect()  # a vector of the vocabulary each
    return of(bytes(r["counts"]) for r in merged)


def write(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, remembered: int = KEPT, held: int = HELD) -> None:
    work = Workspace(spark, "tokens")
    encoded, width = encode(spark, docs, vocabulary, end_id, remembered, held)
    ids = work.keep(encoded, "ids", compression="none")
    lengths = code_lengths(count_ids(ids))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part = Codebook(book.value), TaskContext.get().partitionId()
        block = offset = waiting = 0
        doc_ids: list = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            payload, points = codes.pack(np.concatenate(held), EVERY)
            row = [[part], [block], [offset], [doc_ids], [[len(x) for x in held]], [payload], [points.astype("<u4").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        for b in batches:
            for doc_id, squeezed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append(_unsqueeze(squeezed.as_py(), width))
                doc_ids.append(doc_id)
                waiting += len(held[-1])
                if waiting >= BLOCK:
                    yield close()
                    block, offset, waiting, doc_ids, held = block + 1, offset + waiting, 0, [], []
        if held:
            yield close()

    # Rows of one doc_id can go to several parts; equal rows are in any order.
    keyed = ids.where("ids IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "ids")
    ordered.select("doc_id", "ids").mapInArrow(lean("token_file", pack), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    work.drop(ids)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    tokens = F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(tokens).alias("n")).orderBy("part").collect()
    bases = np.cumsum([0, *[r["n"] for r in parts]]).tolist()
    spark.createDataFrame([(r["part"], b) for r, b in zip(parts, bases, strict=False)], "part int, base long").coalesce(1).write.parquet(f"{path}/parts")


_NAMES = ["part", "block", "offset", "doc_ids", "doc_tokens", "payload", "checkpoints"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def read(spark: SparkSession, path: str, each, columns: str) -> DataFrame:
    """Rows (part, doc_id, start, n_tokens, then each(ids)'s columns) of every document of a file, unpacked from it."""
    rows = spark.read.parquet(f"{path}/codebook").collect()
    book = spark.sparkContext.broadcast(np.frombuffer(bytes(rows[0]["lengths"]), dtype=np.uint8))
    fields = ["doc_id", "part", "offset", "n_tokens", *[c.split()[0] for c in columns.split(",")]]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codebook(book.value)
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER).to_pylist()
                points = [np.frombuffer(r["checkpoints"], dtype="<u4") for r in part]
                out: list[list] = [[] for _ in fields]
                for r, ids in zip(part, codes.unpack([r["payload"] for r in part], points, [sum(r["doc_tokens"]) for r in part], EVERY), strict=True):
                    at = 0
                    for doc_id, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
                        for column, v in zip(out, (doc_id, r["part"], r["offset"] + at, n, *each(ids[at : at + n])), strict=True):
                            column.append(v)
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[None] * (len(fields) - 4)], strict=True)], fields)

    found = ship(spark) and spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(lean("token_file", unpack), f"doc_id long, part int, offset long, n_tokens long, {columns}")
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts").withColumnRenamed("part", "_part")
    # One row for each part of the file.
    found = found.join(F.broadcast(parts), F.col("part") == F.col("_part")).withColumn("start", F.col("base") + F.col("offset"))
    return found.select("doc_id", "start", "n_tokens", *fields[4:])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>)."""
    return read(spark, path, lambda ids: (ids.astype(np.int64).tolist(),), "ids array<long>")


def digest(spark: SparkSession, docs: DataFrame, remembered: int = KEPT, held: int = HELD) -> DataFrame:
    """Write docs to a file and read it back: (doc_id, start, n_tokens, ids_crc32)."""
    path = Workspace(spark, "token-file").path("file")
    write(spark, docs.select("doc_id", "text"), path, remembered=remembered, held=held)
    return read(spark, path, lambda ids: (zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")),), "ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token file of docs. Workers hold fewer pieces and texts, as executors have come by memory in earlier stages."""
    return digest(spark, docs, KEPT * 2 // 3, HELD * 2 // 3)
