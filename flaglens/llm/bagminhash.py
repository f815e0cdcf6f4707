"""Near-duplicate documents: BagMinHash signatures of word shingles, banded, verified by multiset overlap.

A text is the multiset of its shingles of `SHINGLE` words (lower case, letters, digits and underscores); a shorter text
with a word is one shingle. Two texts are linked when the weighted Jaccard similarity of their multisets, sum of minima
over sum of maxima, is at least `THRESHOLD`; documents joined by links form a class, named by its smallest doc_id. Texts
without any word are alike only if they are equal.

Signatures. A shingle that occurs w times owns the weight range (0, w], discretised at whole numbers and split into
(0, 1], (1, 2], (2, 4], (4, 8] and so on. Each range of each shingle has its own Poisson process, of a rate equal to its
length, drawn from a hash of shingle and range: points with a time, a weight in the range and one of `M` places. A
document sees the points whose weight is at most w, and each place of its signature is the earliest one seen there; two
documents agree at a place with probability equal to their weighted Jaccard similarity. Points after a time that depends
on the total weight alone are not drawn unless a place is still empty, so a document costs about M ln M points.

Linking, without pairs of a group. Equal texts are one text, that of the smallest doc_id. Each band of `ROWS` places is
a key; in every bucket each text is met with one hub only (that which meets most texts over all its buckets, then the
smallest id). A text is verified with the hub that it
shares most bands with, links join into classes (by labels that spread over written tables), and then with those other
hubs that are of another class still. What hubs don't settle is found exactly: buckets that still hold texts of two classes are cut into cells of at most twice `CELL` texts, and in a
cell all signatures are compared at once in numpy, of which only pairs that are estimated near the threshold or above,
and of different classes, come out and are verified. So no link that a band shows is lost, however large its bucket is.

Null texts count as empty; documents with a null doc_id take no part in a comparison and are their own class (null);
repeated rows of one doc_id with different texts are joined by their id; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.store import BROADCAST_ROWS, Workspace, fresh
from flaglens.llm.words import Words, by_chars, mix
from flaglens.llm.worker import lean
from flaglens.session import ship

SHINGLE, THRESHOLD = 5, 0.8
#: 44 bands of 8: a pair of similarity 0.8 shares a band with probability 0.9997, one of 0.85 with 0.999999.
ROWS, BANDS = 8, 44
M = ROWS * BANDS
#: A pair of similarity 0.8 is estimated at least this near (four standard deviations of M places).
ESTIMATE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / M) ** 0.5
CELL = 256
#: Pairs of a hub that are verified in one stretch of its key: a hub's text is copied once for each.
HUB_PAIRS = 512

_u = np.uint64


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((x >> _u(11)).astype(np.float64) + 0.5) * 2.0**-53


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text as hashes, ascending, and how often each occurs."""
    words = Words(texts)
    h, out, at = words.hashes(), [], 0
    for size in words.sizes.tolist():
        part, at = h[at : at + size], at + size
        sums = np.zeros(max(1, size - SHINGLE + 1) if size else 0, dtype=np.uint64)
        for i in range(min(SHINGLE, size)):
            sums = mix(sums ^ part[i : i + len(sums)])
        out.append(np.unique(sums, return_counts=True))
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """bags() of one text."""
    return bags([text])[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of counted()."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """M hashes for each bag of (shingles, counts); bags must not be empty."""
    weight = np.array([float(c.sum()) for _, c in bags])
    sign = np.full(len(bags) * M, np.inf)
    todo, spare = np.arange(len(bags)), 3.0
    while len(todo):
        limit = M * (np.log(M) + spare) / weight[todo]
        items = np.concatenate([bags[d][0] for d in todo])
        count = np.concatenate([bags[d][1] for d in todo]).astype(np.float64)
        doc = np.repeat(np.arange(len(todo)), [len(bags[d][0]) for d in todo])
        base = todo[doc] * M
        low, high, level = np.zeros(len(items)), np.ones(len(items)), 0
        while len(items):
            _points(mix(items ^ _u(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)), low, high, count, limit[doc], base, sign)
            more = count > high
            items, count, doc, base = items[more], count[more], doc[more], base[more]
            low, high, level = high[more], high[more] * 2, level + 1
        empty = np.isinf(sign.reshape(-1, M)[todo]).any(1)
        sign.reshape(-1, M)[todo[empty]] = np.inf
        todo, spare = todo[empty], spare * 2 + 3
    return mix(sign.view(np.uint64)).reshape(-1, M)


def _points(seed: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, limit: np.ndarray, base: np.ndarray, sign: np.ndarray) -> None:
    """Draw the points of one range of each item up to its limit, and lower the places that they fall on."""
    rate, time, at = high - low, np.zeros(len(seed)), np.arange(len(seed))
    while len(at):
        seed = mix(seed)
        time = time - np.log(_unit(seed)) / rate[at]
        go = time <= limit[at]
        at, time, seed = at[go], time[go], seed[go]
        other = mix(seed ^ _u(0xD6E8FEB86659FD93))
        seen = (low[at] + rate[at] * _unit(mix(other)) <= count[at]) if rate[0] > 1 or low[0] else slice(None)
        np.minimum.at(sign, (base[at] + (other % _u(M)).astype(np.int64))[seen], time[seen])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, bands, sign): band keys and a byte of each place; both null for texts without a word."""
    for b in batches:
        texts = b.column(2).to_pylist()
        for part in by_chars(texts):
            found = bags(texts[part])
            bands, sign = [None] * len(found), [None] * len(found)
            full = [i for i, bag in enumerate(found) if len(bag[0])]
            if full:
                s = signatures([found[i] for i in full])
                keys = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys ^ s[:, r * BANDS : (r + 1) * BANDS])
                keys = mix(keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                low = s.astype(np.uint8)
                for j, i in enumerate(full):
                    bands[i], sign[i] = keys[j], low[j].tobytes()
            rows = slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, rows.stop), b.column(1).slice(rows.start, rows.stop), pa.array(bands, pa.list_(pa.int64())), pa.array(sign, pa.binary())], ["doc_id", "text_hash", "bands", "sign"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, text_a, text_b) that are linked. Rows of one b mostly come in a row, so its bag is kept."""
    last, bag = None, None
    for batch in batches:
        hubs, texts, keep = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
        for part in by_chars(texts):
            for i, own in enumerate(bags([t or "" for t in texts[part]]), part.start):
                if last != hubs[i]:
                    last, bag = hubs[i], counted(batch.column(3)[i].as_py() or "")
                keep.append(similarity(own, bag) >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cell_pairs(key, table):
    """Of a cell's texts (half, id, label, sign, earlier), the pairs of two classes that look near; halves are met with each other.

    earlier: the text's keys of the bands before the cell's own, in order; not read for band 0, which has none.
    """
    rows = table.select(["half", "id", "label", "sign"]).to_pydict()
    half, ids, labels = np.array(rows["half"]), np.array(rows["id"], dtype=np.int64), np.array(rows["label"], dtype=np.int64)
    sign = np.frombuffer(b"".join(rows["sign"]), dtype=np.uint8).reshape(len(ids), M)
    band = key[3].as_py()
    earlier = table["earlier"].combine_chunks().flatten().to_numpy().reshape(len(ids), band) if band else np.zeros((len(ids), 0), dtype=np.int64)
    one = key[1].as_py() == key[2].as_py()
    a_out, b_out = [], []
    for i in np.flatnonzero(half == 0):
        equal = sign == sign[i]
        near = np.flatnonzero((equal.mean(1) >= ESTIMATE) & (labels != labels[i]) & ((ids > ids[i]) if one else (half == 1)))
        # A pair comes out of the first band that it shares only; its bucket there holds two classes as well. Whole keys
        # tell, as buckets are made by them: places may agree in the byte of a signature and not be equal.
        near = near[~(earlier[near] == earlier[i]).any(1)]
        b_out.append(ids[near])
        a_out.append(np.full(len(near), ids[i]))
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a_out, b_out))
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def spread_labels(work: Workspace, links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (a, b): the smallest id that links lead to.

    Each round an id takes the smallest label of its neighbours, then the label of that label; tables are written
    between rounds, and the rounds grow with the logarithm of the longest chain for the most part.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    edges = work.keep(both.where("id <> to").distinct(), "edges")
    labels = work.keep(edges.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("to"), "label"), "to").groupBy("id").agg(F.min("label").alias("heard"))
        new = labels.join(heard, "id").select("id", F.least("label", "heard").alias("new"), "label")
        far = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        new = new.join(far, "new", "left").select("id", F.coalesce(F.least("new", "far"), "new").alias("label"), F.col("label").alias("old"))
        new = work.keep(new, "labels")
        if new.where("label <> old").isEmpty():
            work.drop(labels, edges)
            return work.alias(new.select("id", "label"), new)
        work.drop(labels)
        labels = work.alias(new.select("id", "label"), new)


def _checked_semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, text) that ids names; ids are broadcast where there are few of them."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi")


def _linked(work: Workspace, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked. The pairs of a hub b are dealt out by HUB_PAIRS, each part with b's text."""
    pairs = work.keep(pairs.distinct(), "pairs")
    needed = work.keep(_checked_semi(texts, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))), "texts")
    cuts = work.keep(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("cuts")), "cuts")
    hot = F.broadcast(cuts.where("cuts > 1"))  # checked below
    if cuts.where("cuts > 1").count() > BROADCAST_ROWS:
        hot = cuts.where("cuts > 1")
    cut = lambda by: F.pmod(F.xxhash64(by), F.coalesce("cuts", F.lit(1)).cast("long")).cast("int")
    dealt = pairs.join(hot, "b", "left").select("a", "b", cut("a").alias("cut"))
    hubs = needed.withColumnRenamed("id", "b").join(cuts, "b").select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    with_a = dealt.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(hubs, ["b", "cut"]).select("a", "b", "text_a", "text_b")
    found = work.keep(with_b.mapInArrow(lean("bagminhash", _verify), "a long, b long"), "links")
    work.drop(needed, cuts, pairs)
    return found


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, text_id), one row per row of docs: class, and the smallest id with an equal text.

    What a hot key is joined with is a written table on both sides, so that adaptive execution can split its partition."""
    work = Workspace(ship(spark), "bagminhash")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_hash"), text.alias("text"))
    sketch = work.keep(plain.mapInArrow(lean("bagminhash", _sketch), "doc_id long, text_hash string, bands array<long>, sign binary"), "sketch", compression="none")
    firsts = work.keep(sketch.where("doc_id IS NOT NULL").groupBy("text_hash").agg(F.min("doc_id").alias("text_id")), "firsts")
    same = work.keep(sketch.select("doc_id", "text_hash").join(firsts, "text_hash").where("doc_id IS NOT NULL").select("doc_id", "text_id"), "same")
    own = sketch.where("doc_id IS NOT NULL AND bands IS NOT NULL").join(firsts.select("text_hash", F.col("text_id").alias("doc_id")), ["text_hash", "doc_id"], "left_semi")
    own = own.dropDuplicates(["text_hash", "doc_id"])  # repeated rows; the join has left one id of each text
    bands = work.keep(own.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key")), "bands", compression="none")
    sizes = work.keep(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = work.keep(bands.join(sizes, "key").select("key", "id", "n"), "shared")
    # The hub of a bucket is the text that meets most others over all its buckets: that which the others are copies of.
    ranked = shared.join(shared.groupBy("id").agg(F.sum("n").alias("degree")), "id")
    hubs = work.keep(ranked.groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub")), "hubs")
    met = shared.join(hubs, "key").where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("shared"))
    met = work.keep(met, "met")
    work.drop(sizes, shared, hubs)
    texts = plain.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    # First the hub that a text shares most bands with; then the other hubs, where that has left two classes.
    links = _linked(work, texts, met.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")))
    labels = spread_labels(work, links)
    label_of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"of_{end}"))
    apart = met.select("a", "b").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    apart = apart.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = links.unionByName(_linked(work, texts, apart))
    labels = spread_labels(work, links)
    work.drop(met)

    # Buckets that hold texts of two classes still: all their members, by cells.
    with_label = work.keep(bands.join(labels, "id", "left").select("band", "key", "id", F.coalesce("label", "id").alias("label")), "labelled", compression="none")
    work.drop(bands)
    split = with_label.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    split = work.keep(split.select("key", "n"), "split")
    rest = with_label.join(split, "key").withColumn("cuts", F.ceil(F.col("n") / CELL).cast("int"))
    rest = rest.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts").cast("long")).cast("int"))
    # A text of cut i is in the cells (i, j) and (j, i) of its bucket, that with the smaller cut first.
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    rest = rest.withColumn("other", other).select("band", "key", "id", "label", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("cut") > F.col("other")).cast("int").alias("half"))
    signs = own.select(F.col("doc_id").alias("id"), "sign", "bands")
    cells = rest.join(signs, "id").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("bands").groupBy("key", "i", "j", "band").applyInArrow(_cell_pairs, "a long, b long")
    more = _linked(work, texts, cells)
    labels = spread_labels(work, links.unionByName(more))
    work.drop_all(same, labels, sketch)
    labels = labels.withColumnRenamed("id", "text_id")
    out = same.join(labels, "text_id", "left").select("doc_id", F.coalesce("label", "text_id").alias("class_id"), "text_id")
    nobody = sketch.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"))
    return out.unionByName(nobody)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; class_id is the smallest doc_id of its class."""
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with its own columns; rows without a doc_id stay."""
    found = classes(spark, docs)
    gone_id, twice_id = fresh("gone", docs.columns), fresh("twice", docs.columns)
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(twice_id))
    n = twice.count()
    if not n:
        return kept
    hint = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
    once = kept.join(hint, F.col("doc_id") == F.col(twice_id), "left_anti")
    return once.unionByName(kept.join(hint, F.col("doc_id") == F.col(twice_id), "left_semi").dropDuplicates(["doc_id"]))
