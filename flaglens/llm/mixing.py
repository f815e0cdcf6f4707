"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). The mix as a whole takes `share` times all words, divided by
weight; a source is clamped at `max_epochs` times its size and its excess goes to the others by weight, until
none is above its cap: each pour sums caps and weights of the sources that the level before clamps and of those that
it doesn't, and the level that follows is higher, until no more are clamped. Sources are ranked by ranges of their
names, so that none of this needs them in one task.

A target is then met by whole repetitions of every document of the source plus a seeded choice of rows for the
fraction: rows are ordered by a hash of seed and doc_id, then size, then a hash of the text, and the prefix whose words
come nearest to the fraction takes one more repetition. The prefix is found in three steps, sums of hash buckets
first, then of the places in the one bucket that holds the boundary, then rows of the one place that does, so no source
is ever ordered as a whole; rows that are equal in all of this are counted by parts of them, as any may be taken.

Nulls and odd rows: a null or empty text has size 0 and takes 0; a null source is a source of its own, ordered
last; a null doc_id hashes as the text "null"; repeated rows with one doc_id are separate rows, and as many of them are
taken as come nearest to the target; a very long text counts as any other; an empty table gives an empty result. Other
columns pass through `mix` under whatever name; `plan_documents` reads doc_id, text and source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flaglens.llm.store import BROADCAST_ROWS, Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the hash that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: Parts that equal rows are counted in.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(work: Workspace, sized: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target), one row per source, from rows of (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    # The id that counts rows has the partition above its 33rd bit and the row's place in the partition below.
    per = work.keep(per.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = 0
    offset = F.lit(0)
    for row in per.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one for each partition
        offset = F.when(part == row["part"], F.lit(before)).otherwise(offset)
        before += row["n"]
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.select("source", "source_size", F.element_at(cycle, ((offset + place) % len(weights) + 1).cast("int")).alias("weight"))
    per = work.keep(per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "weighted")
    level, clamped = -1.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        when = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
        r = per.agg(F.count(F.when(over, 1)).alias("n"), when(over, F.col("cap")).alias("caps"), when(~over, F.col("weight")).alias("free"), F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0)).alias("all")).first()
        if r["n"] == clamped or not r["free"]:
            break
        level, clamped = (r["all"] * share - r["caps"]) / r["free"], r["n"]
    return per.select("source", "source_size", "weight", F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _order_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan_sources(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash, place) of every row, and (s, source_size, target, whole, last, left) of every source,
    hinted to be broadcast where the sources are few: the place in which the fraction ends and the words left for it."""
    work = Workspace(spark, "mix")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    slim = work.keep(slim.withColumn("place", _order_key(seed)), "sizes")
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    targets = source_targets(work, slim.select("source", "size"), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = work.keep(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    # The bucket in which each source's fraction ends, and the words before it: at most 4096 sums a source.
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    small = targets.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    ends = sums.withColumn("before", F.coalesce(running, F.lit(0)))
    plan = targets.withColumnRenamed("source", "s")
    ends = ends.join(hint(plan), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("rest") > 0) & (F.col("before") < F.col("rest")))
    ends = ends.groupBy("s").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("edge"))
    ends = work.keep(ends.select("s", "edge.bucket", "edge.before"), "edges")

    # Places of the boundary buckets alone are ordered, to find the last one of which something is taken.
    at = slim.join(hint(ends.withColumnRenamed("bucket", "edge")), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("edge")))
    at = at.groupBy("s", "place", "before").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("ahead", F.col("before") + ahead).join(hint(targets.select(F.col("source").alias("s2"), "rest")), F.col("s").eqNullSafe(F.col("s2")))
    last = at.where("ahead < rest").groupBy("s").agg(F.max_by(F.struct("place", (F.col("rest") - F.col("ahead")).alias("left")), "place").alias("edge"))
    last = work.keep(last.select(F.col("s").alias("s3"), F.col("edge.place").alias("last"), F.col("edge.left").alias("left")), "last")
    return slim, hint(plan.join(last, F.col("s").eqNullSafe(F.col("s3")), "left").select("s", "source_size", "target", "whole", "last", "left"))


def _repeated(spark: SparkSession, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with source, size, hash and place) and their source's columns, with `repeats`."""
    work = Workspace(spark, "mix-edge")
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
    on_edge = F.col("last").isNotNull() & (F.col("place") == F.col("last"))
    clear = joined.where(~on_edge).withColumn("repeats", F.col("whole") + F.when(F.col("place") < F.col("last"), 1).otherwise(0))
    edge = work.keep(joined.where(on_edge).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "edge")
    key = ["s", "size", "hash", "salt"]
    groups = edge.groupBy(*key).agg(F.count("*").alias("n"), F.first("left").alias("room"))
    words = F.col("n") * F.col("size")
    ahead = F.coalesce(F.sum(words).over(Window.partitionBy("s").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row is taken if what it adds brings the sum nearer to the room: half of it must fit.
    fit = F.when(F.col("size") > 0, F.floor((F.col("room") - ahead) / F.col("size") + 0.5)).otherwise(F.col("n"))
    quotas = work.keep(groups.select(*[F.col(k).alias(f"q_{k}") for k in key], F.greatest(F.lit(0), F.least(F.col("n"), fit)).alias("quota")), "quotas")
    same = [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in key]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("hash"))
    split = edge.withColumn("nth", nth).join(quotas, same).withColumn("repeats", F.col("whole") + F.when(F.col("nth") <= F.col("quota"), 1).otherwise(0))
    return clear.unionByName(split.select(*clear.columns)).withColumn("repeats", F.col("repeats").cast("long"))


def plan_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats), one row per row of docs."""
    slim, sources = plan_sources(spark, docs, **options)
    out = _repeated(spark, slim, sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row of docs as often as the plan repeats it, with docs' own columns; texts don't move but
    for those of the one doc_id of a source at which its fraction ends."""
    seed = options.get("seed", SEED)
    _, sources = plan_sources(spark, docs, **options)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), _order_key(seed).alias("place"))
    held = _repeated(spark, held, sources).where("repeats > 0")
    return held.select(F.explode(F.array_repeat("row", F.col("repeats").cast("int"))).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM per),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked),
filled AS (SELECT *, cap <= level * weight AS clamped FROM levels),
targets AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM filled WHERE NOT clamped) END AS target FROM filled),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
places AS (SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
                  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, whole + CASE WHEN rest > 0 AND upto - size / 2::DOUBLE <= rest AND upto - size < rest THEN 1 ELSE 0 END AS repeats FROM places)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, CAST(repeats AS BIGINT) AS repeats FROM r
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents."""
    return mix(spark, docs)
