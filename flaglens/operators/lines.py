"""Lines of files, the toggles on them, and toggles near each other in conditional code."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flaglens.functions.extents import holders
from flaglens.functions.text import ascii_words, is_word, split_lines
from flaglens.operators.usage import by_keys, text_hits, word_hits
from flaglens.registry import PROXIMITY, language
from flaglens.session import ship

GLOBAL = "GLOBAL"


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), from 0."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))


def with_end_bytes(df: DataFrame) -> DataFrame:
    """end_byte of each line, counted as if lines were joined by single line feeds."""
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end_byte", F.sum(F.octet_length("line").cast("long")).over(upto) + F.col("line_no"))


def conditions(df: DataFrame, lang: str) -> DataFrame:
    """Lines with a column cond: whether the line is conditional code."""
    spec = language(lang)
    if not spec.conditions:
        raise ValueError(f"unsupported language: {lang}")
    return df.withColumn("cond", F.col("line").rlike(spec.condition))


def line_hits(df: DataFrame, toggles: DataFrame, small: bool | None = None) -> DataFrame:
    """(path, line_no, toggle), distinct, of toggles that a line holds as a substring, in its case."""
    names = toggles.select("toggle").where("toggle <> ''").distinct()
    names = names.withColumn("_part", F.col("toggle"))
    in_lines = df.select("path", "line_no", F.explode(F.array_distinct(ascii_words(F.col("line")))).alias("word"))
    holds = word_hits(in_lines.select("word").distinct(), names.where(is_word(F.col("toggle")))).select("word", "toggle")
    by_word = by_keys(in_lines, holds, "word").select("path", "line_no", "toggle")
    other = names.where(~is_word(F.col("toggle")))
    if other.isEmpty():
        return by_word.distinct()
    by_text = text_hits(df.select("path", "line_no", F.col("line").alias("_text")), other, in_lines, ["path", "line_no"], small)
    return by_word.unionByName(by_text.select("path", "line_no", "toggle")).distinct()


def nested_anchors(df: DataFrame, hits: DataFrame, proximity: int = PROXIMITY) -> DataFrame:
    """(path, line_no, near): for each line with a toggle, the toggles on conditional lines at most `proximity` away.

    df: (path, line_no, cond), hits: (path, line_no, toggle).
    """
    on = hits.groupBy("path", "line_no").agg(F.collect_set("toggle").alias("toggles"))
    on = by_keys(on, df.select("path", "line_no", "cond"), ["path", "line_no"])
    frame = Window.partitionBy("path").orderBy("line_no").rangeBetween(-proximity, proximity)
    near = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("cond"), F.col("toggles"))).over(frame))))
    return on.select("path", "line_no", near.alias("near")).where(F.size("near") > 0)


def nested_edges(anchors: DataFrame, lone: bool = False) -> DataFrame:
    """(path, line_no, toggle, dependency): each toggle near an anchor with each other one; with `lone`, also one of null
    for a toggle without others."""
    each = anchors.select("path", "line_no", "near", F.explode("near").alias("toggle"))
    others = F.array_except("near", F.array("toggle"))
    return each.select("path", "line_no", "toggle", (F.explode_outer if lone else F.explode)(others).alias("dependency"))


def enclosing(df: DataFrame, extents: DataFrame) -> DataFrame:
    """(path, line_no, fn_name): the first function, by name's first place, that holds a line's end byte, or GLOBAL.

    df: (path, line_no, end_byte). Of functions of one name the last one's place counts. Only a file's functions come together,
    as one row; its lines are passed once, in order of their bytes, with the places at which another function begins to hold.
    """
    spans = extents.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "fn_name", "start_byte", "end_byte"))).alias("spans"))
    ship(df.sparkSession)
    marks = spans.select("path", "spans.fn_name", "spans.start_byte", "spans.end_byte").mapInArrow(_holders, "path string, byte long, fn_name string")
    kind = df.schema["line_no"].dataType
    marks = marks.select("path", F.lit(None).cast(kind).alias("line_no"), "byte", F.lit(0).alias("of_line"), "fn_name")
    ends = df.select("path", "line_no", F.col("end_byte").cast("long").alias("byte"), F.lit(1).alias("of_line"), F.lit(None).cast("string").alias("fn_name"))
    upto = Window.partitionBy("path").orderBy("byte", "of_line").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(ends).withColumn("fn_name", F.last("fn_name", ignorenulls=True).over(upto))
    return met.where("of_line = 1").select("path", "line_no", F.coalesce("fn_name", F.lit(GLOBAL)).alias("fn_name"))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths, froms, names = [], [], []
        for path, *spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = holders(*spans)
            paths += [path] * len(own)
            froms += [at for at, _ in own]
            names += [GLOBAL if name is None else name for _, name in own]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(froms, pa.int64()), pa.array(names, pa.string())], ["path", "byte", "fn_name"])


def nested(files: DataFrame, toggles: DataFrame, lang: str, extents: DataFrame | None = None, compat: bool = False, proximity: int = PROXIMITY) -> DataFrame:
    """(toggle, path, fn_name, dependencies): distinct and sorted; with compat repeated for each anchor, and empty for lone toggles."""
    df = conditions(lines(files), lang)
    anchors = nested_anchors(df, line_hits(df, toggles), proximity)
    edges = nested_edges(anchors, lone=compat)
    if extents is None:
        edges = edges.withColumn("fn_name", F.lit(GLOBAL))
    else:
        ends = by_keys(with_end_bytes(lines(files)), anchors.select("path", "line_no"), ["path", "line_no"], "left_semi")
        edges = by_keys(edges, enclosing(ends.select("path", "line_no", "end_byte"), extents), ["path", "line_no"])
    gather = F.collect_list if compat else F.collect_set
    return edges.groupBy("toggle", "path", "fn_name").agg(F.array_sort(gather("dependency")).alias("dependencies"))
