"""Results as JSON: structures as columns, one text, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from flaglens.operators.usage import by_keys


#: Bytes of a report that reach the driver at once, far below a region of its heap.
PIECE = 1 << 18


class Report(ClassicFrame):
    """A frame of one long text, report, which reaches the driver in pieces. As a row it stands five times in the driver's heap
    while it is pickled, and where that is too small toPandas() gives no row and no error. What is made of it is a plain frame."""

    def collect(self) -> list[Row]:
        text = F.col("report").cast("binary")
        places = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int"))
        pieces = self.select(F.explode(F.transform(places, lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))).alias("piece"))
        whole = bytearray()
        for r in pieces.toLocalIterator():
            whole += r["piece"]
        return [Row(report=whole.decode("utf-8"))]

    def take(self, num: int) -> list[Row]:
        return self.collect()[:num]

    def tail(self, num: int) -> list[Row]:
        return self.collect()[-num:] if num > 0 else []

    def toLocalIterator(self, prefetchPartitions: bool = False) -> Iterator[Row]:
        return iter(self.collect())

    def toArrow(self) -> pa.Table:
        return pa.table({"report": [r["report"] for r in self.collect()]})

    def toPandas(self) -> pd.DataFrame:
        return pd.DataFrame.from_records(self.collect(), columns=self.columns)


def names_report(toggles: DataFrame) -> DataFrame:
    """One row (report): {"toggles": [sorted names], "qty": n}."""
    return toggles.agg(F.to_json(F.struct(F.array_sort(F.collect_set("toggle")).alias("toggles"), F.countDistinct("toggle").alias("qty"))).alias("report"))


def wrapped(toggles: DataFrame, pattern: str) -> DataFrame:
    """One row (report): the sorted names under a key of the pattern; with enum also their number."""
    if pattern not in ("dead", "nested", "enum", "spread"):
        raise ValueError(f"unsupported pattern: {pattern}")
    parts = [F.array_sort(F.collect_set("toggle")).alias(f"{pattern}_toggles")]
    parts += [F.countDistinct("toggle").alias("qty")] if pattern == "enum" else []
    return toggles.agg(F.to_json(F.struct(*parts)).alias("report"))


def _text(c: Column) -> Column:
    """A string in JSON."""
    own = F.to_json(F.struct(c.alias("k")))
    return F.substring(own, F.lit(6), F.length(own) - 6)


def _objects(rows: DataFrame, value: Column) -> DataFrame:
    """(toggle, path, _fns): an object of each function's value, in order of names."""
    pairs = rows.select("toggle", "path", "fn_name", F.concat(_text(F.col("fn_name")), F.lit(":"), value).alias("pair"))
    pairs = pairs.groupBy("toggle", "path").agg(F.array_sort(F.collect_list(F.struct("fn_name", "pair"))).alias("pairs"))
    return pairs.select("toggle", "path", F.concat(F.lit("{"), F.array_join("pairs.pair", ","), F.lit("}")).alias("_fns"))


def files_report(rows: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """One row (report) of (toggle, path, n): {"toggles": {toggle: [{file, Functions: [{function: n}], count}]}, "qty": n}."""
    if functions is not None:
        rows = by_keys(rows, _objects(functions, F.col("n").cast("string")), ["toggle", "path"], "left")
    fns = F.coalesce("_fns", F.lit("{}")) if functions is not None else F.lit("")
    entry = F.concat(F.lit('{"file":'), _text(F.col("path")), F.lit(',"Functions":['), fns, F.lit('],"count":'), F.col("n").cast("string"), F.lit("}"))
    return _keyed(rows.select("toggle", "path", entry.alias("entry")))


def nested_report(rows: DataFrame) -> DataFrame:
    """One row (report) of (toggle, path, fn_name, dependencies): {"toggles": {toggle: [{file, Functions: [{function: names}]}]}, "qty": n}."""
    per = _objects(rows, F.to_json("dependencies"))
    entry = F.concat(F.lit('{"file":'), _text(F.col("path")), F.lit(',"Functions":['), F.col("_fns"), F.lit("]}"))
    return _keyed(per.select("toggle", "path", entry.alias("entry")))


def _keyed(entries: DataFrame) -> DataFrame:
    """One row (report) of (toggle, path, entry), in order of names and paths."""
    per = entries.groupBy("toggle").agg(F.array_sort(F.collect_list(F.struct("path", "entry"))).alias("files"))
    per = per.select("toggle", F.concat(_text(F.col("toggle")), F.lit(":["), F.array_join("files.entry", ","), F.lit("]")).alias("body"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("toggle", "body")))["body"], ",")
    out = per.agg(F.concat(F.lit('{"toggles":{'), body, F.lit('},"qty":'), F.count("*").cast("string"), F.lit("}")).alias("report"))
    return Report(out._jdf, out.sparkSession)


def to_text(reports: dict[str, object], indent: int = 2) -> str:
    return json.dumps(reports, indent=indent, ensure_ascii=False)


def write_text(reports: dict[str, object], path: str) -> None:
    """One small JSON file on the driver, replacing one that is there."""
    Path(path).write_text(to_text(reports), encoding="utf-8")


def write_rows(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines in any store that Spark writes to."""
    df.write.mode("overwrite").json(path)
