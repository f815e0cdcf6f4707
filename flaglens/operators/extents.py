"""Function extents of files: the one step that runs Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from flaglens.functions.extents import extents
from flaglens.registry import canonical
from flaglens.session import ship

SCHEMA = "path string, ord int, fn_name string, start_byte long, end_byte long"


def function_extents(files: DataFrame, lang: str) -> DataFrame:
    """SCHEMA, a row for each function in order of its start; bytes are those of the content in UTF-8."""
    name = canonical(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *e) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, e in enumerate(extents(c or "", name))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "ord", "fn_name", "start_byte", "end_byte"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
