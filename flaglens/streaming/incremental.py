"""Toggle hits of files as they arrive: the batch operators on a stream (an addition, stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.functions.text import occurrences
from flaglens.sources.files import decoded


def stream_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of text files that are put into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return df.select("path", decoded(F.col("content"), True).alias("content"))


def stream_hits(files: DataFrame, toggles: DataFrame) -> DataFrame:
    """(toggle, path, n) for each file of a stream; toggles are a static table."""
    names = toggles.select("toggle").where("toggle <> ''").distinct().withColumn("_part", F.lower("toggle"))
    text = files.select("path", F.lower("content").alias("_text"))
    return text.join(names, F.contains(F.col("_text"), F.col("_part"))).select("toggle", "path", occurrences(F.col("_text"), F.col("_part")).alias("n"))
