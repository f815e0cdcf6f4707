"""Source trees and config files as DataFrames of (path, language, is_config, content)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.registry import ASK_EXTENSIONS, CONFIG_EXTENSIONS, CONTENT_PROBES, canonical, language
from flaglens.session import ship


def config_paths(source: str, configs: list[str]) -> list[str]:
    """Every piece of every comma-separated value, below the source path."""
    root = source.rstrip("/")
    return [f"{root}/{piece.strip().removeprefix('./')}" for value in configs for piece in value.split(",") if piece.strip()]


def _matches(spark: SparkSession, pattern: str) -> list:
    """Statuses of what a glob without ** finds, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) or [])


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a glob finds; ** stands for any number of folders, and names that begin with a dot aren't met by it."""
    head, sign, tail = pattern.partition("/**")
    if not sign:
        return [f.getPath().toString() for f in _matches(spark, pattern) if f.isFile()]
    found, levels = [], head
    while True:
        found += [f for f in expand(spark, f"{levels}{tail or '/*'}") if "/." not in f.removeprefix(head)]
        levels += "/*"
        if not _matches(spark, levels):
            return sorted(set(found))


def decoded(content: Column, fallback: bool) -> Column:
    """UTF-8 text; bytes that are none are read as ISO-8859-1 with fallback, and are null without."""
    text = content.cast("string")
    other = F.decode(content, "ISO-8859-1") if fallback else F.lit(None).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(other)


CONTENTS = "path string, content binary"


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _is_passed_over(path: str) -> bool:
    """Whether Spark's sources leave a path out, as they do with names that begin with an underscore."""
    return any(name.startswith("_") for name in path.split("/"))


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of named files, whatever their names, by Python workers that open them one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for path in b.column(0).to_pylist():
                store, inner = FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")
                with store.open_input_stream(inner) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 200)))
    return rows.mapInArrow(run, CONTENTS).select(_plain_path(F.col("path")).alias("path"), "content")


def _load(spark: SparkSession, paths: list[str], recursive: bool, names: str = "*") -> DataFrame:
    """(path, content) of files, or of those below folders whose names fit the glob; only these are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("pathGlobFilter", names)
    return reader.load(paths).select(_plain_path(F.col("path")).alias("path"), "content")


def _underscored(spark: SparkSession, source: str, ends: tuple[str, ...]) -> list[str]:
    """Files with one of the extensions that have an underscore first in their name or that of a folder below source."""
    found, level = [], source.rstrip("/")
    while _matches(spark, f"{level}/*"):
        for f in _matches(spark, f"{level}/_*"):
            path = f.getPath().toString()
            found += [path] if f.isFile() else [x for end in ends for x in expand(spark, f"{path}/**/*.{end}")]
        level += "/*"
    below = lambda path: re.sub("^file:/+", "/", path).removeprefix(re.sub("^file:/+", "/", source.rstrip("/")))
    return sorted({p for p in found if p.rpartition(".")[2] in ends and "/." not in below(p)})


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def scan_code(spark: SparkSession, source: str, lang: str, fallback: bool = False) -> DataFrame:
    """(path, language, is_config, content) of the language's files below source; universal newlines with fallback only."""
    name = canonical(lang)
    ends = language(name).extensions
    if not ends:
        raise ValueError(f"no code files of language: {lang}")
    df = _load(spark, [source], True, f"*.{{{','.join(ends)}}}").where(extension(F.col("path")).isin(*ends))
    if others := _underscored(spark, source, tuple(ends)):
        df = df.unionByName(_read(ship(spark), others))
    text = decoded(F.col("content"), fallback)
    text = F.regexp_replace(text, "\r\n?", "\n") if fallback else text
    return df.select("path", F.lit(name).alias("language"), F.lit(False).alias("is_config"), text.alias("content")).where("content IS NOT NULL")


def scan_configs(spark: SparkSession, source: str, configs: list[str], lang: str | None = None) -> DataFrame:
    """Config files (path, language, is_config, content); those that don't exist are passed over; none at all, or bytes that
    are no UTF-8, are errors."""
    found = sorted({f for path in config_paths(source, configs) for f in expand(spark, path)})
    if not found:
        raise ValueError("no config file found")
    plain, others = ([f for f in found if _is_passed_over(f.rpartition("/")[2]) == over] for over in (False, True))
    parts = ([_load(spark, plain, False)] if plain else []) + ([_read(ship(spark), others)] if others else [])
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    strict = F.coalesce(decoded(F.col("content"), False), F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))
    text = F.regexp_replace(strict, "\r\n?", "\n")
    own = F.lit(canonical(lang)) if lang else language_by_extension(F.col("path"))
    return df.select("path", own.alias("language"), F.lit(True).alias("is_config"), text.alias("content"))


def language_by_extension(path: Column) -> Column:
    """The language of a file by its extension, or null."""
    out = F.lit(None).cast("string")
    for name, ends in reversed(CONFIG_EXTENSIONS.items()):
        out = F.when(extension(path).isin(*ends), F.lit(name)).otherwise(out)
    return out


def language_by_content(content: Column) -> Column:
    """The language of a text by the first of its signs, or null."""
    out = F.lit(None).cast("string")
    for name, signs in reversed(CONTENT_PROBES):
        hit = F.lit(False)
        for s in signs:
            hit = hit | content.contains(s)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def resolve_language(files: DataFrame, given: str | None = None) -> str:
    """The given language, else that of the first config file with a known extension, else by content."""
    if given:
        return canonical(given)
    asked = files.where(extension(F.col("path")).isin(*ASK_EXTENSIONS))
    if not asked.isEmpty():
        raise ValueError("config files of this kind need a language")
    for kind in (language_by_extension(F.col("path")), language_by_content(F.col("content"))):
        first = files.select("path", kind.alias("language")).where("language IS NOT NULL").orderBy("path").first()
        if first:
            return first["language"]
    raise ValueError("the language can't be told; give one")


def except_configs(code: DataFrame, configs: DataFrame) -> DataFrame:
    """Code files that aren't config files."""
    return code.join(configs.select("path"), "path", "left_anti")


def with_configs(code: DataFrame, configs: DataFrame) -> DataFrame:
    """Code files and config files together."""
    return code.unionByName(configs)
