"""Members of enumerations, build flags in preprocessor directives, and the parents of toggles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaglens.functions.text import formatted, literal
from flaglens.operators.usage import bodies
from flaglens.registry import language

UNNAMED = "UnnamedEnum"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def enum_members(files: DataFrame, lang: str) -> DataFrame:
    """(path, enum_name, ord, member). Of enumerations of one name in a file the last counts; Go's blocks all have one name."""
    spec = language(lang)
    if not spec.enum:
        raise ValueError(f"unsupported language: {lang}")
    pattern = "(?Uds)" + spec.enum
    blocks = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("block_no", "block"))
    part = lambda group: F.regexp_extract("block", pattern, group)
    if spec.name == "go":
        name, members = F.lit("go"), F.transform(F.split(part(1), "\n"), lambda m: _trimmed(F.split(m, "=")[0]))
    elif spec.name == "python":
        name, members = part(1), F.regexp_extract_all(part(2), F.lit(r"(?U)(\w+)\s*=\s*\d+"), F.lit(1))
    else:
        name, members = F.coalesce(F.nullif(part(1), F.lit("")), F.lit(UNNAMED)), F.transform(F.split(part(2), ","), _trimmed)
    blocks = blocks.select("path", "block_no", name.alias("enum_name"), F.filter(members, lambda m: m != "").alias("members"))
    last = blocks.groupBy("path", "enum_name").agg(F.max_by("members", "block_no").alias("members"))
    return last.select("path", "enum_name", F.posexplode("members").alias("ord", "member"))


def enum_toggles(toggles: DataFrame, members: DataFrame) -> DataFrame:
    """(toggle, path, enum_name): a row for each enumeration that has the toggle as a member."""
    names = toggles.select("toggle").distinct()
    return members.join(names, F.col("member") == F.col("toggle")).select("toggle", "path", "enum_name").distinct()


def enum_counts(found: DataFrame) -> DataFrame:
    """(toggle, path, n): path is null for all of a toggle's files together."""
    per = found.rollup("toggle", "path").agg(F.count("*").alias("n"), F.grouping_id().alias("_level"))
    return per.where("_level <= 1").select("toggle", "path", "n")


def _by_function(files: DataFrame, extents: DataFrame) -> DataFrame:
    """(path, content) of functions as if they were files; path is (path, ord, fn_name)."""
    return bodies(files, extents).select(F.struct("path", "ord", "fn_name").alias("path"), F.col("body").alias("content"))


def enum_functions(toggles: DataFrame, files: DataFrame, extents: DataFrame, lang: str) -> DataFrame:
    """(toggle, path, fn_name, n): how many functions of a name hold an enumeration with the toggle as a member."""
    found = enum_toggles(toggles, enum_members(_by_function(files, extents), lang)).select("toggle", "path").distinct()
    return found.groupBy("toggle", F.col("path.path").alias("path"), F.col("path.fn_name").alias("fn_name")).agg(F.count("*").alias("n"))


def build_flags(files: DataFrame, lang: str) -> DataFrame:
    """(path, token): a row for each use of a build flag in a directive."""
    spec = language(lang)
    if not spec.build_flag:
        raise ValueError(f"no build flags in language: {lang}")
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit("(?Ud)" + spec.build_flag), F.lit(1))).alias("token")).where("token <> ''")


def mixed_counts(tokens: DataFrame) -> DataFrame:
    """(path, token, n)."""
    return tokens.groupBy("path", "token").agg(F.count("*").alias("n"))


def mixed_functions(files: DataFrame, extents: DataFrame, lang: str) -> DataFrame:
    """(fn_name, token, n): uses of build flags within functions, by the functions' names."""
    tokens = build_flags(_by_function(files, extents), lang)
    return tokens.groupBy(F.col("path.fn_name").alias("fn_name"), "token").agg(F.count("*").alias("n"))


def mixed(files: DataFrame, lang: str) -> DataFrame:
    """(toggle): the build flags that files use."""
    return build_flags(files, lang).select(F.col("token").alias("toggle")).distinct()


def parents(hits: DataFrame, lang: str) -> DataFrame:
    """Of (toggle, path, content): (toggle, parent, path), distinct; a pattern's first match, '' where it has none."""
    spec = language(lang)
    if not spec.parents:
        raise ValueError(f"no parents in language: {lang}")
    patterns = F.array(*[F.lit("(?d)" + p) for p in spec.parents])
    df = hits.withColumn("pattern", F.explode(patterns)).withColumn("pattern", formatted(F.col("pattern"), literal(F.col("toggle"))))
    group = 0 if spec.name == "config" else 1
    first = F.call_function("regexp_extract", F.col("content"), F.col("pattern"), F.lit(group))
    return df.select("toggle", F.coalesce(first, F.lit("")).alias("parent"), "path").distinct()


def spread_parents(found: DataFrame) -> DataFrame:
    """Of parents(): the rows of toggles that have more than one (parent, path)."""
    many = found.groupBy("toggle").agg(F.countDistinct("parent", "path").alias("_n")).where("_n > 1").select("toggle")
    return found.join(many, "toggle", "left_semi")
