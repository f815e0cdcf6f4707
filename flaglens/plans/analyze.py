"""One call for a source tree: toggles of its config files, and the five patterns of their use."""

from __future__ import annotations

import argparse
import json
import os
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.functions.text import relative_path
from flaglens.operators.extents import function_extents
from flaglens.operators.extraction import extract, extract_each
from flaglens.operators.lines import nested
from flaglens.operators.members import enum_functions, enum_members, enum_toggles, mixed, mixed_functions
from flaglens.operators.usage import dead, dead_by_alternation, function_usage, spread, substring_hits
from flaglens.registry import PATTERNS, canonical, language
from flaglens.session import build_session
from flaglens.sources.files import except_configs, language_by_extension, resolve_language, scan_code, scan_configs, with_configs
from flaglens.sources.reports import files_report, names_report, nested_report, to_text, write_text


class Analysis:
    """The tables of a source tree, read once, and its results as DataFrames.

    compat=False gives what the patterns are meant to tell; True what the tool that is replaced is seen to give: dead
    toggles are also looked for in the files that declare them, lone toggles count as nested, enum and mixed are empty.
    """

    def __init__(self, spark: SparkSession, code: DataFrame, configs: DataFrame, lang: str, compat: bool = False, loose_code: DataFrame | None = None, root: str = ""):
        self.spark, self.lang, self.compat, self.root = spark, canonical(lang), compat, root
        language(self.lang)
        keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
        self.configs = keep(configs)
        self.code = keep(except_configs(code, configs))
        self.both = with_configs(self.code, self.configs)
        self.loose = with_configs(except_configs(loose_code, configs), self.configs) if loose_code is not None else self.both
        self.toggles = keep(extract(self.configs, self.lang))
        self.extents = keep(function_extents(self.loose, self.lang))

    def close(self) -> None:
        for df in (self.configs, self.code, self.toggles, self.extents):
            df.unpersist()

    def dead(self) -> DataFrame:
        if self.compat:
            return dead_by_alternation([r["toggle"] for r in self.toggles.orderBy("toggle").collect()], self.both)
        return dead(self.toggles, self.code)

    def spread(self) -> DataFrame:
        return spread(substring_hits(self.loose, self.toggles))

    def spread_functions(self) -> DataFrame:
        return function_usage(self.loose, self.extents, self.spread(), ignore_case=not self.compat)

    def nested(self) -> DataFrame:
        """By the toggles that each config file declares in its own language, with compat none where its extension doesn't tell one."""
        own = language_by_extension(F.col("path"))
        each = extract_each(self.configs.withColumn("language", own if self.compat else F.coalesce(own, F.lit(self.lang))))
        return nested(self.both, each, self.lang, self.extents, self.compat)

    def enum(self) -> DataFrame:
        found = enum_toggles(self.toggles, enum_members(self.both, self.lang))
        return found.where(F.lit(not self.compat)).groupBy("toggle", "path").agg(F.count("*").alias("n"))

    def enum_functions(self) -> DataFrame:
        return enum_functions(self.toggles, self.both, self.extents, self.lang).where(F.lit(not self.compat))

    def mixed(self) -> DataFrame:
        return mixed(self.code, self.lang).where(F.lit(not self.compat))

    def mixed_functions(self) -> DataFrame:
        return mixed_functions(self.code, self.extents, self.lang).where(F.lit(not self.compat))

    def report(self, pattern: str) -> dict:
        if pattern not in PATTERNS:
            raise ValueError(f"unknown pattern: {pattern}")
        # Reports name files as seen from the working directory.
        seen = F.concat(F.lit(os.path.relpath(self.root) if self.root else ""), F.lit("/"), relative_path(F.col("path"), self.root))
        below = lambda df: df.withColumn("path", F.regexp_replace(F.when(F.col("path").startswith(self.root.rstrip("/") + "/"), seen).otherwise(F.col("path")), r"^\./", "")) if self.root else df
        if pattern == "spread":
            out = files_report(below(self.spread()), below(self.spread_functions()))
        elif pattern == "enum":
            out = files_report(below(self.enum()), below(self.enum_functions()))
        elif pattern == "nested":
            out = nested_report(below(self.nested()))
        else:
            out = names_report(getattr(self, pattern)())
        return json.loads(out.first()["report"])


def analyze(spark: SparkSession, source: str, configs: list[str], pattern: str | None = None, lang: str | None = None, compat: bool = False) -> dict:
    """Reports by pattern; what fails in one pattern is its report {"error": ...}."""
    config_files = scan_configs(spark, source, configs, lang)
    name = resolve_language(config_files, lang)
    own = Analysis(spark, scan_code(spark, source, name), config_files, name, compat, scan_code(spark, source, name, fallback=True), root=os.path.abspath(re.sub("^file:/+", "/", source)) if re.match("(file:|(?![a-z0-9]+:))", source) else "")
    wanted = [pattern] if pattern else [p for p in PATTERNS if p != "mixed" or language(name).build_flag]
    reports: dict = {}
    try:
        for p in wanted:
            try:
                reports[p] = own.report(p)
            except Exception as e:  # a failing pattern must not take the others with it
                reports[p] = {"error": str(e)}
    finally:
        own.close()
    return reports[pattern] if pattern else reports


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="How feature toggles are used in a source tree.")
    parser.add_argument("-p", "--source-path", required=True)
    parser.add_argument("-c", "--config-path", required=True, nargs="+")
    parser.add_argument("-o", "--output")
    parser.add_argument("-t", "--pattern", choices=PATTERNS)
    parser.add_argument("-l", "--language")
    parser.add_argument("--compat", action="store_true")
    args = parser.parse_args(argv)
    spark = build_session()
    try:
        reports = analyze(spark, args.source_path, args.config_path, args.pattern, args.language, args.compat)
    except ValueError as e:
        print(e)
        return 1
    print(to_text(reports))
    if args.output:
        write_text(reports, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
