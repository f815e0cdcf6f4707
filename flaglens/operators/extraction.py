"""Toggles that config files declare: candidates by patterns, then the chain of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaglens.functions.text import assigned_value, is_quoted, literal, normalised, strip_comments, unquoted
from flaglens.registry import CALL_VALUE, INVALID_CHARS, MIN_LENGTH, PURE_NUMBER, WRONG_VALUES, language, languages


def candidates(files: DataFrame, lang: str) -> DataFrame:
    """(path, content, toggle): every distinct toggle that a pattern of the language finds in a file; content is without comments."""
    df = files.select("path", strip_comments(F.col("content"), lang).alias("content"))
    found = [F.regexp_extract_all("content", F.lit(p.java), F.lit(p.group)) for p in language(lang).declarations]
    each = F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")
    return df.select("path", "content", F.explode(each).alias("toggle"))


def is_present(toggle: Column) -> Column:
    return toggle.isNotNull() & (toggle != "")


def has_valid_chars(toggle: Column) -> Column:
    return ~toggle.rlike(INVALID_CHARS)


def is_no_number(toggle: Column) -> Column:
    return ~toggle.rlike("(?U)" + PURE_NUMBER)


def is_long_enough(toggle: Column) -> Column:
    return F.length(toggle) >= MIN_LENGTH


def is_no_keyword(toggle: Column, lang: str) -> Column:
    words = language(lang).keywords
    return ~toggle.isin(*words) if words else F.lit(True)


def derived(content: Column, larger: Column, toggle: Column) -> Column:
    """Whether a larger name is assigned something that holds the toggle."""
    return F.regexp_like(content, F.concat(F.lit(r"(?U)\b"), literal(larger), F.lit(r"\s*=\s*[\s\S]*?"), literal(toggle), F.lit(r"[\s\S]*?;")))


def drop_substrings(toggles: DataFrame) -> DataFrame:
    """Of (path, content, toggle): a toggle that is part of longer ones stays only if, for one of them, it still occurs
    when that one is deleted from the file, and that one isn't derived from it."""
    larger = toggles.select(F.col("path").alias("_path"), F.col("toggle").alias("_larger"))
    holds = (F.col("path") == F.col("_path")) & (F.col("toggle") != F.col("_larger")) & F.contains(F.col("_larger"), F.col("toggle"))
    met = toggles.join(larger, holds, "left")
    rest = F.replace(F.col("content"), F.col("_larger"), F.lit(""))
    ok = F.col("_larger").isNull() | (F.contains(rest, F.col("toggle")) & ~derived(F.col("content"), F.col("_larger"), F.col("toggle")))
    stays = met.groupBy("path", "toggle").agg(F.bool_or(ok).alias("ok")).where("ok").select("path", "toggle")
    return toggles.join(stays, ["path", "toggle"], "left_semi").select("path", "content", "toggle")


def has_fitting_value(content: Column, toggle: Column) -> Column:
    wrong = "|".join(f"(?:{pattern})" for pattern in WRONG_VALUES)
    # One alternation: the value is computed again wherever it is named.
    return F.coalesce(~F.regexp_like(assigned_value(content, toggle), F.lit(f"(?U)^(?!.*{CALL_VALUE}).*?(?:{wrong})")), F.lit(True))


def drop_quoted_duplicates(toggles: DataFrame) -> DataFrame:
    """Of (path, toggle): a quoted toggle goes if its normalised content is part of another toggle's normalised form."""
    others = toggles.select(F.col("path").alias("_path"), F.col("toggle").alias("_other"))
    same = (F.col("path") == F.col("_path")) & (F.col("toggle") != F.col("_other"))
    part = F.contains(normalised(F.col("_other")), normalised(unquoted(F.col("toggle"))))
    return toggles.join(others, same & is_quoted(F.col("toggle")) & part, "left_anti")


def simple_filters(toggles: DataFrame, lang: str) -> DataFrame:
    """The filters that look at one name only."""
    t = F.col("toggle")
    return toggles.where(is_present(t) & has_valid_chars(t) & is_no_number(t) & is_long_enough(t) & is_no_keyword(t, lang))


def extract_by_file(files: DataFrame, lang: str) -> DataFrame:
    """(path, toggle): the toggles that each config file declares."""
    found = drop_substrings(simple_filters(candidates(files, lang), lang))
    found = found.where(has_fitting_value(F.col("content"), F.col("toggle"))).select("path", "toggle")
    return drop_quoted_duplicates(found)


def extract(files: DataFrame, lang: str) -> DataFrame:
    """(toggle), distinct over all config files."""
    return extract_by_file(files, lang).select("toggle").distinct()


def extract_each(files: DataFrame) -> DataFrame:
    """(toggle), distinct, of (path, content, language): each file by the patterns of its own language; without one it declares nothing."""
    out = None
    for name in (n for n in languages() if language(n).declarations):
        found = extract_by_file(files.where(F.col("language") == name), name).select("toggle")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
