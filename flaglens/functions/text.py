"""Scalar functions over contents and names, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flaglens.registry import BLOCK_COMMENT, language


def literal(text: Column) -> Column:
    """A pattern that matches text as it stands."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def strip_line_comments(content: Column, lang: str) -> Column:
    pattern = language(lang).line_comment
    return F.regexp_replace(content, f"(?Umd){pattern}", "") if pattern else content


def strip_block_comments(content: Column, lang: str) -> Column:
    return F.regexp_replace(content, BLOCK_COMMENT, "") if language(lang).block_comments else content


def strip_comments(content: Column, lang: str) -> Column:
    return strip_block_comments(strip_line_comments(content, lang), lang)


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def is_word(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_]+$")


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def is_quoted(text: Column) -> Column:
    """Starts and ends with a quote of either kind."""
    return text.rlike(r"""(?s)^['"](.*['"])?$""")


def unquoted(text: Column) -> Column:
    return F.when(is_quoted(text), F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def normalised(name: Column) -> Column:
    """A name without blanks, dashes and underscores, in lower case."""
    return F.lower(F.regexp_replace(name, "[ _-]", ""))


def formatted(pattern: Column, toggle: Column) -> Column:
    """The pattern with the toggle in its %s slot; without a slot, or without a toggle, the pattern."""
    return F.coalesce(F.replace(pattern, F.lit("%s"), toggle), pattern)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def file_name(path: Column, lang: str) -> Column:
    """The name of a Python, Java or Go file, or of a JavaScript one; of other languages the path."""
    ends = {"python": "py", "java": "java", "go": "go", "js": "js"}.get(lang)
    return F.regexp_extract(path, rf"[^/]*\.{ends}", 0) if ends else path


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def split_lines(content: Column) -> Column:
    r"""Lines as of Python's splitlines: also at \x1c to \x1e, and without an empty last one."""
    lines = F.split(content, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def assigned_value(content: Column, toggle: Column) -> Column:
    """What is assigned to a toggle (after = on its line, else after a colon), without quotes; null if nothing is."""

    def value(sign: str) -> Column:
        pattern = F.concat(F.lit("(?Ud)"), literal(toggle), F.lit(rf".*\s*{sign}\s*(.+)\n"))
        return F.nullif(F.call_function("regexp_extract", content, pattern, F.lit(1)), F.lit(""))

    text = F.coalesce(value("="), value(":"))
    return unquoted(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
