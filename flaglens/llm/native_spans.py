"""Regular-expression matches with their places, in built-in expressions only.

`regexp_extract_all` gives the matches and `split` on the same pattern the text between them; both find leftmost
non-overlapping matches, so running lengths give each match's place in code points. Patterns here never match the
empty string and never backtrack over a run twice, so a text is scanned in linear time. Appending to an array copies it,
so results of n steps are gathered in about sqrt(n) pieces of sqrt(n) each (see scan).
"""

from __future__ import annotations

from collections.abc import Callable



from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of text kept on either side of a match.
CONTEXT = 24


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """All that step(state, item), which gives the next state and an array<kind>, gives for the items in order."""
    none, none_yet = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        done = lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], F.array(p["out"])).alias("out"))
        return F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one, done)

    def run(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.size(own) - 1, size), lambda i: F.slice(own, i + 1, size))
        whole = F.aggregate(parts, F.struct(start.alias("state"), none_yet.alias("out")), piece, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(own) > 0, whole).otherwise(none)

    return bind(items, run)


LOCATED = "struct<s:int,e:int,m:string,before:string,after:string>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after>>: every match's start, end (exclusive), text and surroundings."""

    def paired(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        with_gap = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before")))
        return F.zip_with(
            F.filter(with_gap, lambda x: x["m"].isNotNull()),
            F.slice(gaps, F.lit(2), F.lit(2_000_000_000)),
            lambda x, gap: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), x["before"].alias("before"), F.left(gap, F.lit(CONTEXT)).alias("after")),
        )

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + x["gap"]
        end = start + F.length(x["m"])
        return end, F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))

    return scan(bind(F.split(text, pattern, -1), paired), F.lit(0), step, LOCATED)


def none_found() -> Column:
    return F.array().cast(f"array<{LOCATED}>")


def guarded(text: Column, has: Column, pattern: str) -> Column:
    """located(), for texts only that can hold a match."""
    return F.when(has, located(text, pattern)).otherwise(none_found())


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, of array<struct<..., kind, s, e>>."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


SPAN = "struct<s:int,rank:int,e:int,kind:string>"


def apart_from(spans: Column, others: Column) -> Column:
    """Of spans (SPAN, their rank above 0), in order, those that overlap none of the others (rank 0) and no span that was taken
    before; at one start the lower rank comes first."""
    far = 2_147_483_647
    none = F.array().cast(f"array<{SPAN}>")
    array = lambda x: F.array(F.struct(*[x[f].alias(f) for f in ("s", "rank", "e", "kind")]))

    def from_right(next_other: Column, x: Column) -> tuple[Column, Column]:
        kept = (x["rank"] == 0) | (next_other >= x["e"])
        return F.when(x["rank"] == 0, F.least(next_other, x["s"])).otherwise(next_other), F.when(kept, array(x)).otherwise(none)

    def from_left(taken: Column, x: Column) -> tuple[Column, Column]:
        clear = (x["rank"] > 0) & (x["s"] >= taken)
        return F.when((x["rank"] == 0) | clear, F.greatest(taken, x["e"])).otherwise(taken), F.when(clear, array(x)).otherwise(none)

    def run(own: Column) -> Column:
        backward = scan(F.reverse(F.sort_array(F.concat(own, others))), F.lit(far), from_right, SPAN)
        return F.when(F.size(own) > 0, scan(F.reverse(backward), F.lit(0), from_left, SPAN)).otherwise(none)

    return bind(spans, run)


def ranked(spans: Column, rank: int, kind: str | None = None) -> Column:
    """Spans as SPAN, by a rank and a kind of their own where these are given."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), (F.lit(kind) if kind else x["kind"]).alias("kind")))
