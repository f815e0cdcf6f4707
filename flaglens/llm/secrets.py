"""Secrets in texts: rule spans, and strings whose sliding-window entropy is that of random characters.

Base kinds are found by fixed patterns and always stay. Besides, every run of key characters of at least `WINDOW` that
mixes letters and digits, or small and capital letters, is a candidate: its character class (hex, letters and digits,
letters alone, or base64) sets the threshold, and a window of `WINDOW` characters slides over it. Each step changes the
count of the symbol that enters and of the one that leaves, and by these a running sum of c * log2(c), from which the
entropy follows; the counts of all symbols are packed into six numbers, so a step takes the same time on any run. A
candidate whose highest window reaches the threshold is added as kind `entropy`, unless the allow-list names the form of
the whole run (UUIDs, dates and times, words and numbers that are joined by capitals, hyphens, underscores or slashes, as
in names and paths, one repeated group) or it overlaps a base span.

All of it is built-in expressions: no shuffle and no Python on the executors. A text is held whole; time grows with its
length, and with its number of matches to the power 1.5. Null and empty texts, and an empty table's none, have no spans
and the hash of the empty string; repeated rows give repeated results; spans that start together are ordered by kind;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.native_spans import apart_from, bind, guarded, ranked, written

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
# A shorter run of hex digits is no match, so only runs of 24 and more are looked for.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
WINDOW = 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Character class of a whole run, and the bits that a window must reach.
CLASSES = (("[0-9a-fA-F]+", 3.0), ("[A-Za-z]+", 3.9), ("[A-Za-z0-9]+", 3.5), ("[A-Za-z0-9+/_=-]+", 3.7))
_WORD = r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[A-Z](?=[0-9])|[0-9]{1,4}+(?![0-9]))"
#: Forms of whole runs that are let go.
ALLOWED = (
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",  # UUID
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-]?[0-9-]{2,17}Z?)?$",  # date and time
    rf"^(?=.*[a-z]{{5}}|[^a-z]*[/_-][^a-z]*$)(?!(?:.*?[0-9]+[^0-9]+){{3}})[/_=+-]*+(?:{_WORD}[/_=+-]*+)++$",  # words joined
    r"^(.{1,8})\1+$",  # one group repeated
)
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window fit in BITS bits, and so many of them in a number.
BITS, PACKED = 5, 12


def window_entropy(text: Column) -> Column:
    """The highest Shannon entropy, in bits, of any WINDOW characters in a row; 0 for shorter texts. Other characters than
    SYMBOLS count as one symbol."""
    place = {ord(c): i for i, c in enumerate(SYMBOLS)}
    of = [place.get(i, len(SYMBOLS)) for i in range(128)]
    table = F.array(*[F.struct(F.lit(i // PACKED).alias("slot"), F.lit(BITS * (i % PACKED)).alias("shift"), F.lit(1 << BITS * (i % PACKED)).cast("long").alias("one")) for i in of])
    weigh = lambda c: c * math.log2(c) if c > 1 else 0.0
    grows = F.array(*[F.lit(weigh(c + 1) - weigh(c)) for c in range(WINDOW + 1)])  # of one more than c
    count = lambda acc, x: F.call_function("shiftright", F.get(acc["counts"], x["slot"]), x["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        same, leaves = (new["slot"] == old["slot"]) & (new["shift"] == old["shift"]), old["one"].isNotNull()
        change = lambda c, j: c + F.when(new["slot"] == j, new["one"]).otherwise(F.lit(0)) - F.when(leaves & (old["slot"] == j), old["one"]).otherwise(F.lit(0))
        into = F.when(leaves & same, F.lit(0.0)).otherwise(F.get(grows, count(acc, new)) - F.when(leaves, F.get(grows, count(acc, old) - 1)).otherwise(F.lit(0.0)))
        total = acc["sum"] + into
        bits = F.when(acc["n"] + 1 >= WINDOW, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
        return F.struct(F.transform(acc["counts"], change).alias("counts"), total.alias("sum"), F.greatest(acc["best"], bits).alias("best"), (acc["n"] + 1).alias("n"))

    def run(symbols: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("struct<slot:int,shift:int,one:bigint>"), WINDOW), symbols)
        moves = F.zip_with(symbols, F.slice(before, F.lit(1), F.size(symbols)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), len(SYMBOLS) // PACKED + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))
        return F.aggregate(moves, start, step, lambda acc: acc["best"])

    return bind(F.transform(F.split(text, ""), lambda c: F.get(table, F.least(F.ascii(c), F.lit(127)))), run)


def random_looking(m: Column) -> Column:
    """Whether a run is no allowed form and has a window of its class's entropy."""
    bits = F.lit(CLASSES[-1][1])
    for form, least in reversed(CLASSES[:-1]):
        bits = F.when(m.rlike(f"^(?:{form})$"), F.lit(least)).otherwise(bits)
    allowed = F.lit(False)
    for form in ALLOWED:
        allowed = allowed | m.rlike(form)
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]") | m.rlike("[a-z]") & m.rlike("[A-Z]")
    run = F.when(m.rlike(f"^(?:{CLASSES[0][0]})$"), F.lower(m)).otherwise(m)
    return mixed & ~allowed & (window_entropy(run) >= bits)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added): spans as array<struct<s, at, kind, e>> in order of start and kind."""
    text = F.col("text")
    df = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    df = df.select(
        "doc_id", "text",
        guarded(text, text.rlike("(?i)password|passwd|secret|token|api_?key"), ASSIGN).alias("assign"),
        guarded(text, text.contains("AKIA"), ACCESS).alias("access"),
        guarded(text, text.rlike(HEX), HEX).alias("hex"),
        guarded(text, F.length(text) >= WINDOW, RUN).alias("runs"),
    )
    ok = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6, "access": lambda m: F.length(m) >= 20, "hex": lambda m: F.length(m) >= 24}

    def spans(i: int, kind: str) -> Column:
        kept = F.filter(kind, lambda x: ok[kind](x["m"]))
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("at"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    df = df.withColumn("base", F.sort_array(F.concat(*[spans(i, kind) for i, kind in enumerate(KINDS[:3])])))
    df = df.withColumn("random", F.filter("runs", lambda x: random_looking(x["m"])))
    free = apart_from(ranked(F.col("random"), 1, "entropy"), ranked(F.col("base"), 0))
    added = F.transform(free, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("at"), x["kind"].alias("kind"), x["e"].alias("e")))
    return df.select("doc_id", "text", "base", added.alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.sort_array(F.concat("base", "added"))
    return df.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"))
