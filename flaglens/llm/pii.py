"""Personal data in texts: rule spans, and more spans from candidates that boosted trees accept.

Base kinds are found by fixed patterns and checks (an ip's parts are at most 255, a card's 16 to 19 digits pass
Luhn's test, a phone has 8 to 15 digits) and always stay. Besides, high-recall generators, several of a kind, propose
further spans, which overlap each other: spelled-out e-mail addresses, national phone numbers in brackets, after a zero
or in three groups, cards of 12 to 15 digits whole or in groups, and addresses in six to eight groups of hex digits.
Boosted trees score each proposal by its format and its context, and a threshold of each kind, calibrated for precision on
held-out examples, selects the ones to add; of those, a span that overlaps a base span or one that starts before it is dropped.

The trees are trained on the driver from proposals that the generators make in `TRAIN_ROWS` seeded passages of invented
prose, in which personal data and things that look like it (versions, dates, prices, counts, codes) are planted after the
same words, only in other proportions, so that context alone doesn't give the label away; half of the passages fit the
trees, the other half calibrates the threshold. No label of the corpus is read. The trees' sums are CASE expressions, so
the whole scan runs in built-in expressions, with no shuffle and no Python on the executors.

A text is held whole; time grows with its length, and with its number of matches to the power 1.5. Null and empty texts
have no spans and the hash of the empty string, an empty table gives an empty result; repeated rows give repeated results;
spans that start together are ordered by kind; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.llm.boosting import Boosted, calibrated_threshold
from flaglens.llm.native_spans import CONTEXT, SPAN, apart_from, guarded, ranked, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# \G or the lookbehind: a match starts where its first run starts or where the match before ended, so that no run is tried at each of its characters.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further proposals: (kind, what a text must hold, pattern).
PROPOSERS = (
    ("email", r"(?i)[\[({<]\x20?at\x20?[\])}>]", r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[({<]\x20?at\x20?[\])}>]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)[a-z0-9-]{2,24}+){1,4}"),
    ("ip", r"(?i)[0-9a-f]:[0-9a-f]", r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){5,7}[0-9a-f]{1,4}(?![0-9a-z:])"),
    ("card", "[0-9]{4}", r"(?<![0-9A-Za-z.,+-])[0-9]{4}[\x20-]?[0-9]{4,6}[\x20-]?[0-9]{4,5}(?![0-9A-Za-z-])"),
    ("card", "[0-9]{12}", r"(?<![0-9A-Za-z])[0-9]{12,15}(?![0-9A-Za-z])"),
    ("phone", r"\([0-9]", r"(?<![0-9A-Za-z.,+(-])\([0-9]{2,4}\)[\x20-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])"),
    ("phone", "0[0-9]", r"(?<![0-9A-Za-z.,+(-])0[0-9]{1,3}(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])"),
    ("phone", "[0-9]{3}[.-][0-9]{3}", r"(?<![0-9A-Za-z.,+(-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"),
)
CUES = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|mail|contact|reach|card|visa|amex|credit|ip|host|server|addr(?:ess)?)\b"
LOOKALIKES = r"(?i)\b(?:v|ver|version|no|nr|order|invoice|isbn|page|pp|id|ref|part|total|score|code|art|row|year|in|since)\b"
TRAIN_ROWS = 1200
SEED = 20
N_FEATURES, KIND = 13, 10


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    digits = F.regexp_replace(m, "[^0-9]", "")
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(m, r"[^\x20.()-]", "")).cast("double"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        one(luhn(digits)),
        one(before.rlike(CUES)),
        one(before.rlike(LOOKALIKES)),
        one(after.rlike(r"^[\x20.,;)!?]|^$")),
        one(before.rlike(r"[=#$€£/:]\x20?$")),
        one(m.contains("(")),
        F.lit(float(KINDS.index(kind))),
        one(m.contains(".")),
        F.when(digits == "", F.lit(-1.0)).otherwise(F.ascii(digits) - 48.0),
    ]


def _numbers(kind: str, m: str, before: str, after: str) -> list[float]:
    """_features() of one training example, on the driver."""
    digits = re.sub("[^0-9]", "", m)
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(int(c) for c in reversed(digits)))
    return [
        len(m), len(digits), len(re.sub(r"[^\x20.()-]", "", m)), len(re.sub("[^A-Za-z]", "", m)), bool(digits) and total % 10 == 0,
        bool(re.search(CUES, before)), bool(re.search(LOOKALIKES, before)), bool(re.search(r"^[\x20.,;)!?]|^$", after)),
        bool(re.search(r"[=#$€£/:]\x20?$", before)), "(" in m, KINDS.index(kind),
        "." in m, int(digits[:1] or -1),
    ]


def passages(rows: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented prose with the personal data (kind, start, end) that is planted in it, among things that look like it."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice(("34", "37")) + num(12)
        body += next(c for c in "0123456789" if _numbers("card", body + c, "", "")[4])
        return r.choice((body, f"{body[:4]} {body[4:10]} {body[10:]}", f"{body[:4]}-{body[4:10]}-{body[10:]}"))

    def email(name: str) -> str:
        at, dot = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", ".")))
        return f"{name}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"

    def phone() -> str:
        sep = r.choice((" ", "-", "."))
        return r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{r.randint(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{r.randint(1, 9)}{num(1)}{sep}{num(3)}{sep}{num(4)}", f"{r.randint(2, 9)}{num(2)}-{num(3)}-{num(4)}"))

    real = {"email": lambda: email(f"{word()}{r.choice(('', '.' + word(), num(2)))}"), "ip": lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), "card": card, "phone": phone}
    like = {
        "email": lambda: r.choice((f"{word()} (at) {num(1)}.{num(2)}", f"{num(2)} [at] {num(2)}.{num(2)}", f"{word()} (at) {num(3)}")),
        "ip": lambda: ":".join(num(2) for _ in range(r.choice((6, 7)))),
        "card": lambda: r.choice((num(12), num(13), num(14), f"20{num(12)}", f"{num(4)} {num(4)} {num(4)}", f"{num(4)} {num(4)} {num(5)}")),
        "phone": lambda: r.choice((f"0{num(1)}.{num(2)}.{num(4)}", f"0{num(1)}-{num(2)}-{num(2)}", f"{r.randint(1, 9)}{num(2)}.{num(3)}.{num(4)}", f"(20{num(2)}) {num(3)} {num(3)}", f"0{num(2)} {num(2)} {num(2)}", f"1{num(2)}-{num(3)}-{num(4)}")),
    }
    cues = {"email": ("mail", "contact", "reach"), "ip": ("host", "server", "addr"), "card": ("card", "visa", "credit"), "phone": ("tel", "call", "phone")}
    out = []
    for _ in range(rows):
        text, planted = " ".join(word() for _ in range(r.randint(1, 12))), []
        for _ in range(r.randint(1, 3)):
            kind, good = r.choice(KINDS), r.random() < 0.5
            says = r.random()
            # Either kind of word stands before either kind of thing.
            lead = r.choice(cues[kind]) if says < (0.4 if good else 0.2) else r.choice(("version", "order", "no", "ref", "page", "code")) if says > (0.85 if good else 0.65) else word()
            what = (real if good else like)[kind]()
            text += f" {lead}{r.choice((' ', ' ', ': '))}"
            if good:
                planted.append((kind, len(text), len(text) + len(what)))
            text += what + r.choice((" ", ". ", ", ", " ")) + " ".join(word() for _ in range(r.randint(1, 10)))
        out.append((text, planted))
    return out


def _examples(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every proposal in the passages, and whether it is what was planted there."""
    x, y = [], []
    for text, planted in passages(rows, seed):
        for kind, _, pattern in PROPOSERS:
            found = list(re.finditer(pattern, text))
            for i, m in enumerate(found):
                before = text[found[i - 1].end() if i else 0 : m.start()][-CONTEXT:]
                after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None][:CONTEXT]
                x.append(_numbers(kind, m[0], before, after))
                y.append((kind, *m.span()) in planted)
    return np.array(x, dtype=float), np.array(y, dtype=float)


@functools.lru_cache(maxsize=2)
def model(rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[Boosted, list[float]]:
    """The trees, fitted on half of the passages, and the margin of each kind that the other half calibrates."""
    trees = Boosted().fit(*_examples(rows // 2, seed))
    x, y = _examples(rows // 2, seed + 1)
    margin, kind = trees.margin(x), x[:, KIND]
    return trees, [calibrated_threshold(margin[kind == k], y[kind == k]) for k in range(len(KINDS))]


def _kept(spans: Column, kind: str, ok) -> Column:
    return F.transform(F.filter(spans, lambda x: ok(x["m"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added): spans as array<struct<kind, s, e>> in order of kind and start; text is never null."""
    trees, thresholds = model()
    least = F.array(*[F.lit(t) for t in thresholds])
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.col("text").rlike("[0-9]")
    df = docs.select("doc_id", text.alias("text"))
    df = df.select(
        "doc_id", "text",
        guarded(F.col("text"), F.col("text").contains("@"), EMAIL).alias("email"),
        guarded(F.col("text"), digit, IP).alias("ip"),
        guarded(F.col("text"), digit, CARD).alias("card"),
        guarded(F.col("text"), F.col("text").contains("+"), PHONE).alias("phone"),
        *[guarded(F.col("text"), F.col("text").rlike(has), pattern).alias(f"more_{i}") for i, (_, has, pattern) in enumerate(PROPOSERS)],
    )
    plain = lambda m: F.regexp_replace(m, "[^0-9]", "")
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    is_ip = lambda m: F.forall(F.split(m, r"\."), lambda p: small(p) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    is_card = lambda m: F.length(plain(m)).between(16, 19) & luhn(plain(m))
    is_phone = lambda m: F.length(plain(m)).between(8, 15)
    df = df.withColumn("base", F.concat(_kept(F.col("email"), "email", lambda m: F.lit(True)), _kept(F.col("ip"), "ip", is_ip), _kept(F.col("card"), "card", is_card), _kept(F.col("phone"), "phone", is_phone)))

    def proposed(kind: str):
        features = lambda x: F.array(*_features(kind, x["m"], x["before"], x["after"]))
        return lambda x: F.struct(F.lit(KINDS.index(kind) + 1).alias("rank"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), features(x).alias("f"))

    df = df.withColumn("proposed", F.concat(*[F.transform(f"more_{i}", proposed(kind)) for i, (kind, _, _) in enumerate(PROPOSERS)]))
    margin = lambda x: trees.column([F.get(x["f"], F.lit(j)) for j in range(N_FEATURES)])
    scored = F.transform(F.filter("proposed", lambda x: margin(x) >= F.get(least, x["rank"] - 1)), lambda x: F.struct(x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind")))
    df = df.withColumn("scored", F.when(F.size("proposed") > 0, scored).otherwise(F.array().cast(f"array<{SPAN}>")))
    added = apart_from(F.col("scored"), ranked(F.col("base"), 0))
    return df.select("doc_id", "text", "base", F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_spans): every base or added span replaced by its kind in brackets."""
    df = find(docs).withColumn("spans", F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], between, F.lit("["), x["kind"], F.lit("]")).alias("out"))

    out = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    return df.select("doc_id", out.alias("text"), F.size("spans").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    ordered = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(rank[x["kind"]].alias("at"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return df.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(ordered).alias("spans"))
