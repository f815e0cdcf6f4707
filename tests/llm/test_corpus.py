"""Mixing, near duplicates, decontamination, toxicity, search, pages and the pipeline on small tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flaglens.llm import bagminhash, decontaminate, mixing, site_tree, toxicity, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(1, 40)), r.choice(("a", "a", "a", "b", "c", None))) for i in range(400)] + [(900, None, "a"), (901, "", "z"), (3, "one two", "b"), (None, "x y", "c")]
    got = mixing.plan_documents(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total, sizes, taken, target = 0, Counter(), Counter(), {}
    source = {}
    for i, t, s in rows:
        source.setdefault(i, s)
        n = len((t or "").split())
        sizes[s] += n
        total += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    clamped: set = set()
    while True:  # pour, clamp, pour again
        left = 1.5 * total - sum(2 * sizes[s] for s in clamped)
        free = [s for s in order if s not in clamped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            break
        clamped |= set(over)
    want = {s: 2.0 * sizes[s] if s in clamped else share[s] for s in order}
    for row in got:
        assert row["taken"] <= 2 * row["size"]
        s = next(x for x in order if sizes[x] == row["source_size"] and abs(want[x] - row["target"]) < 1e-6)
        taken[s] += row["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in order)
    again = mixing.plan_documents(spark, docs(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(spark, docs(spark, rows).withColumn("row", F.lit(1)).withColumn("times", F.lit(2)))
    assert mixed.columns == [*docs(spark, []).columns, "row", "times"]
    assert mixed.count() == sum(x["repeats"] for x in got)
    assert mixing.plan_documents(spark, docs(spark, [])).collect() == []


def test_mixing_splits_repeated_rows(spark):
    rows = [(7, "a b c d e f g h i j " * 4, "a")] * 20 + [(i, "x y z", "a") for i in range(100, 190)] + [(500 + i, "u v w " * 300, "b") for i in range(2)]
    got = mixing.plan_documents(spark, docs(spark, rows)).collect()
    by = {"a": [x for x in got if x["source_size"] == 1070], "b": [x for x in got if x["source_size"] == 1800]}
    assert len(got) == len(rows) and all(x["taken"] <= 2 * x["size"] for x in got)
    assert abs(sum(x["taken"] for x in by["a"]) - by["a"][0]["target"]) <= 20
    assert mixing.mix(spark, docs(spark, rows)).count() == sum(x["repeats"] for x in got)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    bags, want = [], []
    for _ in range(60):
        items, n = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), rng.integers(1, 9, 300)
        n = n[: len(items)]
        m = np.where(rng.random(len(items)) < rng.random(), rng.integers(0, 12, len(items)), n)
        a, b = (items, n), (items[m > 0], m[m > 0])
        bags += [a, b]
        want.append(bagminhash.similarity(a, b))
    s = bagminhash.signatures(bags)
    got = (s[::2] == s[1::2]).mean(1)
    assert abs((got - want).mean()) < 0.01 and np.abs(got - want).max() < 0.12


def test_near_duplicates(spark):
    r = random.Random(3)
    rows, words = [], {}
    for i in range(60):
        words[i] = prose(r, 80).split()
        rows.append((i, " ".join(words[i]), "s"))
    for k in range(120):  # a hot group whose members differ in a word or two each
        w = list(words[0])
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = prose(r, 1)
        rows.append((100 + k, " ".join(w).upper() + "!" * (k % 2), "s"))
    shared = prose(r, 40)
    rows += [(300 + k, f"{shared} {prose(r, 40)}", "s") for k in range(40)]  # many texts share a passage
    rows += [(400, None, "s"), (401, "", "s"), (402, "one two", "s"), (403, "ONE two!", "s"), (404, "one", "s"), (5, rows[5][1], "s"), (None, "x", "s"), (405, "w " * 50000, "s"), (406, "w " * 49000, "s")]
    bags = {i: bagminhash.counted(t or "") for i, t, _ in rows if i is not None}
    text = {i: t or "" for i, t, _ in rows if i is not None}
    root = {i: i for i in bags}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if text[a] == text[b] or bagminhash.similarity(bags[a], bags[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = bagminhash.classes(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == {i: top(i) for i in ids}
    kept = bagminhash.stage(spark, docs(spark, rows), "").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({top(i) for i in ids})
    assert bagminhash.classes(spark, docs(spark, [])).collect() == []


def test_cells_find_links_that_hubs_miss():
    r = np.random.default_rng(4)
    one = r.integers(0, 256, bagminhash.M).astype(np.uint8)
    import pyarrow as pa

    table = pa.table({"half": [0, 0, 1], "id": [5, 9, 7], "label": [5, 9, 7], "sign": [one.tobytes(), r.integers(0, 256, bagminhash.M).astype(np.uint8).tobytes(), one.tobytes()]})
    key = (pa.scalar(1), pa.scalar(0), pa.scalar(1), pa.scalar(0))
    assert bagminhash._cell_pairs(key, table).to_pylist() == [{"a": 7, "b": 5}]


def test_cells_let_out_each_pair_once():
    """Of the bands that two texts share, one lets them out, also where an earlier band agrees in low bytes only."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    mixed = lambda x: x * np.uint64(0x9E3779B97F4A7C15) ^ x >> np.uint64(29)

    def out(places):
        keys = np.zeros((2, bagminhash.BANDS), dtype=np.uint64)
        for k in range(bagminhash.ROWS):
            keys = mixed(keys ^ places[:, k * bagminhash.BANDS : (k + 1) * bagminhash.BANDS] + np.uint64(k))
        keys, low = keys.view(np.int64), places.astype(np.uint8)
        shared = np.flatnonzero(keys[0] == keys[1])
        pairs = []
        for band in shared:
            cell = pa.table({"half": [0, 0], "id": [5, 9], "label": [5, 9], "sign": [x.tobytes() for x in low], "earlier": [x[:band].tolist() for x in keys]})
            pairs += bagminhash._cell_pairs((pa.scalar(1), pa.scalar(0), pa.scalar(0), pa.scalar(int(band))), cell).to_pylist()
        return len(shared), pairs

    one = r.integers(0, 2**63, bagminhash.M).astype(np.uint64)
    other = one.copy()
    other[0] ^= np.uint64(256)  # band 0 agrees in all low bytes, but isn't shared
    assert out(np.stack([one, other])) == (bagminhash.BANDS - 1, [{"a": 9, "b": 5}])
    for _ in range(400):
        a = r.integers(0, 2**63, bagminhash.M).astype(np.uint64)
        b = np.where(r.random(bagminhash.M) < 0.85, a, r.integers(0, 2**63, bagminhash.M).astype(np.uint64))
        n, pairs = out(np.stack([a, b]))
        near = (a.astype(np.uint8) == b.astype(np.uint8)).mean() >= bagminhash.ESTIMATE
        assert pairs == ([{"a": 9, "b": 5}] if n and near else [])


def test_decontamination(spark):
    r = random.Random(5)
    items = [(i, f"{prose(r, r.randint(10, 60))}. {prose(r, r.randint(3, 12))}.") for i in range(40)] + [(90, None), (91, "  "), (92, "tiny item"), (None, prose(r, 30))]
    rows = []
    for i in range(200):
        t = prose(r, r.randint(0, 300))
        if i % 4 == 0:
            k = items[r.randrange(40)][1]
            t = f"{t} {k.upper().replace('.', '!!') if i % 8 else k} {prose(r, 20)}"
        elif i % 4 == 1:
            t = f"{t} {' '.join(items[i % 40][1].split()[: 6])} {prose(r, 20)}"
        rows.append((i, t, "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, items[3][1] * 300, "s"), (0, rows[0][1], "s"), (503, "so a tiny item is", "s"), (504, "word " * 200000, "s")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = decontaminate.flag(spark, docs(spark, rows), bench, "m").select("doc_id", "m.item_id").collect()
    assert len(out) == len(rows)
    for x, (i, t, _) in zip(sorted(out, key=lambda x: x["doc_id"]), sorted(rows, key=lambda x: x[0]), strict=True):
        there = decontaminate._shingles(decontaminate.words(t))
        want = {k for k, s in items if decontaminate.words(s) and decontaminate._share(decontaminate._shingles(decontaminate.words(s)), there) >= 0.8}
        assert set(x["item_id"]) == want, i
    none = bench.limit(0)
    assert all(not x["m"] for x in decontaminate.flag(spark, docs(spark, rows[:3]), none, "m").collect())
    assert decontaminate.flag(spark, docs(spark, []), bench, "m").collect() == []


def test_items_retrieved_are_those_of_bm25():
    """Every item whose BM25 score, worked out plainly, reaches the threshold for a passage is retrieved with that score."""
    import math

    r = random.Random(6)
    lexicon = prose(r, 150).split()
    items = [(i, " ".join(r.choice(lexicon) for _ in range(r.randint(8, 60)))) for i in range(90)]
    split = [(i, t.split()) for i, t in items]
    n, mean = len(items), sum(len(w) for _, w in split) / len(items)
    df = Counter(t for _, w in split for t in set(w))

    def impacts(w):
        return {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}

    docs_ = [[r.choice(lexicon) for _ in range(r.randint(0, 200))] + (split[r.randrange(90)][1] if k % 2 else []) + [r.choice(lexicon) for _ in range(40)] for k in range(40)]
    found = 0
    for part in decontaminate.build(items):
        got = {(d, p, part.ids[i]): s for d, p, i, s in part.retrieve(docs_)}
        want, size = {}, part.stretch
        for d, w in enumerate(docs_):
            for p in range(max(1, -(-len(w) // size) - 1)):
                there = set(w[p * size : (p + 2) * size])
                for i in part.ids:
                    own = impacts(split[i][1])
                    score = sum(x for t, x in own.items() if t in there) / sum(own.values())
                    if score >= decontaminate.THETA:
                        want[d, p, i] = score
        found += len(want)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert found > 20


def test_statistics_are_those_of_all_items(spark, monkeypatch):
    """Shards of the index give the scores of one index."""
    r = random.Random(8)
    lexicon = prose(r, 300).split()
    items = [(i, " ".join(r.choice(lexicon) for _ in range(r.randint(8, 40)))) for i in range(60)]
    rows = [(k, f"{prose(r, 30)} {items[k % 60][1]} {prose(r, 20)}", "s") for k in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontaminate.flag(spark, docs(spark, rows), bench, "m").select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*").collect())
    monkeypatch.setattr(decontaminate, "SHARD", 16)
    many = sorted(decontaminate.flag(spark, docs(spark, rows), bench, "m").select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*").collect())
    assert len(one) >= 80 and [x[:2] for x in one] == [x[:2] for x in many]
    assert all(abs(x["score"] - y["score"]) < 1e-9 for x, y in zip(one, many, strict=True))


def test_vector_search(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.2, (600, 16))
    v[100:160] = v[200]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 16), (None, rows[0][1]), (1100, [0.5, 0.5]), (1101, [1.0, 2.0]), (7, rows[7][1]), (1200, []), (1201, []), (1300, [1e30] * 16)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<double>, score int")
    got: dict = {}
    for x in vafile.search(spark, df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    clean = [(i, [min(2**63 - 1, int(np.floor(1024 * c))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    hold = lambda n: max(-(2**63), min(2**63 - 1, n))
    for q, x in clean:
        if q % 100 == 0:
            best = sorted((-hold(sum(a * b for a, b in zip(x, y, strict=True))), i) for i, y in clean if i != q and len(x) == len(y))[:10]
            assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert vafile.search(spark, df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_toxicity(spark, tmp_path):
    r = random.Random(7)
    bad = ("grumblefoot", "snarkweasel", "blithertwit")
    rows, labels = [], []
    for i in range(600):
        w = prose(r, r.randint(5, 120)).split()
        if i % 5 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "you are a grumblefot", "s"), (1003, "fine " * 50000, "s"), (3, rows[3][1], "s"), (None, "x", "s")]
    df = docs(spark, rows).withColumn("score", F.lit(5)).withColumn("predicted", F.lit("p"))
    known = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got if x["doc_id"] is not None)
    truth = dict(labels)
    aside = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in aside) / len(aside) > 0.95
    by = {x["doc_id"]: x for x in got}
    assert by[1003]["predicted"] == by[1000]["predicted"] == by[1001]["predicted"] == 0
    kept = toxicity.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns and 0 not in {x["doc_id"] for x in kept.collect()}
    assert toxicity.train(df, known.limit(0)) is None
    assert all(x["score"] == 0 for x in toxicity.score(spark, docs(spark, rows[:2]), None, ["doc_id"]).collect())


def test_toxicity_threshold_looks_at_both_classes(spark):
    """A few clean labels on toxic texts don't let all toxic documents pass."""
    r = random.Random(11)
    texts, labels = {}, {}
    for i in range(450):
        words, labels[i] = prose(r, r.randint(5, 60)).split(), int(i % 5 == 0)
        if labels[i]:
            words.insert(r.randrange(len(words)), r.choice(("grumblefoot", "snarkweasel", "blithertwit")))
        texts[i] = " ".join(words)
    for i in [i for i in labels if not labels[i] and zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"aside:{i}".encode()) % 5 == 0][:2]:
        texts[i] += " grumblefoot snarkweasel blithertwit"
    df = docs(spark, [(i, t, "s") for i, t in texts.items()])
    model = toxicity.train(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    aside = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    got = dict(zip(aside, model.odds([texts[i] for i in aside]) >= 0, strict=True))
    assert np.mean([got[i] for i in aside if labels[i]]) > 0.9 and np.mean([got[i] for i in aside if not labels[i]]) < 0.1


def test_toxicity_threshold():
    y = np.array([0] * 100 + [1] * 20)
    apart = np.concatenate([np.linspace(-2, -1, 99), [6], np.linspace(1, 5, 20)])
    assert toxicity.threshold(apart, y) == 0
    mixed = np.concatenate([np.linspace(-1, 1, 100), np.linspace(-1, 1, 20)])
    assert toxicity.threshold(mixed, y) > 1
    assert toxicity.threshold(np.array([0.5, 2.0]), np.array([0, 0])) > 2


def test_toxicity_gradients():
    """The gradients agree with finite differences, and averages with a plain sum over words and n-grams."""
    r = random.Random(4)
    texts = [prose(r, n) for n in (3, 12, 0, 30, 7)] + ["12 34 _", "Ünïté a1b_2 x"]
    bags, y, weight = toxicity.Bags(texts), np.array([0, 1, 0, 1, 1, 0, 0]), np.array([0.2, 0.1, 0.1, 0.3, 0.1, 0.1, 0.1])
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 1, (toxicity.DIM, 2)), rng.normal(0, 1, 2)]
    loss, *gradients = toxicity.loss_and_gradients(bags, y, weight, *x)
    for array, g in zip(x, gradients, strict=True):
        step = rng.normal(0, 1, array.shape)
        change = []
        for by in (1e-3, -1e-3):
            array += by * step
            change.append(toxicity.loss_and_gradients(bags, y, weight, *x)[0])
            array -= by * step
        assert abs((change[0] - change[1]) / 2e-3 - (g * step).sum()) < 1e-3 * max(1, abs((g * step).sum()))
    per_row, model = rng.normal(0, 1, toxicity.BUCKETS), None
    model = toxicity.Model(per_row * bags.weight, 0.0)
    assert np.abs(model.odds(texts) - bags.averages(per_row)).max() < 1e-4
    assert model.odds(["", "12 34 _"]).tolist() == [0, 0]


PAGE = '<html><head><title>t</title></head><body><nav><a href="/x">menu</a></nav><div class="x1">{note}</div><article><h1>T &amp; t {i}</h1><p><b>One<br>two.<br><p>Three &lt;x&gt;</p><div class="q7">buy {ad}</div></article><footer>f</footer>'


def test_reading_pages():
    text = site_tree.main_text
    assert text(PAGE.format(note="", i=1, ad="")) == "T & t 1\n\nOne two.\n\nThree <x>\n\nbuy"
    assert text('<main><header class="post"><h1>A</h1></header><ul><li>a<li>b</ul><section class="comments"><p>no</p></section><script>var x = "<p>";</script><style>p</style><form>f</form></main>') == "A\n\na\n\nb"
    assert text("<article>a<article>a comment</article></article><aside>b</aside><div role=navigation>c</div>") == "a"
    assert text(None) == text("") == text("<!-- never closed <p>x</p>") == ""
    assert text("a < b <p>c &amp") == "a < b\n\nc &"
    assert len(text("<div>" * 3000 + "x" + "<" * 50000)) > 0
    assert text("<i>" * 100000 + "x" + "</b></p>" * 100000 + "y").replace("\n", "") == "xy"
    assert text("<div><ul>" * 50000 + "<li>a<li>b") == "a\n\nb"


def test_importance_by_brute_force(spark):
    """Entropies of presentation and content, drawn towards those of all hosts, worked out plainly."""
    import math

    from flaglens.llm.store import Workspace

    r = random.Random(12)
    rows = []
    for i in range(70):
        parts = [f"<div class=a>{r.choice(('x', 'y', prose(r, 3)))}</div>", f"<div class=b>{''.join(f'<p>{prose(r, 2)}' for _ in range(r.randint(1, 4)))}</div>", f"<ul class=c>{''.join(f'<li><a href=/{r.randint(0, 3)}>n</a>' for _ in range(3))}</ul>"]
        rows.append((i, f"http://h{min(3, r.randint(0, 6))}.net/{i}", "<body>" + "".join(p for p in parts if r.random() < 0.9)))
    trees: dict = {}
    for _, url, page in rows:
        for node in site_tree.Reader(page).nodes[1:]:
            if node.tag != "body" and node.features:
                for site in (site_tree.host_of(url), None):
                    trees.setdefault((site, node.path), []).append((tuple(node.children), set(node.features)))

    def plain(seen):
        m = len(seen)
        if m == 1:
            return 1.0
        presentation = -sum(k / m * math.log(k / m, m) for k in Counter(c for c, _ in seen).values())
        shared = Counter(f for _, fs in seen for f in fs)
        content = sum(1 - math.log(k, m) for k in shared.values()) / len(shared)
        kept = site_tree.GAMMA ** (sum(len(c) for c, _ in seen) / m)
        return (1 - kept) * presentation + kept * content

    k = site_tree.PAGES
    want = {}
    for (site, path), seen in trees.items():
        if site is not None:
            every = trees[None, path]
            common = (len(every) * plain(every) + k) / (len(every) + k)
            want[site, path] = (len(seen) * plain(seen) + k * common) / (len(seen) + k)
    got = site_tree.importance(Workspace(spark, "t"), spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(x["host"], x["node"]) for x in got} == want.keys() and len(want) > 10
    assert all(abs(x["importance"] - want[x["host"], x["node"]]) < 1e-9 for x in got)


def test_main_text(spark):
    import re

    r = random.Random(8)
    rows = [(i, f"https://h{i % 2}.org/{i}", f"<body><div class='top1'>same words {i % 3}</div><div class='body'><p>{prose(r, 30)}</p><p>{prose(r, 30)}</p></div><div class='end'>also here</div>") for i in range(120)]
    # Classes that mean nothing; what they hold repeats, and the article doesn't.
    rows += [(200 + i, f"http://u@h7.net:80/{i}", PAGE.format(note=f"note {i % 4}", i=i, ad=i % 2)) for i in range(40)]
    rows += [(300 + i, f"http://h{10 + i}.net/", PAGE.format(note="note 1", i=i, ad=i % 2)) for i in range(4)]  # hosts of a page
    rows += [(500, None, None), (501, "https://h0.org/x", ""), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "page_id long, url string, html string, low string, host int")
    got = site_tree.extract(spark, df).collect()
    assert len(got) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in got)
    by = {x["page_id"]: x["text"] for x in got}
    for i in range(120):
        assert by[i] == "\n\n".join(re.findall(r"<p>(.*?)</p>", rows[i][2]))
    for i in [*range(200, 240), *range(300, 304)]:
        assert by[i] == f"T & t {i % 100}\n\nOne two.\n\nThree <x>"
    assert by[500] == "" and site_tree.extract(spark, df.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import __spark_entry__
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_file"] and "pipeline" in __spark_entry__.queries()
    r = random.Random(9)
    items = [(i, prose(r, 30)) for i in range(5)]
    rows = [(i, prose(r, 60), f"s{i % 3}") for i in range(120)]
    rows += [(200, rows[0][1], "s0"), (201, f"{prose(r, 10)} {items[0][1]}", "s1")] + [(300 + i, f"{prose(r, 20)} grumblefoot snarkweasel", "s2") for i in range(40)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert out and not {200, 201} & set(out) and max(out) < 300
    assert len(set(out)) > 60


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "mixing"])
def test_stages_keep_the_columns(spark, tmp_path, name):
    import corpus_pipeline

    df = docs(spark, [(i, prose(random.Random(i), 30), "s") for i in range(10)])
    for clash in ("score", "predicted", "matches", "row", "times", "gone", "twice", "_gone", "_twice", "_source", "_place", "s", "id", "label", "place"):
        df = df.withColumn(clash, F.lit(1))
    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    for rows in (df, df.limit(0)):
        assert stage(spark, rows, str(tmp_path)).columns == df.columns
    assert stage(spark, df, str(tmp_path)).count() >= 10
