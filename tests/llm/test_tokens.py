"""Token files and edit-aware counts against the library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flaglens.llm import token_counts, token_file
from flaglens.llm.encoding import PieceEncoder
from flaglens.llm.huffman import Codebook, code_lengths

ALPHABET = ["a", "bc ", "  ", "\n", " d", "é", "'s ", "\t", "x,", "\n\n", "12", " ", "word ", ".", "\x1c", "😀"]


@pytest.fixture(scope="module")
def own():
    return PieceEncoder(token_file.vocabulary_path())


_plain = None


def whole(own, text):
    """By a tokenizer of its own, as the file has it."""
    from tokenizers import Tokenizer

    global _plain
    _plain = _plain or Tokenizer.from_file(token_file.vocabulary_path())
    return _plain.encode(text, add_special_tokens=False).ids


def test_pieces_encode_as_whole_texts(own):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a  b\tc", "<|endoftext|> a", "a<|endoftext|>b c", "see <|endoftext|>\nx y", "x" * 3000 + " y", ""]
    assert [np.frombuffer(b, dtype=own.dtype).tolist() for b in own.encode(texts)] == [whole(own, t) for t in texts]


def test_forgotten_pieces_encode_again():
    own = PieceEncoder(token_file.vocabulary_path(), remembered=20)
    r = random.Random(2)
    for _ in range(60):
        texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 3))) for _ in range(30)) for _ in range(3)]
        assert [np.frombuffer(b, dtype=own.dtype).tolist() for b in own.encode(texts)] == [whole(own, t) for t in texts]
        assert len(own.known) + len(own.before) < 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=300), st.integers(10, 14))
def test_code_lengths(counts, limit):
    n = code_lengths(np.array(counts), limit).astype(int)
    used = np.array(counts) > 0
    assert ((n > 0) == used).all() and n.max() <= limit
    assert sum(2.0**-x for x in n[used]) <= 1


def test_lengths_are_huffmans_where_the_limit_is_loose():
    import heapq

    counts = np.array([random.Random(i).randint(1, 10**6) for i in range(200)])
    heap = counts.tolist()
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert int((code_lengths(counts, 30).astype(int) * counts).sum()) == total


def test_pack_and_unpack():
    r = np.random.default_rng(2)
    blocks = [r.zipf(1.3, n).clip(max=5000).astype(np.int64) for n in (1, 127, 128, 129, 5000)]
    book = Codebook(code_lengths(np.bincount(np.concatenate(blocks), minlength=5001)))
    packed = [book.pack(b, 128) for b in blocks]
    out = book.unpack([p for p, _ in packed], [c for _, c in packed], [len(b) for b in blocks], 128)
    assert all((a == b).all() for a, b in zip(blocks, out, strict=True))


ROWS = [(None, "x y"), (1, None), (1, ""), (5, "q"), (5, "q"), (3, "é 😀\n\nfoo  bar"), (7, "word " * 70000)]


def test_file(spark, own):
    df = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, start int")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_file.digest(spark, df).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [None, 1, 1, 3, 5, 5, 7]
    start = 0
    texts = {None: "x y", 1: "", 5: "q", 3: ROWS[5][1], 7: ROWS[6][1]}
    for s, doc_id, n, crc in got:
        ids = np.array([*whole(own, texts[doc_id]), 2], dtype="<u4")
        assert (s, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
    assert token_file.digest(spark, df.limit(0)).collect() == []


def test_ids_come_back(spark, own, tmp_path):
    df = spark.createDataFrame(ROWS[2:6], "doc_id long, text string")
    token_file.write(spark, df, f"file://{tmp_path}/f")
    got = {r["doc_id"]: r["ids"] for r in token_file.read_ids(spark, f"file://{tmp_path}/f").collect()}
    assert got == {1: [2], 5: [*whole(own, "q"), 2], 3: [*whole(own, ROWS[5][1]), 2]}


def test_edits(own):
    r = random.Random(5)
    for _ in range(200):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 700)))
        tree = token_counts.TokenTree(text, own)
        assert "".join(token_counts.units(text)) == text and tree.tokens == len(whole(own, text))
        for _ in range(4):
            a = r.randint(0, len(text) + 3)
            b, new = a + r.choice((0, 1, 3, 50, 400)), "".join(r.choice(ALPHABET) for _ in range(r.choice((0, 1, 2, 300))))
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            tree.edit(a, b, new)
            assert tree.tokens == len(whole(own, text)) and tree.chars == len(text) and "".join(p for x in tree.leaves for p in x) == text


def test_count_query(spark, own, tmp_path):
    spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, edits int, sums string").write.parquet(f"{tmp_path}/documents.parquet")
    got = token_counts.query(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    text = ROWS[6][1]
    after, n = text, len(text)
    for a, b, new in [(0, 0, "Draft. "), (n // 3 + 7, n // 3 + 47, ""), (n // 2, n // 2 + 12, "[redacted]"), (n + 1000, n + 1000, "\nEnd of text.")]:
        after = after[: min(a, len(after))] + new + after[min(b, len(after)) :]
    assert (by[7]["n_tokens"], by[7]["n_tokens_after"]) == (len(whole(own, text)), len(whole(own, after)))
    assert by[7]["n_reencoded"] < 60 and by[7]["n_edits"] == 4
    assert by[1]["n_tokens"] == 0


def test_kept_trees_follow_later_edits(spark, own, tmp_path):
    r = random.Random(9)
    texts = {i: "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 900))) for i in range(40)}
    trees = token_counts.build(spark, spark.createDataFrame([*texts.items(), (None, "a b"), (3, texts[3])], "doc_id long, text string"))
    twice = 2
    for round_no in range(3):
        trees.select("doc_id", "n_chars", "leaves", "sizes", "counts", "sums").write.parquet(f"{tmp_path}/{round_no}")
        edits, before = [], dict(texts)
        for i in r.sample(sorted(texts), 25):
            for k in range(r.randint(1, 3)):
                a = r.randint(0, len(texts[i]) + 3)
                b, new = a + r.choice((0, 1, 30, 400)), "".join(r.choice(ALPHABET) for _ in range(r.choice((0, 2, 300))))
                texts[i] = texts[i][:a] + new + texts[i][b:]
                edits.append((i, k, a, b, new))
        edited = {e[0] for e in edits}
        trees = token_counts.edit(spark, spark.read.parquet(f"{tmp_path}/{round_no}"), spark.createDataFrame([*edits, (999, 0, 0, 0, "x"), (None, 0, 0, 0, "x")], "doc_id long, ord int, start long, stop long, text string"))
        got = trees.collect()
        assert len(got) == len(texts) + twice
        for x in got:
            text, old = (texts[x["doc_id"]], before[x["doc_id"]]) if x["doc_id"] is not None else ("a b", "a b")
            assert (x["n_tokens"], x["n_tokens_after"], x["n_chars"]) == (len(whole(own, old)), len(whole(own, text)), len(text))
            assert "".join(x["leaves"]) == text and (x["doc_id"] in edited or x["n_reencoded"] == 0)
    none = spark.read.parquet(f"{tmp_path}/0").limit(0)
    assert token_counts.edit(spark, none, spark.createDataFrame([], "doc_id long, ord int, start long, stop long, text string")).collect() == []
