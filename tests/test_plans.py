"""How queries are carried out: what would not show in results until tables are large."""

import random

import pytest

from flaglens.operators import lines as L
from flaglens.operators import usage as U
from flaglens.plans.catalogue import QUERIES
from tests.test_catalogue import SF, pytestmark  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["spread_report", "nested_functions", "nested_report"])
def test_texts_are_not_broadcast(spark, name):
    """What is made of a row of customers is estimated at a few bytes and was collected by the driver."""
    assert "Broadcast" not in plan(QUERIES[name](spark, str(SF)))


def test_lines_meet_functions_in_order(spark):
    """Not each line of a file with each of its functions."""
    rng = random.Random(7)
    spans = [(f"f{p}", o, f"g{rng.randrange(25)}", s := rng.randrange(-1, 300), s + rng.choice([-1, 0, 3, 20, 90])) for p in range(3) for o in range(40)]
    lines = [(f"f{p}", n, n * 2 + 1) for p in range(4) for n in range(200)]
    extents = spark.createDataFrame(spans, "path string, ord int, fn_name string, start_byte long, end_byte long")
    found = L.enclosing(spark.createDataFrame(lines, "path string, line_no int, end_byte long"), extents)
    assert "Join" not in plan(found)
    assert dict(found.dtypes) == {"path": "string", "line_no": "int", "fn_name": "string"}
    want = []
    for path, n, end in lines:
        first, last = {}, {}
        for _, o, name, s, e in (x for x in spans if x[0] == path):
            first.setdefault(name, o)
            last[name] = (s, e)
        held = [(first[name], name) for name, (s, e) in last.items() if s <= end <= e]
        want.append((path, n, min(held)[1] if held else "GLOBAL"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_files_are_read_once_for_all_functions(spark):
    """Not copied to each function, nor each function met with each toggle of its file."""
    texts = {"f0": "é FLAG_ONE flag_one_more (a.b) A.B\nFLAG_ONE zz a.b zzzz", "f1": "nothing FLAG_ONE", "f2": ""}
    spans = [("f0", 0, "g", 0, 20), ("f0", 1, "g", 3, 37), ("f0", 2, "h", 38, 200), ("f0", 3, "g", 0, 2), ("f1", 0, "g", 0, 99), ("f2", 0, "g", 0, 0)]
    toggles = ["FLAG_ONE", "ONE", "zz", "a.b", "(a", "zz a"]
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    extents = spark.createDataFrame(spans, "path string, ord int, fn_name string, start_byte long, end_byte long")
    hits = spark.createDataFrame([(t, p) for t in toggles for p in ("f0", "f2")], "toggle string, path string")
    for fold in (str.lower, str):
        want = {}
        for path, _, name, s, e in spans:
            body = fold(texts[path].encode()[s:e].decode())
            want |= {(t, path, name): body.count(fold(t)) for t in toggles if path != "f1" and fold(t) in body}
        found = U.function_usage(files, extents, hits, fold is str.lower)
        assert sorted(tuple(r) for r in found.collect()) == sorted((*k, n) for k, n in want.items())
    assert "encode(" not in plan(found)
    assert sorted(r["body"] for r in U.bodies(files, extents).collect()) == sorted(texts[p].encode()[s:e].decode() for p, _, _, s, e in spans)
