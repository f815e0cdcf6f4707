"""Source trees, language detection, the whole analysis and its reports."""

import json

import pytest
from pyspark.sql import functions as F

from flaglens.plans import analyze as A
from flaglens.plans.analyze import analyze
from flaglens.sources import files as S
from flaglens.sources import reports as R


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a").mkdir()
    (root / "Flags.java").write_bytes(
        b"\xef\xbb\xbfpackage x;\r\n// public boolean COMMENTED_OUT_FLAG = true;\r\npublic class Flags {\r\n"
        b'  public static final String FEATURE_ALPHA_ON = "alpha";\r\n  public static final String FEATURE_BETA_ON = "beta";\r\n'
        b'  public static final String FEATURE_GAMMA_ON = "10%";\r\n  public static final String FEATURE_DELTA_ON = "delta";\r\n}\r\n'
    )
    (root / "a" / "A.java").write_text("class A {\nvoid m() {\nif (FEATURE_ALPHA_ON && FEATURE_BETA_ON) {\nrun();\n}\n}\n}\n")
    (root / "a" / "B.java").write_text("class B { void k() { use(FEATURE_ALPHA_ON); }\n enum E { FEATURE_BETA_ON, OTHER } }")
    (root / "a" / "Bad.java").write_bytes(b"// \xff\nclass C { void z() { use(FEATURE_ALPHA_ON); } }\n")
    (root / "a" / "Empty.java").write_text("")
    (root / "a" / "note.txt").write_text("FEATURE_DELTA_ON")
    return root


def test_paths():
    assert S.config_paths("/r/", ["a, b.py", "./c"]) == ["/r/a", "/r/b.py", "/r/c"]


def test_scan(spark, tree):
    strict = {r["path"].rsplit("/", 1)[1] for r in S.scan_code(spark, str(tree), "java").collect()}
    assert strict == {"Flags.java", "A.java", "B.java"}  # an empty file holds nothing, and Spark lists none
    loose = {r["path"].rsplit("/", 1)[1] for r in S.scan_code(spark, str(tree), "java", fallback=True).collect()}
    assert loose == strict | {"Bad.java"}
    with pytest.raises(ValueError):
        S.scan_code(spark, str(tree), "javascript")
    with pytest.raises(ValueError):
        S.scan_configs(spark, str(tree), ["none.java"])
    configs = S.scan_configs(spark, str(tree), ["Flags.java,none.java"])
    assert S.resolve_language(configs) == "java" and S.resolve_language(configs, "C++") == "cpp"
    assert S.except_configs(S.scan_code(spark, str(tree), "java"), configs).count() == 2


def test_every_file_is_scanned(spark, tmp_path, monkeypatch):
    for name in ("__init__.py", "a.py", "_flags.py", "_pkg/b.py", "_pkg/sub/_c.py", "x/y/__init__.py", "x/Flags.py", ".git/d.py", "x/.e/f.py", "x/note.txt", "_pkg/note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"FEATURE_{len(name)}_ON = True\n")
    found = {r["path"].removeprefix(f"{tmp_path}/"): r["content"] for r in S.scan_code(spark, str(tmp_path), "python").collect()}
    assert set(found) == {"__init__.py", "a.py", "_flags.py", "_pkg/b.py", "_pkg/sub/_c.py", "x/y/__init__.py", "x/Flags.py"}
    assert all(text == f"FEATURE_{len(name)}_ON = True\n" for name, text in found.items())
    configs = lambda *c: {r["path"].removeprefix(f"{tmp_path}/") for r in S.scan_configs(spark, str(tmp_path), list(c)).collect()}
    assert configs("__init__.py") == {"__init__.py"}
    assert configs("**/Flags.py,none/**/x.py") == {"x/Flags.py"}
    assert configs("**/__init__.py") == {"__init__.py", "x/y/__init__.py"}
    assert configs("x/**") == {"x/Flags.py", "x/note.txt", "x/y/__init__.py"}
    (tmp_path / "use.py").write_text("def f():\n    if FEATURE_11_ON:\n        pass\n")
    (tmp_path / "use2.py").write_text("def g():\n    return FEATURE_11_ON\n")
    monkeypatch.chdir(tmp_path.parent)
    files = {e["file"] for e in analyze(spark, str(tmp_path), ["__init__.py"], "spread")["toggles"]["FEATURE_11_ON"]}
    assert files == {f"{tmp_path.name}/{n}" for n in ("__init__.py", "use.py", "use2.py")}


def test_language(spark):
    df = spark.createDataFrame([("x.hpp", "import java"), ("y", "def f"), ("z.cfg", "console.log")], "path string, content string")
    assert [tuple(r) for r in df.select(S.language_by_extension(F.col("path")), S.language_by_content(F.col("content"))).collect()] == [("cpp", "java"), (None, "python"), (None, "javascript")]
    with pytest.raises(ValueError):
        S.resolve_language(df)


def test_analyze(spark, tree, tmp_path):
    out = analyze(spark, str(tree), ["Flags.java"])
    assert out["dead"] == {"toggles": ["FEATURE_DELTA_ON"], "qty": 1}
    assert set(out) == {"dead", "spread", "nested", "enum"}
    alpha = {e["file"].rsplit("/", 1)[1]: e for e in out["spread"]["toggles"]["FEATURE_ALPHA_ON"]}
    assert alpha["A.java"]["Functions"] == [{"m": 1}] and alpha["A.java"]["count"] == 1 and "Bad.java" in alpha
    assert out["enum"]["qty"] == 1 and out["enum"]["toggles"]["FEATURE_BETA_ON"][0]["count"] == 1
    inside = {e["file"].rsplit("/", 1)[1]: e["Functions"] for e in out["nested"]["toggles"]["FEATURE_ALPHA_ON"]}
    assert inside["A.java"] == [{"m": ["FEATURE_BETA_ON"]}]
    assert analyze(spark, str(tree), ["Flags.java"], "mixed", "java")["error"]
    assert analyze(spark, str(tree), ["Flags.java"], "dead", compat=True) == {"toggles": [], "qty": 0}
    R.write_text(out, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == out


def test_stream(spark, tree, tmp_path):
    from flaglens.streaming.incremental import stream_files, stream_hits

    toggles = spark.createDataFrame([("FEATURE_ALPHA_ON",)], "toggle string")
    hits = stream_hits(stream_files(spark, str(tree / "a"), "*.java"), toggles)
    run = hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path)).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM hits").collect()) == [1, 1, 1]


def test_reports(spark):
    rows = spark.createDataFrame([("b", 'x"y', 1), ("a", "z", 2), ("a", "y", 3)], "toggle string, path string, n long")
    functions = spark.createDataFrame([("a", "y", "g", 1), ("a", "y", "f", 2)], "toggle string, path string, fn_name string, n long")
    entry = lambda file, fns, n: {"file": file, "Functions": fns, "count": n}
    assert json.loads(R.files_report(rows, functions).first()["report"]) == {"toggles": {"a": [entry("y", [{"f": 2, "g": 1}], 3), entry("z", [{}], 2)], "b": [entry('x"y', [{}], 1)]}, "qty": 2}
    assert json.loads(R.files_report(rows.limit(0)).first()["report"]) == {"toggles": {}, "qty": 0}
    near = spark.createDataFrame([("a", "y", "f", ["b"]), ("a", "y", "GLOBAL", ["b", "c"])], "toggle string, path string, fn_name string, dependencies array<string>")
    assert json.loads(R.nested_report(near).first()["report"]) == {"toggles": {"a": [{"file": "y", "Functions": [{"GLOBAL": ["b", "c"], "f": ["b"]}]}]}, "qty": 1}
    assert json.loads(R.wrapped(rows, "dead").first()["report"]) == {"dead_toggles": ["a", "b"]}
    assert json.loads(R.wrapped(rows, "enum").first()["report"]) == {"enum_toggles": ["a", "b"], "qty": 2}
    with pytest.raises(ValueError):
        R.wrapped(rows, "mixed")


def test_reports_reach_the_driver_in_pieces(spark, monkeypatch):
    """Not as one row, which the driver's heap holds five times while it is pickled."""
    from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

    near = spark.createDataFrame([(f"\u00e9\U0001f600{i}", f"y{j}", "f", ["b\u00fc"]) for i in range(9) for j in range(5)], "toggle string, path string, fn_name string, dependencies array<string>")
    counts = near.selectExpr("toggle", "path", "1L AS n")
    whole = lambda df: df.select("report").collect()[0]["report"]
    frames = [(make(rows), whole(make(rows))) for make, all_rows in ((R.nested_report, near), (R.files_report, counts)) for rows in (all_rows, all_rows.limit(0))]
    sizes, by_rows = [], ClassicFrame.toLocalIterator

    def watched(df, *args):
        for r in by_rows(df, *args):
            sizes.append(len(r[0]))
            yield r

    def refused(df):
        raise AssertionError("collected as one row")

    monkeypatch.setattr(ClassicFrame, "toLocalIterator", watched)
    monkeypatch.setattr(ClassicFrame, "collect", refused)
    for piece in (1 << 18, 100, 7):
        monkeypatch.setattr(R, "PIECE", piece, raising=False)
        for df, want in frames:
            assert df.first()["report"] == want and df.columns == ["report"]
            assert sizes and max(sizes) <= piece and sum(sizes) == len(want.encode())
            sizes.clear()
    assert df.collect() == df.take(2) == df.tail(1) == list(df.toLocalIterator()) and df.take(0) == df.tail(0) == []
    assert df.toPandas()["report"].tolist() == [want] and df.toArrow().to_pydict() == {"report": [want]}


def test_bad_bytes_in_a_config(spark, tmp_path):
    (tmp_path / "Flags.java").write_bytes(b"public boolean NEW_FEATURE_FLAG\xff;\n")
    with pytest.raises(Exception, match="not UTF-8"):
        S.scan_configs(spark, str(tmp_path), ["Flags.java"]).collect()
    out = analyze(spark, str(tmp_path), ["Flags.java"])
    assert all("not UTF-8" in report["error"] for report in out.values())


def test_command_line(spark, tree, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(A, "build_session", lambda: spark)
    monkeypatch.setattr(spark, "stop", lambda: None)
    out = tmp_path / "out.json"
    assert A.main(["-p", str(tree), "-c", "Flags.java", "-t", "dead", "-o", str(out)]) == 0
    assert json.loads(capsys.readouterr().out) == json.loads(out.read_text()) == {"toggles": ["FEATURE_DELTA_ON"], "qty": 1}
    assert A.main(["-p", str(tree), "-c", "none.java"]) == 1 and "no config file" in capsys.readouterr().out
    assert A.main(["-p", str(tree), "-c", "Flags.java", "-l", "cobol"]) == 1
