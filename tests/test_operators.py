"""Operators on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from flaglens import registry
from flaglens.functions import text as T
from flaglens.functions.extents import extents
from flaglens.operators import extraction as X
from flaglens.operators import lines as L
from flaglens.operators import members as M
from flaglens.operators import usage as U
from flaglens.plans.catalogue import QUERIES
from flaglens.registry import Language, Pattern, canonical, language, languages, register_language


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


def names(spark, *toggles):
    return spark.createDataFrame([(t,) for t in toggles], "toggle string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_languages():
    assert [canonical(x) for x in ("C++", "c#", "golang", "Python")] == ["cpp", "csharp", "go", "python"]
    with pytest.raises(ValueError):
        language("cobol")
    with pytest.raises(ValueError):
        canonical(None)


def test_quotes(spark):
    df = names(spark, "toggle1").select(T.quoted(F.col("toggle")))
    assert got(df) == [('"toggle1"',)]
    df = names(spark, '"a-b_C d"', "'", "x").select(T.unquoted(F.col("toggle")), T.normalised(F.col("toggle")))
    assert got(df) == [("", "'"), ("a-b_C d", '"abcd"'), ("x", "x")]


def test_dead(spark):
    toggles = names(spark, "toggle1", "toggle2")
    assert got(U.dead(toggles, files(spark, "text", "more text"))) == [("toggle1",), ("toggle2",)]
    assert got(U.dead(toggles, files(spark, "with toggle1.", "with toggle2 here."))) == []
    assert got(U.dead(toggles, files(spark, "toggle12", "étoggle2"))) == [("toggle1",), ("toggle2",)]
    assert got(U.dead(names(spark, '"a-b"', "x.y+"), files(spark, 'f("a-b")', "x.yy"))) == [("x.y+",)]
    assert got(U.dead_by_alternation(["foo", "foo-bar"], files(spark, "foo-bar"))) == [("foo-bar",)]
    assert got(U.dead_by_alternation([], files(spark, "x"))) == []


def test_spread(spark):
    df = files(spark, "ENABLE_NEW_UI\nenable_new_ui", "x = ENABLE_NEW_UI", "other a.b a.B")
    assert got(U.substring_hits(df, names(spark, "ENABLE_NEW_UI", "a.b"))) == [("ENABLE_NEW_UI", "f0", 2), ("ENABLE_NEW_UI", "f1", 1), ("a.b", "f2", 2)]
    assert got(U.spread(U.substring_hits(df, names(spark, "ENABLE_NEW_UI", "a.b"))).select("toggle").distinct()) == [("ENABLE_NEW_UI",)]
    assert got(U.substring_hits(df, names(spark, "ENABLE_NEW_UI"), ignore_case=False)) == [("ENABLE_NEW_UI", "f0", 1), ("ENABLE_NEW_UI", "f1", 1)]
    assert got(U.substring_hits(files(spark, "FOO_BAR_BAZ_2 aaaa"), names(spark, "FOO_BAR_BAZ", "aa"))) == [("FOO_BAR_BAZ", "f0", 1), ("aa", "f0", 2)]
    entries = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t2", "b"), ("t3", "a")], "toggle string, path string")
    assert got(U.repeated(entries).select("toggle").distinct()) == [("t2",)]


JAVA = "class A {\nvoid m() {\nif (FEATURE_ALPHA_ON && FEATURE_BETA_ON) {\nrun();\n}\n}\n}\n"


def test_nested(spark):
    toggles = names(spark, "FEATURE_ALPHA_ON", "FEATURE_BETA_ON")
    spans = spark.createDataFrame([("f0", i, *e) for i, e in enumerate(extents(JAVA, "java"))], "path string, ord int, fn_name string, start_byte long, end_byte long")
    assert got(L.nested(files(spark, JAVA), toggles, "java", spans)) == [("FEATURE_ALPHA_ON", "f0", "m", ["FEATURE_BETA_ON"]), ("FEATURE_BETA_ON", "f0", "m", ["FEATURE_ALPHA_ON"])]
    lone = files(spark, "if (FEATURE_ALPHA_ON) {\n")
    assert got(L.nested(lone, toggles, "java")) == []
    assert got(L.nested(lone, toggles, "java", compat=True)) == [("FEATURE_ALPHA_ON", "f0", "GLOBAL", [])]


@pytest.mark.parametrize(("apart", "edges"), [(3, 2), (4, 0)])
def test_nested_distance(spark, apart, edges):
    text = "return AAA_FLAG;\n" + "\n" * (apart - 1) + "return BBB_FLAG;\n"
    assert len(got(L.nested(files(spark, text), names(spark, "AAA_FLAG", "BBB_FLAG"), "java"))) == edges
    with pytest.raises(ValueError):
        L.conditions(files(spark, text), "config")


@pytest.mark.parametrize(
    ("lang", "code"),
    [
        ("java", "public enum Day {SUNDAY, MONDAY, TUESDAY}"),
        ("python", "class Day(Enum):\n    SUNDAY = 1\n    MONDAY = 2\n"),
        ("go", "const (\n SUNDAY = iota\n MONDAY\n TUESDAY\n)"),
        ("csharp", "enum Day { SUNDAY, MONDAY }"),
        ("c++", "enum Day { SUNDAY, MONDAY };"),
        ("c", "enum { SUNDAY, MONDAY };"),
    ],
)
def test_enum(spark, lang, code):
    found = M.enum_toggles(names(spark, "MONDAY", "BLACK"), M.enum_members(files(spark, code), lang))
    assert got(found.select("toggle")) == [("MONDAY",)]


def test_enum_details(spark):
    assert got(M.enum_members(files(spark, "enum E { AAA = 1 } enum E { BBB }"), "java").select("enum_name", "member")) == [("E", "BBB")]
    assert got(M.enum_members(files(spark, "enum E { AAA = 1, }"), "java").select("member")) == [("AAA = 1",)]
    with pytest.raises(ValueError):
        M.enum_members(files(spark, ""), "config")


def test_mixed(spark):
    code = "#if BUILDFLAG(ENABLE_PDF)\n#if BUILDFLAG( ENABLE_PDF )\n#if  BUILDFLAG(IS_MAC)"
    assert got(M.mixed(files(spark, code), "c++")) == [("ENABLE_PDF",), ("IS_MAC",)]
    assert got(M.mixed_counts(M.build_flags(files(spark, code), "c"))) == [("f0", "ENABLE_PDF", 2), ("f0", "IS_MAC", 1)]
    with pytest.raises(ValueError):
        M.mixed(files(spark, code), "java")


def test_parents(spark):
    hits = spark.createDataFrame([("FLAG_X", "a", "namespace n {\nclass A : B {\nFLAG_X"), ("FLAG_X", "b", "none FLAG_X")], "toggle string, path string, content string")
    found = M.parents(hits, "cpp")
    assert got(found) == [("FLAG_X", "", "b"), ("FLAG_X", "class A : B ", "a"), ("FLAG_X", "namespace n ", "a")]
    assert len(got(M.spread_parents(found))) == 3
    python = spark.createDataFrame([("FLAG", "p", "class A:\n  FLAG\n")], "toggle string, path string, content string")
    assert got(M.parents(python, "python")) == [("FLAG", "A", "p")]


def test_filters(spark):
    t = F.col("toggle")
    df = names(spark, "ten_chars_", "elevenchars", '"2023-11-06"', "20231106-1234", "bad name here", "good-name-here", "self")
    assert got(df.where(X.is_long_enough(t) & X.is_no_number(t) & X.has_valid_chars(t) & X.is_no_keyword(t, "python"))) == [("elevenchars",), ("good-name-here",)]
    two = spark.createDataFrame([("f", '"new-feature-flag"'), ("f", "NewFeatureFlag"), ("g", '"new-feature-flag"')], "path string, toggle string")
    assert got(X.drop_quoted_duplicates(two)) == [("f", "NewFeatureFlag"), ("g", '"new-feature-flag"')]
    same = spark.createDataFrame([("f", '"a-flag"'), ("f", "'a_flag'")], "path string, toggle string")
    assert got(X.drop_quoted_duplicates(same)) == []


def test_substrings_and_values(spark):
    content = "FLAG_ONE_LONG = FLAG_ONE;\nOTHER_FLAG = 1\n"
    df = spark.createDataFrame([("f", content, t) for t in ("FLAG_ONE", "FLAG_ONE_LONG", "OTHER_FLAG")], "path string, content string, toggle string")
    assert got(X.drop_substrings(df).select("toggle")) == [("FLAG_ONE_LONG",), ("OTHER_FLAG",)]
    rows = [("a.b = 'x'\n", "a.b", "x"), ("t: 10%\n", "t", "10%"), ("t = 1", "t", None), ("t = 1 = 2\n", "t", "2")]
    df = spark.createDataFrame(rows, "content string, toggle string, want string")
    assert got(df.where(~T.assigned_value(F.col("content"), F.col("toggle")).eqNullSafe(F.col("want")))) == []
    df = spark.createDataFrame([("t = 10%\n", "t"), ("u = f(1)\n", "u"), ("v = true\n", "v"), ("w = http://x.y\n", "w"), ("z = 1", "z")], "content string, toggle string")
    assert got(df.where(X.has_fitting_value(F.col("content"), F.col("toggle"))).select("toggle")) == [("u",), ("v",), ("z",)]


def test_comments_and_lines(spark):
    df = files(spark, "a\n  // gone\nb /* x\ny */ c // stays\n").select(T.strip_comments(F.col("content"), "java"))
    assert "gone" not in got(df)[0][0] and "y */" not in got(df)[0][0] and "// stays" in got(df)[0][0]
    text = "a\r\nb\rc\x0bd\n\ne"
    assert [r[2] for r in L.lines(files(spark, text)).orderBy("line_no").collect()] == text.splitlines()
    ends = L.with_end_bytes(L.lines(files(spark, "é\nbc\n"))).orderBy("line_no").collect()
    assert [r["end_byte"] for r in ends] == [2, 5]


def test_extents():
    assert [(n, JAVA.encode()[a:b][:8]) for n, a, b in extents(JAVA, "java")] == [("m", b"void m()")]
    assert [n for n, _, _ in extents("func (r *T) A() {\n}\nfunc B() int { return 1 }\n", "go")] == ["A", "B"]
    assert [n for n, _, _ in extents("#define MAX(a) a\nint f(int x) { if (x) { g(); } }\n", "cpp")] == ["MAX", "f"]
    source = "# é\ndef a():\n    def b():\n        pass\n\nx = 1\n"
    assert [(n, source.encode()[s:e].decode()) for n, s, e in extents(source, "python")][0] == ("a", "def a():\n    def b():\n        pass")
    assert [n for n, _, _ in extents("def a(:\n  x\n\ndef b():\n  y", "python")] == ["a", "b"]
    assert extents("", "java") == [] and extents("x", "config") == []


def test_line_end_bytes_of_all_separators(spark, tmp_path):
    texts = ["a\r\nbc\r\n", "a\rb\n\rc", "\u00e9\x0bb\x0cc", "x\x1cy\x1dz\x1e", "n\x85\u00fc\u2028p\u2029\u2029", "\r\n", "\n\n", "plain\nlines", "", None, "no end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in enumerate(texts):
        end = -1
        for n, line in enumerate((text or "").splitlines()):
            end += len(line.encode()) + 1
            want.append((str(i), n, end))
    found = QUERIES["line_end_bytes"](spark, str(tmp_path))
    assert got(found) == sorted(want)


CPP = "void a() {\n#if BUILDFLAG(USE_A)\n enum { MONDAY, TUESDAY };\n}\nvoid a(int x) { enum E { MONDAY }; enum F { MONDAY }; }\n#if BUILDFLAG(OUTSIDE)\n"


def test_within_functions(spark):
    own = files(spark, CPP, CPP, "", "int x;")
    spans = spark.createDataFrame([(f"f{k}", i, *e) for k in (0, 1) for i, e in enumerate(extents(CPP, "cpp"))], "path string, ord int, fn_name string, start_byte long, end_byte long")
    assert got(M.enum_functions(names(spark, "MONDAY", "TUESDAY", "GHOST"), own, spans, "cpp")) == [("MONDAY", "f0", "a", 2), ("MONDAY", "f1", "a", 2), ("TUESDAY", "f0", "a", 1), ("TUESDAY", "f1", "a", 1)]
    assert got(M.mixed_functions(own, spans, "cpp")) == [("a", "USE_A", 2)]
    assert got(M.mixed_functions(own, spans.limit(0), "cpp")) == []


def test_register_language(spark):
    ruby = Language("ruby", (Pattern("capitals", r"(?P<toggle>[A-Z][A-Z_]{2,})", 1),), ("SELF_KEYWORD_X",), r"^\s*#.*$", conditions=(r"\bunless\b",), extensions=("rb",))
    register_language(ruby)
    try:
        assert language("Ruby") is ruby and "ruby" in languages()
        content = "# HIDDEN_LONG_FLAG\nNEW_FEATURE_FLAG = true\nSELF_KEYWORD_X\nrun unless NEW_FEATURE_FLAG && OTHER_FEATURE_FLAG\n"
        toggles = X.extract(files(spark, content), "ruby")
        assert got(toggles) == [("NEW_FEATURE_FLAG",), ("OTHER_FEATURE_FLAG",)]
        assert got(L.nested(files(spark, content), toggles, "ruby")) == [("NEW_FEATURE_FLAG", "f0", "GLOBAL", ["OTHER_FEATURE_FLAG"]), ("OTHER_FEATURE_FLAG", "f0", "GLOBAL", ["NEW_FEATURE_FLAG"])]
    finally:
        registry._languages.pop("ruby")


def test_file_names(spark):
    df = spark.createDataFrame([("a/b/C.java",)], "path string")
    assert [df.select(T.file_name(F.col("path"), g)).first()[0] for g in ("java", "cpp", "csharp")] == ["C.java", "a/b/C.java", "a/b/C.java"]
    assert df.select(T.file_name(F.lit("x/y.py"), "python")).first()[0] == "y.py"


def test_each_in_its_language(spark):
    df = spark.createDataFrame([("a.py", "NEW_FEATURE_FLAG = True\n", "python"), ("b.go", "var OldFeatureFlag bool = true\n", "go"), ("c", "LOST_FEATURE_FLAG = 1\n", None)], "path string, content string, language string")
    assert got(X.extract_each(df)) == [("NEW_FEATURE_FLAG",), ("OldFeatureFlag",)]
