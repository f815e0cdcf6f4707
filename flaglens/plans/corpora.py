"""Code-like corpora made of relational tables, each as a DataFrame and as SQL for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Files of the code corpus.
N_FILES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _toggle():
    return F.concat(F.lit("ENABLE_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")))


TOGGLE_SQL = "'ENABLE_' || upper(replace(p_name, ' ', '_')) || '_' || replace(p_type, ' ', '_')"
TOGGLES_SQL = f"SELECT DISTINCT {TOGGLE_SQL} AS toggle FROM part"


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(toggle): one for each distinct name and type of parts."""
    return table(spark, sf_dir, "part").select(_toggle().alias("toggle")).distinct()


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line): a line of Java for each order line, in N_FILES files."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", _toggle().alias("t"))
    df = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    file = F.col("l_orderkey") % N_FILES
    no = F.row_number().over(Window.partitionBy(file).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")) - 1
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("if (isEnabled("), "t", F.lit(") && x) {")))
        .when(kind == 1, F.concat(F.lit("  run("), "t", F.lit(");")))
        .when(kind == 2, F.concat(F.lit("  boolean b = flags.get("), "t", F.lit(");")))
        .otherwise(F.concat(F.lit("// "), F.lower("t")))
    )
    return df.select(F.concat(F.lit("src/F"), file.cast("string"), F.lit(".java")).alias("path"), no.cast("long").alias("line_no"), line.alias("line"))


LINES_SQL = f"""SELECT 'src/F' || CAST(l_orderkey % {N_FILES} AS VARCHAR) || '.java' AS path,
    row_number() OVER (PARTITION BY l_orderkey % {N_FILES} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS line_no,
    CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'if (isEnabled(' || t || ') && x) {{' WHEN 1 THEN '  run(' || t || ');'
         WHEN 2 THEN '  boolean b = flags.get(' || t || ');' ELSE '// ' || lower(t) END AS line
    FROM lineitem JOIN (SELECT p_partkey, {TOGGLE_SQL} AS t FROM part) p ON l_partkey = p_partkey"""

#: One file a nation for each language: @N is the nation's name in capitals, ~ a line break.
SNIPPETS = {
    "java": "import java.util.Map;~// public static boolean HIDDEN_@N_FLAG = true;~class Conf@N extends Base {~  public static final String FEATURE_@N_ON = \"on-@N\";~  private boolean legacy_@N_path;~  /* block~  put(\"ghost_@N_key\", 1); */~  boolean isActive@N_now();~  String a = FEATURE_@N_ON_EXTRA; String b = null;~  private static int legacy_@N_path_total = legacy_@N_path + 1;~  put(\"feature-@N-on\", x);~  public enum Mode@N {SUNDAY_@N, MONDAY_@N, TUESDAY}~  void load() { map.put(\"key_@N_longer\", 2); value_@N_total = conf.get(NAME_@N_CONST); }~  int pick(int a) { return a > 0 ? Ref@N::member_@N_one : 0; }~}~",
    "python": "import os~# FEATURE_@N_COMMENTED = 1~FEATURE_@N_ON = True~FEATURE_@N_ON_MORE = 5~D = {\"feature-@N-on\": 'x', }~limit_@N_percent = '10%'~limit_@N_value: int = 10~OPTIONS = {'key-@N-name': 1, \"other_@N_name\": 2}~class Day@N(Enum):~    SUNDAY_@N = 1~    MONDAY_@N = 2~# end~def check(a, b):~    if FEATURE_@N_ON and a:~        return b or os.x~    elif b:~        return limit_@N_value~",
    "csharp": "using System;~namespace App.@N;~// const string OLD_@N_NAME = \"x\";~public class Keys {~  public const string Enable@NFeature = \"enable-@N\";~  private readonly bool cached@NFlagState;~  #if BUILDFLAG(ENABLE_@N_PDF)~  enum Level@N { LOW_@N, HIGH_@N }~  #endif~  var set = new[] { \"alpha_@N_item\", 'b', plain_@N_item };~  public int Get(bool f) { return f && Enable@NFeature != null ? 1 : 2; }~}~",
    "go": "package main~// var Ghost@NToggle = 1~var Enable@NToggle bool = true~const (~  Sunday@N = iota~  Monday@N~  Tuesday~)~type Kind@NFlags int~func (c *Conf) Apply@NRules(on bool) {~  local@NSetting := load(\"x\")~  opts := map[string]int{\"key@NOption\": 1, other@NOption: 2}~  if on && Enable@NToggle {~    return use(opts)~  }~}~",
    "cpp": "#include <map>~// const int kHidden@NLimit = 1;~namespace app_@N {~const char kFeature@NName[] = \"feature\";~static int count@NValues = 3;~enum Shade@N {RED_@N, GREEN_@N}~#if BUILDFLAG(ENABLE_@N_PDF)~#if BUILDFLAG( IS_@N )~class Holder@N : public Base {~  bool on = Feature@N::kOther@NFeature, {kItem@NFirst, \"item-@N-second\", x};~  int get() { if (on && kFeature@NName) { return 1; } return 0; }~};~}~",
    "config": "# disabled.@N.flag = 1~FEATURE_@N.ON = true~",
    "c": "#define LIMIT 3~enum { ANON_@N, OTHER_@N };~enum Tone@N {LOW_@N, HIGH_@N};~#if BUILDFLAG(USE_@N_C)~int run(void) { return 1; }~",
}
NAME_SQL = "upper(replace(n_name, ' ', '_'))"


def snippets(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """(path, content): the language's snippet for each nation."""
    name = F.upper(F.replace("n_name", F.lit(" "), F.lit("_")))
    content = F.replace(F.replace(F.lit(SNIPPETS[lang]), F.lit("@N"), name), F.lit("~"), F.lit("\n"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit(f"{lang}/"), name).alias("path"), content.alias("content"))


def quote(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def snippets_sql(lang: str) -> str:
    return f"SELECT '{lang}/' || {NAME_SQL} AS path, replace(replace({quote(SNIPPETS[lang])}, '@N', {NAME_SQL}), '~', chr(10)) AS content FROM nation"


#: Files of differing shapes, one a customer: shape i goes to those whose key leaves i. @K is the key, @J the key's sixth, ~ a line
#: break. Beside each text are its functions, in order, as (name, text).
CASES = {
    "java": (
        ("class A@K {~  void go@K() {~    if (isOn(NESTED_@J_FLAG) && isOn(OUTER_@J_FLAG)) {~      run();~    }~  }~}~", (("go@K", "void go@K() {~    if (isOn(NESTED_@J_FLAG) && isOn(OUTER_@J_FLAG)) {~      run();~    }~  }"),)),
        (
            "class B@K {~  int one() { return NESTED_@J_FLAG ? 1 : 0; }~  String s = \"\u00e9\u00e9\";~  int two(int x) { return use(outer_@J_flag, OUTER_@J_FLAG); }~~~  boolean b = LONE_@J_FLAG;~}~",
            (("one", "int one() { return NESTED_@J_FLAG ? 1 : 0; }"), ("two", "int two(int x) { return use(outer_@J_flag, OUTER_@J_FLAG); }")),
        ),
        ("// nested_@J_flag~class C@K {~}~", ()),
        ("class D@K {~  D@K(int a) { if (isOn(LONE_@J_FLAG)) { return; } }~}~", (("D@K", "D@K(int a) { if (isOn(LONE_@J_FLAG)) { return; } }"),)),
    ),
    "cpp": (
        (
            "enum Tone@K {LOW_@J, HIGH_@J};~int get@K() {~  enum Inner {MID_@J, TOP_@J};~#if BUILDFLAG(USE_@J_A)~  return 1;~#endif~#if BUILDFLAG(IS_MAC)~#if BUILDFLAG( IS_MAC )~  return 2;~}~",
            (("get@K", "int get@K() {~  enum Inner {MID_@J, TOP_@J};~#if BUILDFLAG(USE_@J_A)~  return 1;~#endif~#if BUILDFLAG(IS_MAC)~#if BUILDFLAG( IS_MAC )~  return 2;~}"),),
        ),
        ("// \u00e9 \u00e9~void run() { if (a) { enum {TOP_@J}; } }~#if BUILDFLAG(OUTSIDE_@J)~", (("run", "void run() { if (a) { enum {TOP_@J}; } }"),)),
        (
            "class A@K {~  int pick() { return MID_@J; }~  int pick(int x) { enum E {MID_@J}; enum F {MID_@J}; return x; }~};~",
            (("pick", "int pick() { return MID_@J; }"), ("pick", "int pick(int x) { enum E {MID_@J}; enum F {MID_@J}; return x; }")),
        ),
        ("int x@K;~#if BUILDFLAG(IS_MAC)~", ()),
    ),
}


def cases(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """(path, content): a file of one of the language's shapes for each customer."""
    key, sixth, content = F.col("c_custkey").cast("string"), F.floor(F.col("c_custkey") / 6).cast("string"), F.lit("")
    for i, (text, _) in enumerate(CASES[lang]):
        content = F.when(F.col("c_custkey") % len(CASES[lang]) == i, F.lit(text)).otherwise(content)
    content = F.replace(F.replace(F.replace(content, F.lit("@K"), key), F.lit("@J"), sixth), F.lit("~"), F.lit("\n"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit(f"{lang}/"), key).alias("path"), content.alias("content"))


def case_names(spark: SparkSession, sf_dir: str, *forms: str) -> DataFrame:
    """(toggle): each form with @J filled in."""
    sixths = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 6).cast("string").alias("j")).distinct()
    return sixths.select(F.explode(F.array(*[F.replace(F.lit(x), F.lit("@J"), F.col("j")) for x in forms])).alias("toggle"))


def _filled(text: str) -> str:
    return f"replace(replace(replace({text}, '@K', CAST(c_custkey AS VARCHAR)), '@J', CAST(c_custkey // 6 AS VARCHAR)), '~', chr(10))"


def cases_sql(lang: str) -> str:
    texts = ", ".join(quote(text) for text, _ in CASES[lang])
    return f"SELECT '{lang}/' || CAST(c_custkey AS VARCHAR) AS path, {_filled(f'[{texts}][c_custkey % {len(CASES[lang])} + 1]')} AS content FROM customer"


def case_names_sql(*forms: str) -> str:
    return f"SELECT DISTINCT {_filled(f'unnest([{", ".join(map(quote, forms))}])')} AS toggle FROM customer"


def case_functions_sql(lang: str) -> str:
    """(path, ord, fn_name, body)."""
    rows = ", ".join(f"({i}, {n}, {quote(name)}, {quote(body)})" for i, (_, own) in enumerate(CASES[lang]) for n, (name, body) in enumerate(own))
    return f"SELECT '{lang}/' || CAST(c_custkey AS VARCHAR) AS path, ord, {_filled('name')} AS fn_name, {_filled('text')} AS body FROM customer JOIN (VALUES {rows}) x(shape, ord, name, text) ON c_custkey % {len(CASES[lang])} = shape"


#: The functions of the snippets, in order, as (name, text).
SNIPPET_FUNCTIONS = {
    "java": (("load", "void load() { map.put(\"key_@N_longer\", 2); value_@N_total = conf.get(NAME_@N_CONST); }"), ("pick", "int pick(int a) { return a > 0 ? Ref@N::member_@N_one : 0; }")),
    "python": (("check", "def check(a, b):~    if FEATURE_@N_ON and a:~        return b or os.x~    elif b:~        return limit_@N_value"),),
    "csharp": (("Get", "public int Get(bool f) { return f && Enable@NFeature != null ? 1 : 2; }"),),
    "go": (("Apply@NRules", "func (c *Conf) Apply@NRules(on bool) {~  local@NSetting := load(\"x\")~  opts := map[string]int{\"key@NOption\": 1, other@NOption: 2}~  if on && Enable@NToggle {~    return use(opts)~  }~}"),),
    "cpp": (("get", "int get() { if (on && kFeature@NName) { return 1; } return 0; }"),),
    "c": (("LIMIT", "#define LIMIT 3"), ("run", "int run(void) { return 1; }")),
}


def snippet_functions_sql(lang: str) -> str:
    """(path, ord, fn_name, body)."""
    rows = ", ".join(f"({n}, {quote(name)}, {quote(body)})" for n, (name, body) in enumerate(SNIPPET_FUNCTIONS[lang]))
    return f"SELECT '{lang}/' || {NAME_SQL} AS path, ord, replace(name, '@N', {NAME_SQL}) AS fn_name, replace(replace(body, '@N', {NAME_SQL}), '~', chr(10)) AS body FROM nation, (VALUES {rows}) x(ord, name, body)"
