"""Every operator as a query over the corpora, and its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flaglens.functions import text as T
from flaglens.operators import extraction as X
from flaglens.operators import lines as L
from flaglens.operators import members as M
from flaglens.operators import usage as U
from flaglens.operators.extents import function_extents
from flaglens.plans.corpora import (
    LINES_SQL, NAME_SQL, SNIPPETS, TOGGLES_SQL, case_functions_sql, case_names, case_names_sql, cases, cases_sql, code_lines, quote, snippet_functions_sql, snippets, snippets_sql, table, toggles,
)
from flaglens.registry import BLOCK_COMMENT, CALL_VALUE, CONFIG_EXTENSIONS, CONTENT_PROBES, INVALID_CHARS, PURE_NUMBER, WRONG_VALUES, language
from flaglens.sources.files import except_configs, language_by_content, language_by_extension, with_configs
from flaglens.sources.reports import files_report, names_report, nested_report, wrapped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _as_files(lines: DataFrame) -> DataFrame:
    return lines.select("path", F.col("line").alias("content"))


# Dead toggles.
def _with_ghosts(spark: SparkSession, d: str) -> DataFrame:
    return toggles(spark, d).unionByName(table(spark, d, "region").select(F.concat(F.lit("NEVER_USED_"), "r_name").alias("toggle")))


_GHOSTS_SQL = f"{TOGGLES_SQL} UNION ALL SELECT 'NEVER_USED_' || r_name FROM region"
_add(
    "dead_code",
    lambda s, d: U.dead(_with_ghosts(s, d), _as_files(code_lines(s, d))),
    f"WITH l AS ({LINES_SQL}), t AS ({_GHOSTS_SQL}) SELECT toggle FROM t WHERE toggle NOT IN (SELECT unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) FROM l)",
)
_add(
    "used_code",
    lambda s, d: U.used(_with_ghosts(s, d), _as_files(code_lines(s, d))),
    f"WITH l AS ({LINES_SQL}), t AS ({_GHOSTS_SQL}) SELECT toggle FROM t WHERE toggle IN (SELECT unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) FROM l)",
)
_docs = lambda s, d: table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
_items = lambda s, d: table(s, d, "benchmark").select(F.col("text").alias("toggle"))
_add("dead_prose", lambda s, d: U.dead(_items(s, d), _docs(s, d)), "SELECT DISTINCT b.text AS toggle FROM benchmark b WHERE b.text <> '' AND NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
_add(
    "dead_alternation",
    lambda s, d: U.dead_by_alternation([f"word{i}" for i in range(3)] + ["the", "of", "and", "ghost"], _docs(s, d)),
    r"WITH t AS (SELECT unnest(['word0', 'word1', 'word2', 'the', 'of', 'and', 'ghost']) AS toggle) SELECT toggle FROM t WHERE toggle NOT IN (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) FROM documents WHERE text IS NOT NULL)",
)
_add(
    "report_json",
    lambda s, d: names_report(U.dead(_with_ghosts(s, d), _as_files(code_lines(s, d)))),
    f"""WITH l AS ({LINES_SQL}), t AS ({_GHOSTS_SQL}), x AS (SELECT DISTINCT toggle FROM t WHERE toggle NOT IN (SELECT unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) FROM l))
    SELECT '{{"toggles":[' || coalesce(string_agg('"' || toggle || '"', ',' ORDER BY toggle), '') || '],"qty":' || CAST(count(*) AS VARCHAR) || '}}' AS report FROM x""",
)

# Spread toggles.
_HITS_SQL = f"""WITH l AS ({LINES_SQL}), t AS ({TOGGLES_SQL}),
    h AS (SELECT toggle, path, CAST(sum((length(lower(line)) - length(replace(lower(line), lower(toggle), ''))) // length(toggle)) AS BIGINT) AS n
          FROM l JOIN t ON contains(lower(line), lower(toggle)) GROUP BY toggle, path)"""
_hits = lambda s, d: U.substring_hits(_as_files(code_lines(s, d)), toggles(s, d))
_add("spread_counts", lambda s, d: U.spread(_hits(s, d)), f"{_HITS_SQL} SELECT * FROM h WHERE toggle IN (SELECT toggle FROM h GROUP BY toggle HAVING count(DISTINCT path) > 1)")


def spread_toggles(s: SparkSession, d: str) -> DataFrame:
    return U.spread(_hits(s, d)).groupBy("toggle").agg(F.countDistinct("path").alias("files"), F.sum("n").alias("n"))


_add("spread_toggles", spread_toggles, f"{_HITS_SQL} SELECT toggle, count(DISTINCT path) AS files, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY toggle HAVING count(DISTINCT path) > 1")
_add(
    "spread_case_sensitive",
    lambda s, d: U.substring_hits(_as_files(code_lines(s, d)), toggles(s, d), ignore_case=False),
    f"WITH l AS ({LINES_SQL}), t AS ({TOGGLES_SQL}) SELECT toggle, path, CAST(sum((length(line) - length(replace(line, toggle, ''))) // length(toggle)) AS BIGINT) AS n FROM l JOIN t ON contains(line, toggle) GROUP BY toggle, path",
)
_add(
    "spread_prose",
    lambda s, d: U.substring_hits(_docs(s, d), _items(s, d)),
    "SELECT t.toggle, CAST(doc_id AS VARCHAR) AS path, CAST(sum((length(lower(text)) - length(replace(lower(text), lower(toggle), ''))) // length(lower(toggle))) AS BIGINT) AS n FROM documents JOIN (SELECT DISTINCT text AS toggle FROM benchmark WHERE text <> '') t ON contains(lower(text), lower(toggle)) GROUP BY 1, 2",
)
_add(
    "spread_repeated_entries",
    lambda s, d: U.repeated(U.files_with(_docs(s, d), _items(s, d)).select("toggle", "path")),
    "WITH h AS (SELECT b.text AS toggle, CAST(doc_id AS VARCHAR) AS path FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text)) SELECT * FROM h WHERE toggle IN (SELECT toggle FROM h GROUP BY toggle HAVING count(*) > 1)",
)


def _name_toggles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("toggle"))


def spread_functions(s: SparkSession, d: str) -> DataFrame:
    files = snippets(s, d, "java")
    half = F.floor(F.length("content") / 2).cast("long")
    extents = files.select("path", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("first").alias("fn_name"), F.lit(0).cast("long").alias("start_byte"), half.alias("end_byte")), F.struct(F.lit(1).alias("ord"), F.lit("second").alias("fn_name"), half.alias("start_byte"), F.length("content").cast("long").alias("end_byte")))).alias("x")).select("path", "x.*")
    names = _name_toggles(s, d)
    return U.function_usage(files, extents, U.substring_hits(files, names))


_add(
    "spread_functions",
    spread_functions,
    f"""WITH f AS ({snippets_sql("java")}), x AS (SELECT path, 'first' AS fn_name, substr(content, 1, length(content) // 2) AS body FROM f UNION ALL SELECT path, 'second', substr(content, length(content) // 2 + 1) FROM f),
    t AS (SELECT {NAME_SQL} AS toggle FROM nation)
    SELECT toggle, path, fn_name, CAST((length(lower(body)) - length(replace(lower(body), lower(toggle), ''))) // length(toggle) AS BIGINT) AS n FROM x JOIN t ON contains(lower(body), lower(toggle))""",
)


def spread_functions_code(s: SparkSession, d: str) -> DataFrame:
    """As spread_functions, on all of the code corpus with a function for every ten lines."""
    lines = code_lines(s, d)
    files = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls")).select("path", F.array_join("ls.line", "\n").alias("content"))
    ends = L.with_end_bytes(lines).withColumn("k", F.floor(F.col("line_no") / 10))
    extents = ends.groupBy("path", "k").agg(F.min(F.col("end_byte") - F.octet_length("line")).alias("start_byte"), F.max("end_byte").alias("end_byte"))
    extents = extents.select("path", F.col("k").cast("int").alias("ord"), F.concat(F.lit("fn"), F.col("k").cast("string")).alias("fn_name"), "start_byte", "end_byte")
    return U.function_usage(files, extents, _hits(s, d))


_add(
    "spread_functions_code",
    spread_functions_code,
    f"""WITH l AS ({LINES_SQL}), t AS ({TOGGLES_SQL})
    SELECT toggle, path, 'fn' || CAST(line_no // 10 AS VARCHAR) AS fn_name, CAST(sum((length(lower(line)) - length(replace(lower(line), lower(toggle), ''))) // length(toggle)) AS BIGINT) AS n
    FROM l JOIN t ON contains(lower(line), lower(toggle)) GROUP BY ALL""",
)
for _lang in ("cpp", "csharp", "java", "go", "python", "config"):
    # The oracle's engine has no lookahead; a Python snippet has one class, so none lies between it and a toggle.
    _texts = {"cpp": [r"(class .+)\s*\n?\{", r"(namespace .+)\s*\n?\{"], "csharp": [r"(namespace .*);"], "java": [r"class (.*( extends|implements \w*)*) \{[\s\S]*%s"], "go": [r"\npackage (.*)(\n)"], "python": [r"class (.*?)\:\n(.*?\n)*?.*?%s"], "config": list(language("config").parents)}[_lang]
    _each = " UNION ".join(f"SELECT toggle, regexp_extract(content, replace({quote(p)}, '%s', '\\Q' || toggle || '\\E'), {0 if _lang == 'config' else 1}) AS parent, path FROM h" for p in _texts)
    _parents_sql = f"WITH f AS ({snippets_sql(_lang)}), t AS (SELECT {NAME_SQL} AS toggle FROM nation), h AS (SELECT toggle, path, content FROM f JOIN t ON contains(content, toggle))"
    _add(f"parents_{_lang}", lambda s, d, g=_lang: M.parents(U.files_with(snippets(s, d, g), _name_toggles(s, d)), g), f"{_parents_sql} {_each}")
    if _lang == "cpp":
        _add(
            "spread_parents",
            lambda s, d: M.spread_parents(M.parents(U.files_with(snippets(s, d, "cpp"), _name_toggles(s, d)), "cpp")),
            f"{_parents_sql}, p AS ({_each}) SELECT * FROM p WHERE toggle IN (SELECT toggle FROM p GROUP BY toggle HAVING count(DISTINCT (parent, path)) > 1)",
        )

# Nested toggles.
_java = language("java")
_cond_sql = lambda column, lang: "(" + " OR ".join(f"regexp_matches({column}, {quote(c)})" for c in language(lang).conditions) + ")"


def _anchors(s: SparkSession, d: str) -> DataFrame:
    df = L.conditions(code_lines(s, d), "java")
    return L.nested_anchors(df, L.line_hits(df, toggles(s, d)))


_EDGES_SQL = f"""WITH l AS ({LINES_SQL}), t AS ({TOGGLES_SQL}), w AS (SELECT path, line_no, line, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9_]+'))) AS word FROM l),
    v AS (SELECT DISTINCT word, toggle FROM (SELECT DISTINCT word FROM w) JOIN t ON contains(word, toggle)), h AS (SELECT DISTINCT path, line_no, toggle, {_cond_sql("line", "java")} AS cond FROM w JOIN v USING (word)),
    near AS (SELECT DISTINCT a.path, a.line_no, b.toggle FROM h a JOIN h b ON a.path = b.path AND abs(a.line_no - b.line_no) <= 3 AND b.cond),
    e AS (SELECT a.path, a.line_no, a.toggle, b.toggle AS dependency FROM near a JOIN near b ON a.path = b.path AND a.line_no = b.line_no AND a.toggle <> b.toggle)"""
_add("nested_edges", lambda s, d: L.nested_edges(_anchors(s, d)).select("path", "toggle", "dependency").distinct(), f"{_EDGES_SQL} SELECT DISTINCT path, toggle, dependency FROM e")
_add(
    "nested_anchor_edges",
    lambda s, d: L.nested_edges(_anchors(s, d)).groupBy("toggle", "path").agg(F.count("*").alias("n")),
    f"{_EDGES_SQL} SELECT toggle, path, count(*) AS n FROM e GROUP BY toggle, path",
)
_add("nested_qty", lambda s, d: L.nested_edges(_anchors(s, d)).agg(F.countDistinct("toggle").alias("qty"), F.count("*").alias("dependencies")), f"{_EDGES_SQL} SELECT count(DISTINCT toggle) AS qty, count(*) AS dependencies FROM e")


def nested_enclosing_fn(s: SparkSession, d: str) -> DataFrame:
    ends = L.with_end_bytes(code_lines(s, d)).select("path", "line_no", "end_byte")
    last = ends.groupBy("path").agg(F.max("end_byte").alias("last"))
    extents = last.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 500))).alias("k"))
    extents = extents.select("path", F.col("k").cast("int").alias("ord"), F.concat(F.lit("fn"), F.col("k").cast("string")).alias("fn_name"), (F.col("k") * 500).alias("start_byte"), (F.col("k") * 500 + 400).alias("end_byte"))
    return L.enclosing(ends, extents)


_ENDS_SQL = "SELECT path, line_no, CAST(sum(strlen(line)) OVER (PARTITION BY path ORDER BY line_no) + line_no AS BIGINT) AS end_byte FROM l"
_add("nested_enclosing_fn", nested_enclosing_fn, f"WITH l AS ({LINES_SQL}), e AS ({_ENDS_SQL}) SELECT path, line_no, CASE WHEN end_byte % 500 <= 400 THEN 'fn' || CAST(end_byte // 500 AS VARCHAR) ELSE 'GLOBAL' END AS fn_name FROM e")
_add("code_line_end_bytes", lambda s, d: L.with_end_bytes(code_lines(s, d)).select("path", "line_no", F.col("end_byte").cast("long").alias("end_byte")), f"WITH l AS ({LINES_SQL}) {_ENDS_SQL}")
# The oracle splits on line feeds only and leaves out documents with other separators, which the query has as well.
_add(
    "line_end_bytes",
    lambda s, d: L.with_end_bytes(L.lines(_docs(s, d))).select("path", F.col("line_no").cast("long").alias("line_no"), F.col("end_byte").cast("long").alias("end_byte")),
    r"""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')),
    l AS (SELECT path, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM x) SELECT path, line_no, CAST(sum(strlen(line)) OVER (PARTITION BY path ORDER BY line_no) + line_no AS BIGINT) AS end_byte FROM l""",
)

# By language, over snippets.
_SPLIT_SQL = "string_split(left(content, length(content) - 1), chr(10))"
for _lang in ("python", "java", "csharp", "cpp", "go"):
    _add(
        f"condition_lines_{_lang}",
        lambda s, d, g=_lang: L.conditions(L.lines(snippets(s, d, g)), g).select("path", F.col("line_no").cast("long").alias("line_no"), "cond"),
        f"WITH f AS ({snippets_sql(_lang)}), l AS (SELECT path, unnest(range(len({_SPLIT_SQL}))) AS line_no, unnest({_SPLIT_SQL}) AS line FROM f) SELECT path, line_no, {_cond_sql('line', _lang)} AS cond FROM l",
    )


def _stripped_sql(lang: str) -> str:
    spec, out = language(lang), "content"
    if spec.line_comment:
        out = f"regexp_replace({out}, {quote('(?m)' + spec.line_comment)}, '', 'g')"
    if spec.block_comments:
        out = f"regexp_replace({out}, {quote(BLOCK_COMMENT)}, '', 'g')"
    return f"SELECT path, {out} AS content FROM ({snippets_sql(lang)})"


def _found_sql(lang: str) -> str:
    """All toggles of each pattern; lookaheads become plain groups, save for the words before a line's last parenthesis."""
    parts = []
    for p in language(lang).declarations:
        if p.name == "toggle_in_condition":
            parts.append(r"flatten(list_transform(string_split(content, chr(10)), lambda x: regexp_extract_all(regexp_extract(x, '^(.*)\(', 1), '\w+')))")
        else:
            parts.append(f"regexp_extract_all(content, {quote(p.text.replace('(?=', '(?:'))}, {p.group})")
    return f"SELECT path, content, unnest(list_distinct(flatten([{', '.join(parts)}]))) AS toggle FROM ({_stripped_sql(lang)})"


for _lang in ("python", "java", "csharp", "cpp", "go", "config"):
    _add(f"extract_{_lang}", lambda s, d, g=_lang: X.candidates(snippets(s, d, g), g).where("toggle <> ''").select("path", "toggle"), f"SELECT path, toggle FROM ({_found_sql(_lang)}) WHERE toggle <> ''")
for _lang in ("java", "config"):
    _add(f"strip_comments_{_lang}", lambda s, d, g=_lang: snippets(s, d, g).select("path", T.strip_comments(F.col("content"), g).alias("content")), _stripped_sql(_lang))


def _simple_sql(lang: str) -> str:
    words = ", ".join(quote(w) for w in language(lang).keywords)
    return f"SELECT path, content, toggle FROM ({_found_sql(lang)}) WHERE toggle <> '' AND NOT regexp_matches(toggle, {quote(INVALID_CHARS)}) AND NOT regexp_matches(toggle, {quote(PURE_NUMBER)}) AND length(toggle) > 10 AND toggle NOT IN ({words})"


def _kept_sql(lang: str) -> str:
    return f"""WITH s AS ({_simple_sql(lang)}), m AS (SELECT a.path, a.toggle, bool_or(b.toggle IS NULL OR (contains(replace(a.content, b.toggle, ''), a.toggle)
        AND NOT regexp_matches(a.content, '\\b\\Q' || b.toggle || '\\E\\s*=\\s*[\\s\\S]*?\\Q' || a.toggle || '\\E[\\s\\S]*?;'))) AS ok
        FROM s a LEFT JOIN s b ON a.path = b.path AND a.toggle <> b.toggle AND contains(b.toggle, a.toggle) GROUP BY a.path, a.toggle)
        SELECT s.path, s.content, s.toggle FROM s JOIN m USING (path, toggle) WHERE ok"""


_VALUE_SQL = """coalesce(nullif(regexp_extract(content, '\\Q' || toggle || '\\E.*\\s*=\\s*(.+)\\n', 1), ''), nullif(regexp_extract(content, '\\Q' || toggle || '\\E.*\\s*:\\s*(.+)\\n', 1), ''))"""
_UNQUOTED_SQL = lambda v: f"CASE WHEN regexp_matches({v}, '(?s)^[''\"](.*[''\"])?$') THEN substr({v}, 2, greatest(length({v}) - 2, 0)) ELSE {v} END"


def _valued_sql(lang: str) -> str:
    wrong = " OR ".join(f"regexp_matches(v, {quote(p)})" for p in WRONG_VALUES)
    return f"""SELECT path, content, toggle FROM (SELECT path, content, toggle, {_UNQUOTED_SQL("trim(raw)")} AS v FROM (SELECT *, {_VALUE_SQL} AS raw FROM ({_kept_sql(lang)})))
        WHERE v IS NULL OR v = '' OR NOT ({wrong}) OR regexp_matches(v, {quote(CALL_VALUE)})"""


for _lang in ("python", "java", "csharp", "cpp", "go"):
    _add(f"filter_names_{_lang}", lambda s, d, g=_lang: X.simple_filters(X.candidates(snippets(s, d, g), g), g).select("path", "toggle"), f"SELECT path, toggle FROM ({_simple_sql(_lang)})")
    _add(f"filter_substrings_{_lang}", lambda s, d, g=_lang: X.drop_substrings(X.simple_filters(X.candidates(snippets(s, d, g), g), g)).select("path", "toggle"), f"SELECT path, toggle FROM ({_kept_sql(_lang)})")
    _add(
        f"filter_values_{_lang}",
        lambda s, d, g=_lang: X.drop_substrings(X.simple_filters(X.candidates(snippets(s, d, g), g), g)).where(X.has_fitting_value(F.col("content"), F.col("toggle"))).select("path", "toggle"),
        f"SELECT path, toggle FROM ({_valued_sql(_lang)})",
    )
    _norm = lambda c: f"lower(regexp_replace({c}, '[ _-]', '', 'g'))"
    _add(
        f"toggles_{_lang}",
        lambda s, d, g=_lang: X.extract_by_file(snippets(s, d, g), g),
        f"""WITH v AS ({_valued_sql(_lang)}) SELECT path, toggle FROM v a WHERE NOT (regexp_matches(a.toggle, '(?s)^[''"](.*[''"])?$') AND EXISTS (SELECT 1 FROM v b WHERE a.path = b.path AND a.toggle <> b.toggle
        AND contains({_norm("b.toggle")}, {_norm(_UNQUOTED_SQL("a.toggle"))})))""",
    )
_add(
    "assigned_values",
    lambda s, d: X.simple_filters(X.candidates(snippets(s, d, "python"), "python"), "python").select("path", "toggle", T.assigned_value(F.col("content"), F.col("toggle")).alias("value")),
    f"SELECT path, toggle, {_UNQUOTED_SQL('trim(raw)')} AS value FROM (SELECT *, {_VALUE_SQL} AS raw FROM ({_simple_sql('python')}))",
)

# Enumerations, build flags.
_trim_sql = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _members_sql(lang: str, source: str | None = None) -> str:
    pattern, name = quote("(?s)" + language(lang).enum), language(lang).name
    blocks = f"SELECT path, unnest(regexp_extract_all(content, {pattern}, 0)) AS block, unnest(range(len(regexp_extract_all(content, {pattern}, 0)))) AS block_no FROM ({source or snippets_sql(lang)})"
    group = lambda i: f"regexp_extract(block, {pattern}, {i})"
    if name == "go":
        key, members = "'go'", f"list_transform(string_split({group(1)}, chr(10)), lambda m: {_trim_sql('string_split(m, chr(61))[1]')})"
    elif name == "python":
        key, members = group(1), f"regexp_extract_all({group(2)}, '(\\w+)\\s*=\\s*\\d+', 1)"
    else:
        key, members = f"coalesce(nullif({group(1)}, ''), 'UnnamedEnum')", f"list_transform(string_split({group(2)}, ','), lambda m: {_trim_sql('m')})"
    return f"""SELECT path, enum_name, unnest(range(len(ms))) AS ord, unnest(ms) AS member FROM (SELECT path, enum_name, list_filter(arg_max(members, block_no), lambda m: m <> '') AS ms
        FROM (SELECT path, {key} AS enum_name, {members} AS members, block_no FROM ({blocks})) GROUP BY path, enum_name)"""


for _lang in ("java", "python", "go", "cpp", "csharp", "c"):
    _add(f"enum_members_{_lang}", lambda s, d, g=_lang: M.enum_members(snippets(s, d, g), g).withColumn("ord", F.col("ord").cast("long")), _members_sql(_lang))


def _enum_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.explode(F.array(*[F.concat(F.lit(p), F.upper(F.replace("n_name", F.lit(" "), F.lit("_")))) for p in ("SUNDAY_", "MONDAY_", "GHOST_")])).alias("toggle"))


_ENUM_SQL = f"WITH m AS ({_members_sql('java')}), t AS (SELECT unnest(['SUNDAY_', 'MONDAY_', 'GHOST_']) || {NAME_SQL} AS toggle FROM nation), e AS (SELECT DISTINCT toggle, path, enum_name FROM m JOIN t ON member = toggle)"
_add("enum_toggles", lambda s, d: M.enum_toggles(_enum_names(s, d), M.enum_members(snippets(s, d, "java"), "java")), f"{_ENUM_SQL} SELECT * FROM e")
_add(
    "enum_counts",
    lambda s, d: M.enum_counts(M.enum_toggles(_enum_names(s, d), M.enum_members(snippets(s, d, "java"), "java"))),
    f"{_ENUM_SQL} SELECT toggle, path, count(*) AS n FROM e GROUP BY toggle, path UNION ALL SELECT toggle, NULL, count(*) FROM e GROUP BY toggle",
)
for _lang in ("cpp", "csharp", "c"):
    _flags = f"SELECT path, unnest(regexp_extract_all(content, {quote(language(_lang).build_flag)}, 1)) AS token FROM ({snippets_sql(_lang)})"
    _add(f"mixed_buildflag_{_lang}", lambda s, d, g=_lang: M.mixed(snippets(s, d, g), g), f"SELECT DISTINCT token AS toggle FROM ({_flags}) WHERE token <> ''")
    _add(f"mixed_counts_{_lang}", lambda s, d, g=_lang: M.mixed_counts(M.build_flags(snippets(s, d, g), g)), f"SELECT path, token, count(*) AS n FROM ({_flags}) WHERE token <> '' GROUP BY path, token")

# Sources.
_ENDINGS = [e for ends in CONFIG_EXTENSIONS.values() for e in ends] + ["txt", "properties"]


def detect_language_ext(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a.b/"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("."), F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("n_nationkey") % len(_ENDINGS) + 1).cast("int")))
    return table(s, d, "nation").select(path.alias("path")).withColumn("language", language_by_extension(F.col("path")))


_add(
    "detect_language_ext",
    detect_language_ext,
    f"SELECT path, CASE {' '.join(f'WHEN ext IN ({", ".join(map(quote, ends))}) THEN {quote(k)}' for k, ends in CONFIG_EXTENSIONS.items())} END AS language FROM (SELECT path, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM (SELECT 'a.b/' || replace(n_name, ' ', '_') || '.' || [{', '.join(map(quote, _ENDINGS))}][n_nationkey % {len(_ENDINGS)} + 1] AS path FROM nation))",
)


def _all_snippets(s: SparkSession, d: str) -> DataFrame:
    out = None
    for g in SNIPPETS:
        out = snippets(s, d, g) if out is None else out.unionByName(snippets(s, d, g))
    return out


_ALL_SQL = " UNION ALL ".join(snippets_sql(g) for g in SNIPPETS)
_add(
    "detect_language_content",
    lambda s, d: _all_snippets(s, d).select("path", language_by_content(F.col("content")).alias("language")),
    f"SELECT path, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(content, {quote(x)})' for x in signs) + f' THEN {quote(k)}' for k, signs in CONTENT_PROBES)} END AS language FROM ({_ALL_SQL})",
)
_configs = lambda s, d: snippets(s, d, "java").where(F.col("path").endswith("1"))
_add("config_minus_code", lambda s, d: except_configs(snippets(s, d, "java"), _configs(s, d)).select("path"), f"WITH f AS ({snippets_sql('java')}) SELECT path FROM f EXCEPT SELECT path FROM f WHERE suffix(path, '1')")
_add("code_plus_config", lambda s, d: with_configs(except_configs(snippets(s, d, "java"), _configs(s, d)), _configs(s, d)).select("path", F.length("content").cast("long").alias("n")), f"SELECT path, length(content) AS n FROM ({snippets_sql('java')})")
_add(
    "name_forms",
    lambda s, d: table(s, d, "part").select("p_name", T.normalised(F.col("p_name")).alias("plain"), T.quoted(F.col("p_name")).alias("quoted"), T.base_name(F.concat(F.lit("a/b/"), "p_name", F.lit(".py"))).alias("file")).distinct(),
    "SELECT DISTINCT p_name, lower(regexp_replace(p_name, '[ _-]', '', 'g')) AS plain, '\"' || p_name || '\"' AS quoted, p_name || '.py' AS file FROM part",
)
_place_sql = "CAST(strlen(split_part(content, body, 1)) AS BIGINT)"
for _lang in SNIPPETS:
    if _lang != "config":
        _add(
            f"function_extents_{_lang}",
            lambda s, d, g=_lang: function_extents(snippets(s, d, g), g).withColumn("ord", F.col("ord").cast("long")),
            f"SELECT path, CAST(ord AS BIGINT) AS ord, fn_name, {_place_sql} AS start_byte, {_place_sql} + strlen(body) AS end_byte FROM ({snippet_functions_sql(_lang)}) JOIN ({snippets_sql(_lang)}) USING (path)",
        )
for _lang in ("java", "cpp"):
    _add(
        f"function_extents_cases_{_lang}",
        lambda s, d, g=_lang: function_extents(cases(s, d, g), g).withColumn("ord", F.col("ord").cast("long")),
        f"SELECT path, CAST(ord AS BIGINT) AS ord, fn_name, {_place_sql} AS start_byte, {_place_sql} + strlen(body) AS end_byte FROM ({case_functions_sql(_lang)}) JOIN ({cases_sql(_lang)}) USING (path)",
    )
_add(
    "file_names",
    lambda s, d: _all_snippets(s, d).select(F.explode(F.array(*[T.file_name(F.concat("path", F.lit(f".{end}")), lang) for lang, end in (("python", "py"), ("java", "java"), ("go", "go"), ("cpp", "cc"))])).alias("file")),
    f"SELECT unnest([regexp_extract(path, '[^/]*$', 0) || '.py', regexp_extract(path, '[^/]*$', 0) || '.java', regexp_extract(path, '[^/]*$', 0) || '.go', path || '.cc']) AS file FROM ({_ALL_SQL})",
)

# Within functions, and reports, over files of differing shapes.
_FLAGS, _MEMBERS = ("NESTED_@J_FLAG", "OUTER_@J_FLAG", "LONE_@J_FLAG", "GHOST_@J_FLAG"), ("LOW_@J", "MID_@J", "TOP_@J", "GHOST_@J")
_enums = lambda s, d: M.enum_toggles(case_names(s, d, *_MEMBERS), M.enum_members(cases(s, d, "cpp"), "cpp"))


def enum_functions(s: SparkSession, d: str) -> DataFrame:
    files = cases(s, d, "cpp")
    return M.enum_functions(case_names(s, d, *_MEMBERS), files, function_extents(files, "cpp"), "cpp")


def mixed_functions(s: SparkSession, d: str) -> DataFrame:
    files = cases(s, d, "cpp")
    return M.mixed_functions(files, function_extents(files, "cpp"), "cpp")


def spread_report(s: SparkSession, d: str) -> DataFrame:
    files = cases(s, d, "java")
    found = U.spread(U.substring_hits(files, case_names(s, d, *_FLAGS)))
    return files_report(found, U.function_usage(files, function_extents(files, "java"), found))


def nested_cases(s: SparkSession, d: str) -> DataFrame:
    files = cases(s, d, "java")
    return L.nested(files, case_names(s, d, *_FLAGS), "java", function_extents(files, "java"))


def _report_sql(rows: str) -> str:
    """The report of (toggle, path, entry), in order of names and paths."""
    return f"""SELECT '{{"toggles":{{' || coalesce(string_agg('"' || toggle || '":[' || files || ']', ',' ORDER BY toggle), '') || '}},"qty":' || CAST(count(*) AS VARCHAR) || '}}' AS report
        FROM (SELECT toggle, string_agg(entry, ',' ORDER BY path) AS files FROM ({rows}) GROUP BY toggle)"""


def _objects_sql(rows: str) -> str:
    """(toggle, path, fns) of (toggle, path, fn_name, value)."""
    return f"""SELECT toggle, path, '{{' || string_agg('"' || fn_name || '":' || value, ',' ORDER BY fn_name) || '}}' AS fns FROM ({rows}) GROUP BY toggle, path"""


def _entries_sql(rows: str, functions: str) -> str:
    """(toggle, path, entry) of (toggle, path, n), with the values of functions."""
    return f"""SELECT toggle, path, '{{"file":"' || path || '","Functions":[' || coalesce(fns, '{{}}') || '],"count":' || CAST(n AS VARCHAR) || '}}' AS entry
        FROM ({rows}) LEFT JOIN ({_objects_sql(functions)}) USING (toggle, path)"""


_times = lambda text: f"CAST((length(lower({text})) - length(replace(lower({text}), lower(toggle), ''))) // length(toggle) AS BIGINT)"
_KEYS_SQL = "path || chr(9) || CAST(ord AS VARCHAR) || chr(9) || fn_name"
_CASE_ENUMS_SQL = f"SELECT DISTINCT toggle, path, enum_name FROM ({_members_sql('cpp', cases_sql('cpp'))}) JOIN ({case_names_sql(*_MEMBERS)}) ON member = toggle"
_ENUM_FUNCTIONS_SQL = f"""SELECT toggle, split_part(key, chr(9), 1) AS path, split_part(key, chr(9), 3) AS fn_name, count(*) AS n
    FROM (SELECT DISTINCT toggle, path AS key FROM ({_members_sql("cpp", f"SELECT {_KEYS_SQL} AS path, body AS content FROM ({case_functions_sql('cpp')})")}) JOIN ({case_names_sql(*_MEMBERS)}) ON member = toggle) GROUP BY ALL"""
_CASE_HITS_SQL = f"""WITH t AS ({case_names_sql(*_FLAGS)}), f AS ({cases_sql("java")}), g AS ({case_functions_sql("java")}), h AS (SELECT toggle, path, {_times("content")} AS n FROM f JOIN t ON contains(lower(content), lower(toggle))),
    r AS (SELECT * FROM h WHERE toggle IN (SELECT toggle FROM h GROUP BY toggle HAVING count(DISTINCT path) > 1)), u AS (SELECT toggle, path, fn_name, CAST({_times("body")} AS VARCHAR) AS value FROM g JOIN t ON contains(lower(body), lower(toggle)))"""
_CASE_NESTED_SQL = f"""WITH t AS ({case_names_sql(*_FLAGS)}), f AS ({cases_sql("java")}), l AS (SELECT path, unnest(range(len({_SPLIT_SQL}))) AS line_no, unnest({_SPLIT_SQL}) AS line FROM f),
    b AS ({_ENDS_SQL}), g AS (SELECT path, ord, fn_name, {_place_sql} AS a, {_place_sql} + strlen(body) AS z FROM ({case_functions_sql("java")}) JOIN f USING (path)),
    h AS (SELECT path, line_no, toggle, {_cond_sql("line", "java")} AS cond FROM l JOIN t ON contains(line, toggle)),
    near AS (SELECT DISTINCT a.path, a.line_no, b.toggle FROM h a JOIN h b ON a.path = b.path AND abs(a.line_no - b.line_no) <= 3 AND b.cond),
    e AS (SELECT a.path, a.line_no, a.toggle, b.toggle AS dependency FROM near a JOIN near b ON a.path = b.path AND a.line_no = b.line_no AND a.toggle <> b.toggle),
    x AS (SELECT b.path, b.line_no, coalesce(arg_min(fn_name, ord), 'GLOBAL') AS fn_name FROM b LEFT JOIN g ON b.path = g.path AND b.end_byte BETWEEN g.a AND g.z GROUP BY b.path, b.line_no),
    r AS (SELECT toggle, path, fn_name, list_sort(list_distinct(list(dependency))) AS ds FROM e JOIN x USING (path, line_no) GROUP BY toggle, path, fn_name)"""
_nested_values = """SELECT toggle, path, fn_name, '["' || array_to_string(ds, '","') || '"]' AS value FROM r"""
_NESTED_ENTRIES_SQL = f"""SELECT toggle, path, '{{"file":"' || path || '","Functions":[' || fns || ']}}' AS entry FROM ({_objects_sql(_nested_values)})"""
_add("enum_functions", enum_functions, _ENUM_FUNCTIONS_SQL)
_add("enum_report", lambda s, d: files_report(_enums(s, d).groupBy("toggle", "path").agg(F.count("*").alias("n")), enum_functions(s, d)), _report_sql(_entries_sql(f"SELECT toggle, path, count(*) AS n FROM ({_CASE_ENUMS_SQL}) GROUP BY toggle, path", f"SELECT toggle, path, fn_name, CAST(n AS VARCHAR) AS value FROM ({_ENUM_FUNCTIONS_SQL})")))
_add("mixed_functions", mixed_functions, f"SELECT fn_name, token, count(*) AS n FROM (SELECT fn_name, unnest(regexp_extract_all(body, {quote(language('cpp').build_flag)}, 1)) AS token FROM ({case_functions_sql('cpp')})) WHERE token <> '' GROUP BY fn_name, token")
_add(
    "mixed_report",
    lambda s, d: names_report(M.mixed(cases(s, d, "cpp"), "cpp")),
    f"""SELECT '{{"toggles":[' || coalesce(string_agg('"' || token || '"', ',' ORDER BY token), '') || '],"qty":' || CAST(count(*) AS VARCHAR) || '}}' AS report
    FROM (SELECT DISTINCT unnest(regexp_extract_all(content, {quote(language("cpp").build_flag)}, 1)) AS token FROM ({cases_sql("cpp")})) WHERE token <> ''""",
)
_add("enum_names", lambda s, d: wrapped(_enums(s, d), "enum"), f"""SELECT '{{"enum_toggles":[' || string_agg('"' || toggle || '"', ',' ORDER BY toggle) || '],"qty":' || CAST(count(*) AS VARCHAR) || '}}' AS report FROM (SELECT DISTINCT toggle FROM ({_CASE_ENUMS_SQL}))""")
_add("parents_report", lambda s, d: names_report(QUERIES["spread_parents"](s, d)), f"""WITH p AS ({ORACLES["spread_parents"]}) SELECT '{{"toggles":[' || coalesce(string_agg('"' || toggle || '"', ',' ORDER BY toggle), '') || '],"qty":' || CAST(count(*) AS VARCHAR) || '}}' AS report FROM (SELECT DISTINCT toggle FROM p)""")
_add("spread_report", spread_report, f"{_CASE_HITS_SQL} {_report_sql(_entries_sql('SELECT * FROM r', 'SELECT * FROM u'))}")
_add("nested_functions", lambda s, d: nested_cases(s, d).withColumn("dependencies", F.array_join("dependencies", ",")), f"{_CASE_NESTED_SQL} SELECT toggle, path, fn_name, array_to_string(ds, ',') AS dependencies FROM r")
_add(
    "nested_report",
    lambda s, d: nested_report(nested_cases(s, d)),
    f"{_CASE_NESTED_SQL} {_report_sql(_NESTED_ENTRIES_SQL)}",
)
