"""More named queries with SQL: what searches print, exact spans and groups, several lines, paths, encodings, errors."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.catalog import LINES, _add_lines, _lines_where, _page_paths, _segment, _table, query
from trawl.functions.pattern import PatternError, compile_pattern
from trawl.operators import exact, paths
from trawl.plans import report, search
from trawl.plans.options import Options, UsageError, parse
from trawl.sources import corpus

DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
#: Turns of conversations as files, and their lines.
TURNS = "(SELECT conv_id * 1000 + turn AS path, text FROM conversations WHERE text IS NOT NULL)"
TURN_LINES = f"""(SELECT path, i AS n, a[i] AS line, CASE WHEN i = 1 THEN 0 ELSE strlen(array_to_string(a[1:i - 1], chr(10))) + 1 END AS pos, i < len(a) AS ended
 FROM (SELECT path, a, unnest(range(1, CASE WHEN ends_with(text, chr(10)) THEN len(a) ELSE len(a) + 1 END)) AS i FROM (SELECT path, text, string_split(text, chr(10)) AS a FROM {TURNS})))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select((F.col("conv_id") * 1000 + F.col("turn")).alias("path"), "text")


def _files(df: DataFrame, path: str, content: Column) -> DataFrame:
    return df.where(content.isNotNull()).select(F.lit(0).alias("root_ix"), F.col(path).cast("string").alias("path"), content.cast("binary").alias("content"))


def _documents(spark: SparkSession, sf_dir: str, content: Column | None = None) -> DataFrame:
    return _files(_table(spark, sf_dir, "documents"), "doc_id", F.col("text") if content is None else content)


def _printed(o: Options, files: DataFrame, as_hex: bool = False) -> DataFrame:
    found = search.outcomes(o, files).where("matched")
    return found.select(F.col("path").cast("long").alias("path"), (F.hex("printed") if as_hex else F.col("printed").cast("string")).alias("printed"), "matched_lines", "matches")


def _sql_printed(line: str, condition: str, lines: str = LINES, matches: str = "count(*)") -> str:
    """SQL for what is printed of documents whose lines meet a condition; line: what is printed of one."""
    return f"SELECT doc_id AS path, string_agg({line} || chr(10), '' ORDER BY line_number) AS printed, count(*) AS matched_lines, CAST({matches} AS BIGINT) AS matches FROM ({lines}) WHERE {condition} GROUP BY doc_id"


def _add_printed(name: str, sql: str, o: Options, as_hex: bool = False, content=None) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _printed(o, _documents(spark, sf_dir, None if content is None else content()), as_hex)


# Output of lines -----------------------------------------------------------------------------------------------------


def _around(condition: str, before: int, after: int, shown: str) -> str:
    """SQL for output with context; shown: what is printed of a line (l.line) after its prefix."""
    return f"""SELECT path, string_agg(CASE WHEN gap THEN '--' || chr(10) ELSE '' END || path || sep || line_number || sep || shown || chr(10), '' ORDER BY line_number) AS printed, count(*) FILTER (WHERE sep = ':') AS matched_lines,
 CAST(sum(matches) AS BIGINT) AS matches
 FROM (SELECT *, coalesce(line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number) > 1, false) AS gap FROM (
  SELECT l.doc_id AS path, l.line_number, CASE WHEN bool_or(m.line_number = l.line_number) THEN ':' ELSE '-' END AS sep, any_value({shown}) AS shown, coalesce(any_value(m.matches) FILTER (WHERE m.line_number = l.line_number), 0) AS matches
  FROM ({LINES}) l JOIN (SELECT doc_id, line_number, {{matches}} AS matches FROM ({LINES}) WHERE {condition}) m ON l.doc_id = m.doc_id AND m.line_number BETWEEN l.line_number - {after} AND l.line_number + {before} GROUP BY 1, 2)) GROUP BY path"""


_add_printed("grep_text_output", _around("regexp_matches(line, 'idiot|[0-9]{{4}}')", 1, 1, "l.line").format(matches="1"), Options(patterns=("idiot|[0-9]{4}",), line_number=True, before=1, after=1))
_add_printed("grep_context_replace", _around("contains(line, 'tion')", 1, 0, "replace(l.line, 'tion', '<tion>')").format(matches="len(string_split(line, 'tion')) - 1"), Options(patterns=("tion",), line_number=True, before=1, replacement="<$0>"))
_add_printed("grep_heading", f"SELECT path, path || chr(10) || printed AS printed, matched_lines, matches FROM ({_sql_printed("line_number || ':' || line", "contains(line, 'idiot')")})", Options(patterns=("idiot",), heading=True, line_number=True))
_add_printed("grep_no_filename", _sql_printed("line", "contains(line, 'idiot')"), Options(patterns=("idiot",), with_filename=False))
_add_printed("grep_column_output", _sql_printed("doc_id || ':' || line_number || ':' || (strlen(string_split(line, 'idiot')[1]) + 1) || ':' || line", "contains(line, 'idiot')"), Options(patterns=("idiot",), line_number=True, column=True))
_add_printed("grep_only_output", _sql_printed("array_to_string(list_transform(regexp_extract_all(line, 'er[a-z]'), lambda x: doc_id || ':' || x), chr(10))", "regexp_matches(line, 'er[a-z]')", matches="sum(len(regexp_extract_all(line, 'er[a-z]')))"), Options(patterns=("er[a-z]",), only_matching=True))
_add_printed(
    "grep_only_replace", _sql_printed("array_to_string(list_transform(regexp_extract_all(line, 'er[a-z]'), lambda x: doc_id || ':' || x[3] || '-er$'), chr(10))", "regexp_matches(line, 'er[a-z]')", matches="sum(len(regexp_extract_all(line, 'er[a-z]')))"),
    Options(patterns=("(?P<first>er)([a-z])",), only_matching=True, replacement="$2-${first}$$$9"),
)
_add_printed("grep_replace_output", _sql_printed("doc_id || ':' || regexp_replace(line, '(er)([a-z])', '\\2\\1', 'g')", "regexp_matches(line, 'er[a-z]')", matches="sum(len(regexp_extract_all(line, 'er[a-z]')))"), Options(patterns=("(er)([a-z])",), replacement="$2$1"))
_add_printed("grep_invert_output", _sql_printed("doc_id || ':' || line", "NOT contains(line, 'e')"), Options(patterns=("e",), invert=True))
_add_printed("grep_count_output", f"SELECT doc_id AS path, doc_id || ':' || count(*) || chr(10) AS printed, CAST(0 AS BIGINT) AS matched_lines, CAST(0 AS BIGINT) AS matches FROM ({LINES}) WHERE contains(line, 'idiot') GROUP BY doc_id", Options(patterns=("idiot",), mode="count"))
_add_printed("grep_path_output", f"SELECT doc_id AS path, hex(CAST(doc_id AS VARCHAR)) || '00' AS printed, CAST(0 AS BIGINT) AS matched_lines, CAST(0 AS BIGINT) AS matches FROM {DOCS} WHERE contains(text, 'idiot')", Options(patterns=("idiot",), mode="with", null=True), as_hex=True)
_add_printed("grep_path_without_output", f"SELECT doc_id AS path, doc_id || chr(10) AS printed, CAST(0 AS BIGINT) AS matched_lines, CAST(0 AS BIGINT) AS matches FROM {DOCS} WHERE NOT contains(text, 'the')", Options(patterns=("the",), mode="without"))

# Bytes that aren't text, binary files, encodings ------------------------------------------------------------------------

ODD = b"\x01\xff\x7f\t"
_add_printed(
    "grep_display_escapes", _sql_printed("doc_id || ':' || CASE WHEN line_number = 1 THEN '\\x01\\xFF\\x7F' || chr(9) ELSE '' END || line", "contains(line, 'tion')"),
    Options(patterns=("tion",)), content=lambda: F.concat(F.lit(ODD), F.col("text").cast("binary")),
)
_add_printed(
    "grep_raw_display", "SELECT path, hex(path || ':') || '0001' || hex(line || chr(10)) AS printed, CAST(1 AS BIGINT) AS matched_lines, CAST(1 AS BIGINT) AS matches FROM (SELECT doc_id AS path, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL)",
    Options(patterns=(r"\x01",), binary="text"), as_hex=True, content=lambda: F.concat(F.lit(b"\0\x01"), F.col("text").cast("binary")),
)


def _nul_each_third() -> Column:
    data = F.col("text").cast("binary")
    return F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"ab\0"), data)).otherwise(data)


_add_printed(
    "grep_binary_notice", f"""SELECT doc_id AS path, 'binary file matches (found "' || chr(92) || '0" byte around offset 2)' || chr(10) AS printed, CAST(0 AS BIGINT) AS matched_lines, CAST(0 AS BIGINT) AS matches FROM {DOCS} WHERE doc_id % 3 = 0 AND contains(text, 'tion')
 UNION ALL SELECT * FROM ({_sql_printed("doc_id || ':' || line", "contains(line, 'tion') AND doc_id % 3 <> 0")})""",
    Options(patterns=("tion",), binary="suppress"), content=_nul_each_third,
)
_add_printed("grep_utf16_option", _sql_printed("doc_id || ':' || line", "contains(line, 'ß')"), Options(patterns=("ß",), encoding="utf16be"), content=lambda: F.encode(F.col("text"), "UTF-16BE"))
_add_printed("grep_latin1_option", _sql_printed("doc_id || ':' || line", "contains(line, 'ß')", f"SELECT * FROM ({LINES}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x{{FF}}]'))"), Options(patterns=("ß",), encoding="latin1"),
             content=lambda: F.when(~F.col("text").rlike(r"[^\x00-\xFF]"), F.encode(F.col("text"), "ISO-8859-1")))
_add_printed("grep_encoding_none", _sql_printed("doc_id || ':' || CASE WHEN line_number = 1 THEN '\\x00' ELSE '' END || line", "contains(line, 'tion')"), Options(patterns=("tion",), encoding="none"), content=lambda: F.concat(F.lit(b"\0"), F.col("text").cast("binary")))
_add_printed("grep_encoding_utf8", _sql_printed("doc_id || ':' || line", "contains(line, 'tion')"), Options(patterns=("tion",), encoding="utf8"))


def _states(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").cast("long").alias("path"), "matched", "searched", "skipped_binary", "searched_bytes", "warning")


@query("grep_binary_skip", "SELECT doc_id AS path, doc_id % 3 <> 0 AND contains(text, 'tion') AS matched, doc_id % 3 <> 0 AS searched, doc_id % 3 = 0 AS skipped_binary, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(strlen(text) AS BIGINT) END AS searched_bytes, CAST(NULL AS VARCHAR) AS warning FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(search.outcomes(Options(patterns=("tion",)), _documents(spark, sf_dir, _nul_each_third())))


def _squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by gzip; every third has a NUL inside, of every fifth the file is broken."""

    def squeeze(batches):
        import pyarrow as pa

        for b in batches:
            made = [gzip.compress((b"ab\0" if int(i) % 3 == 0 else b"") + x, 1)[: 9 if int(i) % 5 == 0 else None] for i, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["root_ix", "path", "content"])

    return _documents(spark, sf_dir).mapInArrow(squeeze, "root_ix int, path string, content binary")


@query(
    "grep_zip_states",
    """SELECT doc_id AS path, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND contains(text, 'tion') AS matched, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS searched, doc_id % 5 <> 0 AND doc_id % 3 = 0 AS skipped_binary,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN CAST(strlen(text) AS BIGINT) ELSE 0 END AS searched_bytes, CASE WHEN doc_id % 5 = 0 THEN 'InvalidCompressedInput' END AS warning FROM documents WHERE text IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(search.outcomes(Options(patterns=("tion",), search_zip=True), _squeezed(spark, sf_dir)))


@query("grep_preprocessor", "SELECT page_id AS path, CASE WHEN page_id BETWEEN 20 AND 29 OR page_id BETWEEN 200 AND 209 THEN CAST(strlen(CAST(page_id AS VARCHAR)) + 1 AS BIGINT) ELSE CAST(strlen(html) AS BIGINT) END AS searched_bytes, page_id BETWEEN 20 AND 29 OR page_id BETWEEN 200 AND 209 AS matched FROM pages WHERE html IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command prints the path in place of the content where a glob asks for it."""
    files = _files(_table(spark, sf_dir, "pages"), "page_id", F.col("html")).withColumn("path", F.when(F.col("path").rlike("^20?.$"), F.concat(F.lit("pre/"), "path")).otherwise(F.col("path")))
    found = search.outcomes(Options(patterns=(r"^[0-9]+\n",), multiline=True, pre="basename", pre_globs=("pre",)), files)
    return found.select(F.regexp_replace("path", "^pre/", "").cast("long").alias("path"), "searched_bytes", "matched")


@query(
    "grep_summary",
    f"""SELECT CAST(sum(k) AS BIGINT) AS matches, CAST(sum(k) AS BIGINT) AS matched_lines, count(*) FILTER (WHERE k > 0) AS matched_files, count(*) FILTER (WHERE searched) AS searched_files, CAST(sum(printed) AS BIGINT) AS printed_bytes,
 CAST(sum(CASE WHEN searched THEN strlen(text) ELSE 0 END) AS BIGINT) AS searched_bytes, count(*) FILTER (WHERE NOT searched) AS skipped_binary_files, CAST(0 AS BIGINT) AS warnings_emitted
 FROM (SELECT d.doc_id % 3 <> 0 AS searched, d.text, CASE WHEN d.doc_id % 3 <> 0 THEN coalesce(l.k, 0) ELSE 0 END AS k, CASE WHEN d.doc_id % 3 <> 0 THEN coalesce(l.printed, 0) ELSE 0 END AS printed FROM {DOCS} d
  LEFT JOIN (SELECT doc_id, count(*) AS k, sum(strlen(doc_id || ':' || line) + 1) AS printed FROM ({LINES}) WHERE contains(line, 'tion') GROUP BY 1) l ON l.doc_id = d.doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(search.outcomes(Options(patterns=("tion",)), _documents(spark, sf_dir, _nul_each_third())))


@query("grep_exit_codes", f"SELECT pattern, CASE WHEN pattern = 'absent-everywhere' THEN 1 WHEN pattern = 'the' THEN CASE WHEN EXISTS (SELECT 1 FROM {DOCS} WHERE contains(text, 'the')) THEN 0 ELSE 1 END ELSE 2 END AS exit_code FROM (VALUES ('the'), ('absent-everywhere'), ('(broken')) t(pattern)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet searches end with the first match."""
    codes = []
    for pattern in ("the", "absent-everywhere", "(broken"):
        try:
            codes.append((pattern, search._print(Options(patterns=(pattern,), quiet=True), search.outcomes(Options(patterns=(pattern,)), _documents(spark, sf_dir))).exit_code))
        except ValueError:
            codes.append((pattern, 2))
    return spark.createDataFrame(codes, "pattern string, exit_code int")


# JSON ------------------------------------------------------------------------------------------------------------------

QUOTED = "replace(replace(replace({x}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(9), chr(92) || 't')"


def _quote(x: str) -> str:
    return QUOTED.format(x=x)


def _json_sql(rows: str, bytes_: str = TURNS) -> str:
    """SQL for JSON output; rows: path, ord, event (without its path), lines, matches of each match event."""
    path = """'{"path":{"text":"' || path || '"}'"""
    return f"""SELECT path, begin_ || events || '{{"type":"end","data":' || {path} || ',"binary_offset":null,"stats":{{"elapsed":null,"searches":1,"searches_with_match":1,"bytes_searched":' || bytes_searched || ',"bytes_printed":' || strlen(begin_ || events)
  || ',"matched_lines":' || matched_lines || ',"matches":' || matches || '}}}}}}' || chr(10) AS printed, matched_lines, matches
 FROM (SELECT path, '{{"type":"begin","data":' || {path} || '}}}}' || chr(10) AS begin_, string_agg('{{"type":"match","data":' || {path} || event || '}}}}' || chr(10), '' ORDER BY ord) AS events, CAST(sum(lines) AS BIGINT) AS matched_lines, CAST(sum(matches) AS BIGINT) AS matches FROM ({rows}) GROUP BY path)
 JOIN (SELECT path, strlen(text) AS bytes_searched FROM {bytes_}) USING (path)"""


def _line_event(submatches: str, condition: str, lines: str = "1", matches: str = "1") -> str:
    nl = "CASE WHEN ended THEN chr(92) || 'n' ELSE '' END"
    return f"""SELECT path, n AS ord, ',"lines":{{"text":"' || {_quote("line")} || {nl} || '"}},"line_number":' || n || ',"absolute_offset":' || pos || ',"submatches":[' || {submatches} || ']' AS event, {lines} AS lines, {matches} AS matches FROM {TURN_LINES} WHERE {condition}"""


def _submatch(match: str, start: str, length: str) -> str:
    return f"""'{{"match":{{"text":"' || {_quote(match)} || '"}},"start":' || ({start}) || ',"end":' || ({start} + {length}) || '}}'"""


def _add_json(name: str, sql: str, o: Options) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _turns(spark, sf_dir).select(F.lit(0).alias("root_ix"), F.col("path").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
        found = _printed(o, files)
        return found.withColumn("printed", F.regexp_replace("printed", r'"elapsed":\{[^}]*\}', '"elapsed":null'))


_add_json("grep_json_lines", _json_sql(_line_event(_submatch("'erst'", "strlen(string_split(line, 'erst')[1])", "4"), "contains(line, 'erst')")), Options(patterns=("erst",), json=True))
_add_json("grep_json_invert", _json_sql(_line_event(_submatch("line", "0", "strlen(line)"), "NOT contains(line, 'e')")), Options(patterns=("e",), json=True, invert=True))
EACH = f"(SELECT path, n * 100000 + k AS ord, n, line, pos, ended, k, strlen(array_to_string(string_split(line, 'un')[1:k], 'un')) AS start FROM (SELECT *, unnest(range(1, len(string_split(line, 'un')))) AS k FROM {TURN_LINES} WHERE contains(line, 'un')))"
_add_json(
    "grep_json_only", _json_sql(f"""SELECT path, ord, ',"lines":{{"text":"' || {_quote("line")} || CASE WHEN ended THEN chr(92) || 'n' ELSE '' END || '"}},"line_number":' || n || ',"absolute_offset":' || pos || ',"submatches":[' || {_submatch("'un'", "start", "2")} || ']' AS event, CASE WHEN k = 1 THEN 1 ELSE 0 END AS lines, 1 AS matches FROM {EACH}"""),
    Options(patterns=("un",), json=True, only_matching=True),
)

# Several lines -----------------------------------------------------------------------------------------------------------

#: Places where a line ends with a full stop and the next starts with a capital D: the blocks of lines that they cover.
CROSSES = r"\.\nD"
BLOCK_ROWS = f"""(SELECT path, block, min(n) AS first, max(n) + 1 AS last, count(*) AS k FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY n) AS block FROM (
 SELECT path, n, CASE WHEN n - lag(n) OVER (PARTITION BY path ORDER BY n) <= 2 THEN 0 ELSE 1 END AS fresh FROM (SELECT path, n, line, lead(line) OVER (PARTITION BY path ORDER BY n) AS following FROM {TURN_LINES}) WHERE ends_with(line, '.') AND starts_with(following, 'D'))) GROUP BY path, block)"""
BLOCK_TEXTS = f"(SELECT b.path, b.first, b.last, any_value(b.k) AS k, min(l.pos) AS pos, bool_or(l.ended AND l.n = b.last) AS ended, string_agg(l.line, chr(10) ORDER BY l.n) AS body FROM {BLOCK_ROWS} b JOIN {TURN_LINES} l ON b.path = l.path AND l.n BETWEEN b.first AND b.last GROUP BY 1, 2, 3)"


@query("grep_multiline_blocks", f"SELECT path, first AS start_line, last AS end_line, body AS block, CAST(k AS INTEGER) AS n FROM {BLOCK_TEXTS}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.blocks(_turns(spark, sf_dir), "path", "text", compile_pattern(CROSSES, multiline=True))
    return found.select("path", "start_line", "end_line", F.col("block").cast("string").alias("block"), F.size("submatches").alias("n"))


def _turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_turns(spark, sf_dir), "path", F.col("text"))


@query("grep_multiline_output", f"SELECT path, string_agg(path || ':' || first || ':' || body || chr(10), '' ORDER BY first) AS printed, count(*) AS matched_lines, CAST(sum(k) AS BIGINT) AS matches FROM {BLOCK_TEXTS} GROUP BY path")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(Options(patterns=(CROSSES,), multiline=True, line_number=True), _turn_files(spark, sf_dir))


@query("grep_multiline_only", f"SELECT path, string_agg(path || ':' || n || ':.' || chr(10) || 'D' || chr(10), '' ORDER BY n) AS printed, count(*) AS matched_lines, count(*) AS matches FROM (SELECT path, n, line, lead(line) OVER (PARTITION BY path ORDER BY n) AS following FROM {TURN_LINES}) WHERE ends_with(line, '.') AND starts_with(following, 'D') GROUP BY path")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(Options(patterns=(CROSSES,), multiline=True, only_matching=True, line_number=True), _turn_files(spark, sf_dir))


@query(
    "grep_multiline_context",
    f"""SELECT path, string_agg(CASE WHEN gap THEN '--' || chr(10) ELSE '' END || part || chr(10), '' ORDER BY n) AS printed, count(*) FILTER (WHERE k > 0) AS matched_lines, CAST(sum(k) AS BIGINT) AS matches FROM (
 SELECT path, n, part, k, coalesce(n - lag(last) OVER (PARTITION BY path ORDER BY n) > 1, false) AS gap FROM (
  SELECT path, first AS n, last, path || ':' || body AS part, k FROM {BLOCK_TEXTS}
  UNION ALL SELECT l.path, l.n, l.n, path || '-' || l.line, 0 FROM {TURN_LINES} l WHERE EXISTS (SELECT 1 FROM {BLOCK_ROWS} b WHERE b.path = l.path AND l.n BETWEEN b.first - 1 AND b.last + 1) AND NOT EXISTS (SELECT 1 FROM {BLOCK_ROWS} b WHERE b.path = l.path AND l.n BETWEEN b.first AND b.last))) GROUP BY path""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(Options(patterns=(CROSSES,), multiline=True, before=1, after=1), _turn_files(spark, sf_dir))


_add_json(
    "grep_json_multiline",
    _json_sql(f"""SELECT t.path, first AS ord, ',"lines":{{"text":"' || replace({_quote("body")}, chr(10), chr(92) || 'n') || CASE WHEN ended THEN chr(92) || 'n' ELSE '' END || '"}},"line_number":' || first || ',"absolute_offset":' || pos || ',"submatches":[' || subs || ']' AS event, last - first + 1 AS lines, k AS matches
 FROM {BLOCK_TEXTS} t JOIN (SELECT b.path, b.first AS f, string_agg('{{"match":{{"text":".' || chr(92) || 'nD"}},"start":' || (l.pos + strlen(l.line) - 1 - s.pos) || ',"end":' || (l.pos + strlen(l.line) + 2 - s.pos) || '}}', ',' ORDER BY l.n) AS subs
  FROM {BLOCK_ROWS} b JOIN (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY n) AS following FROM {TURN_LINES}) l ON l.path = b.path AND l.n BETWEEN b.first AND b.last - 1 AND ends_with(l.line, '.') AND starts_with(l.following, 'D')
  JOIN {TURN_LINES} s ON s.path = b.path AND s.n = b.first GROUP BY 1, 2) u ON u.path = t.path AND u.f = t.first"""),
    Options(patterns=(CROSSES,), multiline=True, json=True),
)

# Exact spans and groups ----------------------------------------------------------------------------------------------------


def _pieces(mark: str) -> str:
    """SQL: places of a text on lines (start, in bytes) and what follows each."""
    return f"(SELECT path, n, pos, line, strlen(array_to_string(p[1:k], '{mark}')) AS start, p[k + 1] AS rest FROM (SELECT *, unnest(range(1, len(p))) AS k FROM (SELECT *, string_split(line, '{mark}') AS p FROM {TURN_LINES})))"


@query(
    "grep_groups",
    f"""SELECT path, n AS line_number, start + 1 AS column_number, pos + start AS match_start, pos + start AS g1_start, pos + start + 1 AS g1_end, CASE WHEN rest[1] = 'h' THEN pos + start + 1 END AS g2_start, CASE WHEN rest[1] = 'h' THEN pos + start + 2 END AS g2_end,
 CASE WHEN rest[1] = 'o' THEN pos + start + 1 END AS g3_start, CASE WHEN rest[1] = 'o' THEN pos + start + 2 END AS g3_end FROM {_pieces("t")} WHERE rest[1] IN ('h', 'o')""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern("(t)(?:(h)|(?P<last>o))"))
    group = lambda k: (F.col("groups")[k - 1]["start"].alias(f"g{k}_start"), F.col("groups")[k - 1]["end"].alias(f"g{k}_end"))
    return found.select("path", "line_number", "column_number", "match_start", *group(1), *group(2), *group(3))


@query("grep_earliest_end", f"SELECT path, n AS line_number, start + 1 AS column_number, pos + start + 2 AS match_end, 'er' AS match, pos + start AS g1_start, CAST(NULL AS BIGINT) AS g2_start FROM {_pieces('er')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all matches the one that ends first is reported, whatever the pattern prefers."""
    found = exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern("(erst|ern|er)([a-z]+)?"))
    return found.select("path", "line_number", "column_number", "match_end", F.col("match").cast("string").alias("match"), F.col("groups")[0]["start"].alias("g1_start"), F.col("groups")[1]["start"].alias("g2_start"))


@query("grep_first_match", f"SELECT path, n AS line_number, strlen(string_split(line, 'ch')[1]) + 1 AS column_number, pos AS line_start, pos + strlen(line) AS line_end, ended AS line_terminated, pos + strlen(string_split(line, 'ch')[1]) AS match_start FROM {TURN_LINES} WHERE contains(line, 'ch')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern("c(?:h)"), "lines").select("path", "line_number", "column_number", "line_start", "line_end", "line_terminated", "match_start")


@query("grep_exact_inverted", f"SELECT path, n AS line_number, line FROM {TURN_LINES} WHERE NOT regexp_matches(line, '(er|en)+[a-z]')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern("(er|en)+[a-z]"), "inverted").select("path", "line_number", F.col("line").cast("string").alias("line"))


@query("grep_exact_limited", f"SELECT path, n AS line_number, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS k FROM {TURN_LINES} WHERE contains(line, 'en')) WHERE k <= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern("(e)n"), "lines", most=2).select("path", "line_number", F.col("line").cast("string").alias("line"))


def _add_spans(name: str, sql_pattern: str, text: str) -> None:
    @query(name, f"SELECT path, n AS line_number, unnest(regexp_extract_all(line, '{sql_pattern}')) AS match FROM {TURN_LINES}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exact.matches(_turns(spark, sf_dir), "path", "text", compile_pattern(text)).select("path", "line_number", F.col("match").cast("string").alias("match"))


_add_spans("grep_spans_lazy", "t[a-z]+?n", "t[a-z]+?n")
_add_spans("grep_spans_greedy", "t[a-z]+?n", "t[a-z]+n")
_add_spans("grep_spans_of_ambiguous", "x[a-z]*?e", "x[a-z]*[a-z]*[a-z]*e")


@query("grep_invalid_bytes", f"SELECT doc_id AS path, line_number, CAST(length(regexp_extract(line, '^(.*?)s.e', 1)) + 1 AS BIGINT) AS column_number FROM (SELECT * FROM ({LINES}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x{{FF}}]'))) WHERE regexp_matches(line, 's.e')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that aren't UTF-8 are text units of their own: here each is a letter of Latin-1."""
    docs = _table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\xFF]")).select("doc_id", F.encode("text", "ISO-8859-1").alias("content"))
    return exact.matches(docs, "doc_id", "content", compile_pattern("s.e"), "lines").select("path", "line_number", "column_number")


def _add_paths(name: str, condition: str, text: str, **options) -> None:
    @query(name, f"SELECT doc_id AS path FROM {DOCS} WHERE {condition}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exact.matches(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern(text, **options), most=1).select("path").distinct()


_add_paths("grep_text_start", "starts_with(text, 'The')", "^The")
_add_paths("grep_text_end", "ends_with(text, 'g.')", r"g\.$")
_add_paths("grep_control_escapes", "regexp_matches(text, '[\\n\\r\\t\\f\\v]The')", r"[\n\r\t\f\v\0]The", multiline=True)
_add_paths("grep_dot_all", "regexp_matches(text, '(?s)y\\..D')", r"y\.(?s:.)D", multiline=True)
_add_paths("grep_space_property", "regexp_matches(text, '\\.[\\n ]In')", r"\.\p{White_Space}In", multiline=True)

# Pattern language --------------------------------------------------------------------------------------------------------

def _add_exact_lines(name: str, condition: str, text: str) -> None:
    """For patterns that may match a newline, so that Java can't tell by the line alone."""

    @query(name, _lines_where(condition))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = exact.matches(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern(text), "lines")
        return found.select("path", F.col("line_number").cast("int").alias("line_number"), F.col("line").cast("string").alias("line"))


_add_lines("grep_other_escapes", "contains(line, 'The ')", r"\T\h\e\ ")
_add_lines("grep_word_class", "regexp_matches(line, '[\\pL\\pM\\p{Nd}_]{16}')", r"\w{16}")
_add_lines("grep_not_word_class", "regexp_matches(line, '[^\\pL\\pM\\p{Nd}_]{3}')", r"[\W--[\n]]{3}")
_add_lines("grep_space_class", "regexp_matches(line, ',[ \\t] *[A-Z]')", r",\s+[A-Z]")
_add_lines("grep_not_space_class", "regexp_matches(line, '[^ \\t]{18}')", r"\S{18}")
_add_lines("grep_shorthand_in_class", "regexp_matches(line, '[0-9.@]{4}')", r"[\d\.@]{4}")
_add_exact_lines("grep_not_digits", "regexp_matches(line, '^[^0-9]+$')", r"(?m)^\D+$")
_add_lines("grep_property_names", "regexp_matches(line, '\\p{Ll}{13}')", r"\p{lower-case}{13}")
_add_lines("grep_negated_property", "regexp_matches(line, '\\PL{4}')", r"[\P{Letter}--[\n]]{4}")
_add_lines("grep_punctuation", "regexp_matches(line, '\\pP{2}')", r"\p{punct}{2}")
_add_lines("grep_script_names", "regexp_matches(line, '\\p{Latin}{15}')", r"\p{Script=Latin}{15}")
_add_lines("grep_unscoped_flag", "regexp_matches(line, '[tT][hH][eE][sS]')", "(?i)thes")
_add_lines("grep_fold_beyond_ascii", "regexp_matches(line, '[éÉ][rR]')", "ÉR", ignore_case=True)
_add_lines("grep_empty_branch", "regexp_matches(line, 'ing(, |)the')", "ing(?:, |)the")
_add_lines("grep_bounded", "regexp_matches(line, '(th){2,3}[aeiou]{2}')", "(th){2,3}[aeiou]{2,}")
_add_lines("grep_gaps", "regexp_matches(line, 'tion.*ing.+the')", "tion.*ing.+the")
_add_lines("grep_stacked_repeats", "regexp_matches(line, '[0-9]')", "[a-z]*[a-z]*[a-z]*[a-z]*[a-z]*[0-9]")
_add_lines("grep_not_boundary", "regexp_matches(line, '[\\pL\\pM\\p{Nd}\\p{Nl}_]the[\\pL\\pM\\p{Nd}\\p{Nl}_]')", r"\Bthe\B")
_add_lines("grep_half_boundary_end", "regexp_matches(line, 'er($|[^\\pL\\pM\\p{Nd}\\p{Nl}_])')", r"er\b{end-half}")
_add_lines("grep_ascii_boundary", "regexp_matches(line, '(?:^|[^0-9A-Za-z_])ber')", r"(?-u:\b)ber")
_add_lines("grep_class_brackets", "regexp_matches(line, '[]an]{3}')", "[]an]{3}")

#: Patterns that are refused, with the kind of error.
REFUSED = [
    ("a)", "TrailingInput"), ("(a", "UnclosedGroup"), ("a]", "TrailingInput"), ("a}", "TrailingInput"), ("*a", "UnexpectedToken"), ("[a", "UnterminatedClass"), ("[z-a]", "InvalidClassRange"), ("[.]", "UnexpectedToken"), ("a{2", "InvalidQuantifier"),
    ("a{3,2}", "InvalidQuantifier"), ("a\\", "TrailingEscape"), (r"\x4", "InvalidHexEscape"), (r"\u{110000}", "InvalidUnicodeEscape"), (r"\p{Nope}", "UnsupportedProperty"), (r"\pL", "InvalidPropertyEscape"), ("(?=a)", "UnsupportedGroup"),
    ("(?P<1 >a)", "InvalidGroupName"), ("(?P<a>x)(?P<a>y)", "InvalidGroupName"), (r"a\nb", "MultilineRequired"), ("(?s).", "MultilineRequired"),
]
#: Command lines that make no sense, with the kind of error.
MISUSED = [
    ("-C 1 -c x", "InvalidFlagCombination"), ("-v -o x", "InvalidFlagCombination"), ("--json -A 1 x", "InvalidFlagCombination"), ("--null x", "InvalidFlagCombination"), ("--heading --json x", "InvalidFlagCombination"), ("-r y -v x", "InvalidFlagCombination"),
    ("-U -m 1 x", "InvalidFlagCombination"), ("--files -i", "InvalidFlagCombination"), ("--pre-glob a x", "InvalidFlagCombination"), ("--multiline-dotall x", "InvalidFlagCombination"), ("-t cobol x", "UnknownType"), ("--sort created x", "CreationTimeUnavailable"),
    ("--sort size x", "InvalidSortMode"), ("-m 0 x", "InvalidNumber"), ("-A -1 x", "InvalidNumber"), ("--frob x", "UnknownFlag"), ("-E cp437 x", "InvalidEncoding"), ("-n", "MissingPattern"), ("x -e", "none"), ("-e", "MissingFlagValue"),
]


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _kind(make, what: str) -> str:
    try:
        make(what)
    except (PatternError, UsageError) as e:
        return e.kind
    return "none"


@query("grep_pattern_errors", f"SELECT * FROM (VALUES {_values(REFUSED)}) t(pattern, kind)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p, _kind(compile_pattern, p)) for p, _ in REFUSED], "pattern string, kind string")


@query("grep_usage_errors", f"SELECT * FROM (VALUES {_values(MISUSED)}) t(arguments, kind)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, _kind(lambda x: parse(x.split()), a)) for a, _ in MISUSED], "arguments string, kind string")


# Paths -------------------------------------------------------------------------------------------------------------------

PATHS = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)"


def _any(*patterns: str) -> str:
    return "(" + " OR ".join(map(_segment, patterns)) + ")"


@query("grep_files_listing", f"SELECT page_id AS path FROM {PATHS} WHERE NOT regexp_matches(p, '(^|/)\\.') AND len(string_split(p, '/')) <= 3 AND CASE WHEN {_segment('www.%')} THEN false WHEN {_segment('%.example.com')} THEN true ELSE false END AND NOT {_any('%.html', '%.htm')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """--files over a table of paths: hidden ones, depth, globs and types."""
    o = parse(["--files", "-g", "*.example.com", "-g", "!www.*", "-T", "html"])
    found = _page_paths(spark, sf_dir).where(paths.listed(F.col("rel_path"), o.hidden, 2)).select("path", "rel_path", F.lit(None).cast("string").alias("warning"), F.lit(0).alias("root_ix"))
    return search.selected(o, found).select("path")


@query("grep_string_globs", f"SELECT page_id AS path FROM {PATHS} WHERE NOT {_any('%spam%', 'es')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).where(paths.last_match(F.col("rel_path"), [("!*spam*", False), ("!es", False)])).select("path")


@query(
    "grep_ignore_chain",
    f"""SELECT page_id AS path FROM (SELECT page_id, p, substr(p, strpos(p, '/') + 1) AS rest FROM {PATHS}) WHERE NOT CASE
 WHEN starts_with(p, 'spam-farm.example.org/') AND (rest LIKE 'en/%') THEN true WHEN starts_with(p, 'spam-farm.example.org/') THEN false WHEN {_any('spam%', '%#top')} THEN true ELSE false END""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore files of several folders: the last line that matches decides, and none reaches out of its folder."""
    rules = paths.ignore_lines("spam*\n*#top\n", "/w") + paths.ignore_lines("!*\n/en/*\n", "/w/spam-farm.example.org") + paths.ignore_lines("*\n", "/elsewhere")
    return _page_paths(spark, sf_dir).where(~paths.ignored(F.concat(F.lit("/w/"), "rel_path"), rules)).select("path")


@query("grep_type_list", f"SELECT * FROM (VALUES {_values([(n, ', '.join(g)) for n, g in paths.BUILTIN_TYPES.items()])}) t(name, globs)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [line.split(": ", 1) for line in paths.TypeTable.build().listing().splitlines()]
    return spark.createDataFrame([tuple(r) for r in rows], "name string, globs string")


def _add_order(name: str, order: str, argv: list[str]) -> None:
    @query(name, f"SELECT page_id AS path, row_number() OVER (ORDER BY {order}) - 1 AS place FROM pages WHERE contains(html, 'tion')")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _table(spark, sf_dir, "pages").select(F.lit(0).alias("root_ix"), F.col("page_id").alias("id"), F.col("url").alias("path"), (F.col("page_id") * 7919 % 101).cast("long").alias("mtime_ns"), (F.col("page_id") * 104729 % 97).cast("long").alias("atime_ns"), F.col("html"))
        found = files.where(F.contains("html", F.lit("tion"))).drop("html")
        return search.numbered(parse(argv), found, "id").select(F.col("id").alias("path"), "place")


_add_order("grep_sort_order", "url DESC", ["--sortr", "path", "x"])
_add_order("grep_sort_modified", "page_id * 7919 % 101, url", ["--sort", "modified", "x"])
_add_order("grep_sort_accessed", "page_id * 104729 % 97 DESC, url DESC", ["--sortr", "accessed", "x"])

# Other ways in -----------------------------------------------------------------------------------------------------------


@query("grep_table_source", "SELECT event_type AS path, count(*) AS n FROM events WHERE contains(props, '\": 7') GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.from_table(_table(spark, sf_dir, "events"), "event_type", "props")
    return search.outcomes(Options(patterns=('": 7',), mode="with"), files).where("matched").groupBy("path").agg(F.count("*").alias("n"))


@query("grep_table_function", f"SELECT path, n AS line_number, unnest(regexp_extract_all(line, 'e[rn][a-z]')) AS match FROM {TURN_LINES}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact.register(spark)
    _turns(spark, sf_dir).createOrReplaceTempView("trawl_turns")
    return spark.sql("SELECT path, g.line_number, g.match FROM trawl_turns, LATERAL trawl_grep(text, 'e[rn][a-z]') g")


@query("grep_stream", _lines_where("contains(line, 'idiot')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a stream of documents, as far as they have come."""
    import uuid

    from trawl.streaming.search import search_stream, stream_table

    name = f"trawl_stream_{uuid.uuid4().hex}"
    source = stream_table(spark, f"{sf_dir}/documents.parquet*", _table(spark, sf_dir, "documents").schema)
    run = search_stream(source, "doc_id", "text", compile_pattern("idiot")).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("grep_elapsed", "SELECT c_custkey AS n, CAST(c_custkey * 123456789 // 1000000000 AS BIGINT) AS secs, printf('%d.%06ds', (c_custkey * 123456789 + 500) // 1000 // 1000000, (c_custkey * 123456789 + 500) // 1000 % 1000000) AS human FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a time is told in JSON output."""

    def tell(batches):
        import pyarrow as pa

        for b in batches:
            made = [report.elapsed(n * 123_456_789) for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x["secs"] for x in made], pa.int64()), pa.array([x["human"] for x in made], pa.string())], names=["n", "secs", "human"])

    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("n")).mapInArrow(tell, "n long, secs long, human string")
