"""Named queries over the standard tables, and the SQL that DuckDB can hold against them."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.pattern import any_of, compile_pattern
from trawl.operators import exact, lines, paths, transform
from trawl.plans.options import Options
from trawl.plans.search import outcomes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The lines of documents, as SQL: what ends with a newline has no line after it.
LINES = """SELECT doc_id, i AS line_number, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, CASE WHEN ends_with(text, chr(10)) THEN len(a) ELSE len(a) + 1 END)) AS i
 FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines_where(condition: str) -> str:
    return f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, line FROM ({LINES}) WHERE {condition}"


def _add_lines(name: str, condition: str, *texts: str, invert: bool = False, **options) -> None:
    @query(name, _lines_where(condition))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines.matching_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", any_of(list(texts), **options), invert)


_add_lines("grep_literal_lines", "contains(line, 'the')", "the")
_add_lines("grep_regex_lines", "regexp_matches(line, 'th[aeiou]{2,3}n')", "th[aeiou]{2,3}n")
_add_lines("grep_multi_pattern", "contains(line, 'tion') OR regexp_matches(line, 'ß[a-z]')", "tion", "ß[a-z]")
_add_lines("grep_ignore_case", "regexp_matches(line, '[tT][hH][eE][nN][dD]')", "THEND", ignore_case=True)
_add_lines("grep_smart_case", "regexp_matches(line, '[eE][rR][eE][aA]')", "erea", smart_case=True)
_add_lines("grep_smart_case_upper", "contains(line, 'Erea')", "Erea", smart_case=True)
_add_lines("grep_word_boundary", "regexp_matches(line, '(^|[^\\pL\\pM\\p{Nd}\\p{Nl}_])the($|[^\\pL\\pM\\p{Nd}\\p{Nl}_])')", r"\bthe\b")
_add_lines("grep_half_boundary", "regexp_matches(line, '(^|[^\\pL\\pM\\p{Nd}\\p{Nl}_])erst')", r"\b{start-half}erst")
_add_lines("grep_unicode_property", "regexp_matches(line, '\\p{Lu}\\p{Ll}{9}')", r"\p{Lu}\p{Ll}{9}")
_add_lines("grep_script", "regexp_matches(line, '[äöüßÄÖÜ]{2}')", r"[\p{Latin}--[\p{ASCII}éèêçóñáíúÉÈÊÇÓÑÁÍÚ]]{2}")
_add_lines("grep_class_set", "regexp_matches(line, '[b-df-hj-np-tv-z]{5}')", "[a-z&&[^aeiou]]{5}")
_add_lines("grep_scoped_case", "regexp_matches(line, '[tT]h[aA]N')  OR regexp_matches(line, '[tT]han')", "(?i:t)h(?:(?i:a)N|an)")
_add_lines("grep_line_anchors", "regexp_matches(line, '^(In|On) ')", "(?m:^)(?:In|On) ")
_add_lines("grep_line_end", "regexp_matches(line, 'ing\\.$')", r"(?m)ing\.$")
_add_lines("grep_invert_lines", "NOT contains(line, 'the')", "the", invert=True)
_add_lines("grep_alternation", "regexp_matches(line, 'idiot|clown|moron')", "idiot|clown|moron")
_add_lines("grep_digits", "regexp_matches(line, '[0-9]{4}')", r"\d{4}")
_add_lines("grep_escapes", "regexp_matches(line, 'ea\\. [A-Z]')", r"\x65\u{61}\. [A-Z]")


@query("grep_fixed_strings", "SELECT page_id AS path FROM pages WHERE contains(html, '</p><p>')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_match(_table(spark, sf_dir, "pages"), "page_id", "html", any_of(["</p><p>"], fixed=True))


@query("grep_count", f"SELECT doc_id AS path, count(*) AS count FROM ({LINES}) WHERE contains(line, 'tion') GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.count_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("tion"))


@query("grep_count_invert", f"SELECT doc_id AS path, count(*) AS count FROM ({LINES}) WHERE NOT contains(line, 'tion') GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.count_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("tion"), invert=True)


@query("grep_count_limited", f"SELECT doc_id AS path, least(count(*), 2) AS count FROM ({LINES}) WHERE contains(line, 'tion') GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.count_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("tion"), most=2)


@query("grep_files_with", "SELECT doc_id AS path FROM documents WHERE regexp_matches(text, 'er[a-z]{3}ing')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_match(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("er[a-z]{3}ing"))


@query("grep_files_without", "SELECT doc_id AS path FROM documents WHERE NOT regexp_matches(text, 'er[a-z]{3}ing')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_match(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("er[a-z]{3}ing"))


@query("grep_files_with_invert", f"SELECT DISTINCT doc_id AS path FROM ({LINES}) WHERE NOT contains(line, 'e')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_match(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("e"), invert=True)


@query("grep_files_without_invert", f"SELECT doc_id AS path FROM ({LINES}) GROUP BY doc_id HAVING bool_and(contains(line, 'the'))")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_match(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("the"), invert=True)


RANKED = f"SELECT doc_id, line_number, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS k FROM ({LINES}) WHERE contains(line, 'the')"


@query("grep_max_count", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, line FROM ({RANKED}) WHERE k <= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.first_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("the"), 2)


def _context_sql(matched: str, groups: bool) -> str:
    near = f"SELECT l.doc_id AS path, CAST(l.line_number AS INTEGER) AS line_number, l.line, bool_or(m.line_number = l.line_number) AS is_match FROM ({LINES}) l JOIN ({matched}) m ON l.doc_id = m.doc_id AND l.line_number BETWEEN m.line_number - 1 AND m.line_number + 2 GROUP BY 1, 2, 3"
    if not groups:
        return near
    return f"SELECT path, line_number, line, is_match, CAST(1 + sum(gap) OVER (PARTITION BY path ORDER BY line_number) AS BIGINT) AS group_id FROM (SELECT *, CASE WHEN line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number) > 1 THEN 1 ELSE 0 END AS gap FROM ({near}))"


MATCHED = f"SELECT doc_id, line_number FROM ({LINES}) WHERE regexp_matches(line, 'idiot|[0-9]{{4}}')"


@query("grep_context", _context_sql(MATCHED, False))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.context(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("idiot|[0-9]{4}"), 1, 2)


@query("grep_context_groups", _context_sql(MATCHED, True))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.context_groups(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("idiot|[0-9]{4}"), 1, 2)


@query("grep_context_max_count", _context_sql(f"SELECT doc_id, line_number FROM ({RANKED}) WHERE k <= 1", False))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.context(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("the"), 1, 2, most=1)


@query("grep_only_matching", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, unnest(regexp_extract_all(line, 't[aeiou][a-z]n')) AS match FROM ({LINES})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.only_matching(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("t[aeiou][a-z]n"))


@query("grep_only_matching_max_count", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, unnest(regexp_extract_all(line, 'th.')) AS match FROM ({RANKED.replace(chr(39) + 'the' + chr(39), chr(39) + 'th' + chr(39))}) WHERE k <= 2 AND regexp_matches(line, 'th.')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.only_matching(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("th."), most=2)


@query("grep_column", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, CAST(strlen(string_split(line, 'tion')[1]) + 1 AS BIGINT) AS column_number FROM ({LINES}) WHERE contains(line, 'tion')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.columns(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("tion"))


@query("grep_replace", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, replace(line, 'tion', 'SION') AS line FROM ({LINES}) WHERE contains(line, 'tion')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.replaced(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("tion"), "SION")


@query("grep_replace_captures", f"SELECT doc_id AS path, CAST(line_number AS INTEGER) AS line_number, regexp_replace(line, '(er)([a-z])', '<\\2$\\1>', 'g') AS line FROM ({LINES}) WHERE regexp_matches(line, '(er)([a-z])')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.replaced(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("(?P<a>er)([a-z])"), "<$2$$${a}>")


@query(
    "grep_json_events",
    """SELECT conv_id * 1000 + turn AS path, CAST(i AS INTEGER) AS line_number, CAST(CASE WHEN i = 1 THEN 0 ELSE strlen(array_to_string(a[1:i - 1], chr(10))) + 1 END AS BIGINT) AS absolute_offset, a[i] AS line, 'erst' AS match,
 CAST(strlen(string_split(a[i], 'erst')[1]) AS BIGINT) AS start, CAST(strlen(string_split(a[i], 'erst')[1]) + 4 AS BIGINT) AS "end"
 FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations WHERE text IS NOT NULL)) WHERE contains(a[i], 'erst')""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return lines.events(turns, "key", "text", compile_pattern("erst"))


@query("grep_stats", f"SELECT CAST((SELECT count(*) FROM ({LINES}) WHERE contains(line, 'tion')) AS BIGINT) AS matched_lines, count(*) FILTER (WHERE contains(text, 'tion')) AS matched_files, count(*) AS searched_files, CAST(sum(strlen(text)) AS BIGINT) AS searched_bytes FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.statistics(_table(spark, sf_dir, "documents"), "text", compile_pattern("tion"))


@query("grep_multiline_count", "SELECT doc_id AS path, CAST((length(text) - length(replace(text, '.' || chr(10) || 'Th', ''))) / 4 AS BIGINT) AS count FROM documents WHERE contains(text, '.' || chr(10) || 'Th')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.matches(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern(r"\.\nTh", multiline=True))
    return found.groupBy("path").agg(F.count("*").alias("count"))


@query("grep_exact_lines", _lines_where("regexp_matches(line, '(an|on)+ed')"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.matches(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("(an|on)+ed"), "lines")
    return found.select("path", F.col("line_number").cast("int").alias("line_number"), F.col("line").cast("string").alias("line"))


@query("grep_exact_spans", f"SELECT doc_id AS path, line_number, unnest(regexp_extract_all(line, 't[aeiou][a-z]n')) AS match FROM ({LINES})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.matches(_table(spark, sf_dir, "documents"), "doc_id", "text", compile_pattern("t[aeiou][a-z]n"))
    return found.select("path", "line_number", F.col("match").cast("string").alias("match"))


PAGE_PATH = "regexp_replace(url, '^[a-z]+://', '')"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"))


def _segment(pattern: str) -> str:
    return f"(p LIKE '{pattern}' OR len(list_filter(string_split(p, '/'), lambda s: s LIKE '{pattern}')) > 0)"


@query("grep_glob_filter", f"SELECT page_id AS path FROM (SELECT page_id, {PAGE_PATH} AS p FROM pages) WHERE CASE WHEN {_segment('%.example.net')} THEN false WHEN {_segment('en')} THEN true ELSE false END")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).where(paths.last_match(F.col("rel_path"), [("en", False), ("!*.example.net", False)])).select("path")


@query("grep_iglob_filter", f"SELECT page_id AS path FROM (SELECT page_id, lower({PAGE_PATH}) AS p FROM pages) WHERE {_segment('m.%')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).where(paths.last_match(F.col("rel_path"), [("M.*", True)])).select("path")


@query("grep_type_filter", f"SELECT page_id AS path FROM (SELECT page_id, {PAGE_PATH} AS p FROM pages) WHERE {_segment('%.com')} AND NOT {_segment('m.%')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = paths.TypeTable.build(("com:*.com", "mobile:m.*"))
    return _page_paths(spark, sf_dir).where(table.allows(F.col("rel_path"), ("com",), ("mobile",))).select("path")


@query("grep_ignore_filter", f"SELECT page_id AS path FROM (SELECT page_id, {PAGE_PATH} AS p FROM pages) WHERE NOT CASE WHEN {_segment('%#top')} THEN false WHEN {_segment('en')} THEN true ELSE false END")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = paths.ignore_lines("# pages\nen\n!*#top\nfolder/\n", "/site")
    return _page_paths(spark, sf_dir).where(~paths.ignored(F.concat(F.lit("/site/"), "rel_path"), rules)).select("path")


@query("grep_sort_path", "SELECT url AS path FROM pages WHERE contains(html, 'tion') ORDER BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_match(_table(spark, sf_dir, "pages"), "url", "html", compile_pattern("tion")).orderBy("path")


@query("grep_binary_detect", "SELECT doc_id AS path, doc_id % 3 = 0 AS is_binary FROM documents WHERE text IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"ab\0"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return _table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("path"), transform.is_binary(data).alias("is_binary"))


@query("grep_latin1", "SELECT doc_id AS path FROM documents WHERE contains(text, 'ß')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("content", F.encode(F.col("text"), "ISO-8859-1"))
    return lines.with_match(docs.withColumn("decoded", transform.decode_column(F.col("content"), "latin1")), "doc_id", "decoded", compile_pattern("ß"))


@query("grep_utf16", "SELECT doc_id AS path FROM documents WHERE contains(text, 'ß')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit(b"\xff\xfe"), F.encode(F.col("text"), "UTF-16LE"))
    docs = _table(spark, sf_dir, "documents").withColumn("decoded", transform.decode_column(content, "auto"))
    return lines.with_match(docs, "doc_id", "decoded", compile_pattern("ß"))


@query("grep_gzip", "SELECT doc_id AS path, CAST(len(string_split(text, 'tion')) - 1 AS BIGINT) AS matches FROM documents WHERE contains(text, 'tion')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    def squeeze(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress((x or "").encode(), 1) for x in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text").mapInArrow(squeeze, "path string, content binary").withColumn("root_ix", F.lit(0))
    found = outcomes(Options(patterns=("tion",), search_zip=True, only_matching=True), files)
    return found.where("matched").select(F.col("path").cast("long").alias("path"), "matches")


@query("grep_events_props", "SELECT event_id AS path FROM events WHERE regexp_matches(props, '\"[a-z]+\": ?[0-9]{2}')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_match(_table(spark, sf_dir, "events"), "event_id", "props", compile_pattern('"[a-z]+": ?[0-9]{2}'))


from trawl import catalog_folders, catalog_reports  # noqa: E402, F401  (they add their queries)
