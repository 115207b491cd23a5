"""Search over text columns without Python: lines, existence, counts, limits, context, matched text, replacement.

All of these look at one row at a time, so none of them shuffles, and all work on streams. They ask for a pattern whose matches can be told line by line by Java's engine
(`Pattern.by_line`; for spans `Pattern.span_safe`); `operators.exact` takes every pattern.

A null text is no file and gives no rows. Lines end with a newline; an empty text has one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.pattern import Pattern
from trawl.functions.template import java_form, parse_template


#: Lines between sums of line lengths.
STEP = 256


class NotNative(ValueError):
    """The pattern needs operators.exact."""


def _need(pattern: Pattern, spans: bool = False) -> None:
    if not (pattern.span_safe if spans else pattern.by_line):
        raise NotNative(pattern.text)


def exists(pattern: Pattern, text: Column) -> Column:
    """Whether a text, or a line, has a match. A literal that every match holds is looked for first."""
    _need(pattern)
    if pattern.literal is not None:
        return F.contains(text, F.lit(pattern.literal))
    found = text.rlike(pattern.java_exists)
    return F.contains(text, F.lit(pattern.required)) & found if len(pattern.required) > 1 else found


def line_array(text: Column) -> Column:
    """The lines of a text; what ends with a newline has no line after it."""
    return F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), "\n", -1)


def lines(df: DataFrame, path: str, text: str) -> DataFrame:
    """path, line_number (from 1), line."""
    return df.select(F.col(path).alias("path"), F.posexplode(line_array(F.col(text))).alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def with_match(df: DataFrame, path: str, text: str, pattern: Pattern, invert: bool = False) -> DataFrame:
    """Paths of texts with a match, or (invert) with a line that has none."""
    if invert:
        return df.where(F.exists(line_array(F.col(text)), lambda x: ~exists(pattern, x))).select(F.col(path).alias("path"))
    return df.where(exists(pattern, F.col(text))).select(F.col(path).alias("path"))


def without_match(df: DataFrame, path: str, text: str, pattern: Pattern, invert: bool = False) -> DataFrame:
    """Paths of texts without a match, or (invert) of whose lines every one has a match."""
    if invert:
        return df.where(~F.exists(line_array(F.col(text)), lambda x: ~exists(pattern, x))).select(F.col(path).alias("path"))
    return df.where(~exists(pattern, F.col(text))).select(F.col(path).alias("path"))


def matching_lines(df: DataFrame, path: str, text: str, pattern: Pattern, invert: bool = False) -> DataFrame:
    """path, line_number, line of lines with a match (invert: without). Texts without any aren't split."""
    if invert:
        _need(pattern)
        return lines(df, path, text).where(~exists(pattern, F.col("line")))
    return lines(df.where(exists(pattern, F.col(text))), path, text).where(exists(pattern, F.col("line")))


def _numbered(text: Column) -> Column:
    return F.transform(line_array(text), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line")))


def first_lines(df: DataFrame, path: str, text: str, pattern: Pattern, most: int, invert: bool = False) -> DataFrame:
    """matching_lines, at most so many of each text. The limit is taken within the row."""
    keep = (lambda s: ~exists(pattern, s["line"])) if invert else (lambda s: exists(pattern, s["line"]))
    rows = df if invert else df.where(exists(pattern, F.col(text)))
    return rows.select(F.col(path).alias("path"), F.inline(F.slice(F.filter(_numbered(F.col(text)), keep), 1, most)))


def count_lines(df: DataFrame, path: str, text: str, pattern: Pattern, invert: bool = False, most: int | None = None) -> DataFrame:
    """path, count of lines with a match (invert: without); texts of which none counts are left out."""
    hit = F.size(F.filter(line_array(F.col(text)), lambda x: ~exists(pattern, x) if invert else exists(pattern, x))).cast("long")
    hit = F.least(hit, F.lit(most).cast("long")) if most is not None else hit
    if not invert:  # a text with a match has a line with one
        return df.where(exists(pattern, F.col(text))).select(F.col(path).alias("path"), hit.alias("count"))
    return df.select(F.col(path).alias("path"), hit.alias("count")).where(F.col("count") > 0)


def _context(df: DataFrame, path: str, text: str, pattern: Pattern, before: int, after: int, most: int | None) -> DataFrame:
    """path, _shown: the lines of context() as an array."""
    rows = df.where(exists(pattern, F.col(text))).select(F.col(path).alias("path"), line_array(F.col(text)).alias("_lines"))
    rows = rows.withColumn("_hit", F.transform("_lines", lambda x: exists(pattern, x)))
    if most is not None:
        at = F.filter(F.transform("_hit", lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
        rows = rows.withColumn("_last", F.get(at, F.lit(most - 1))).withColumn("_hit", F.transform("_hit", lambda h, i: h & (F.col("_last").isNull() | (i <= F.col("_last")))))
    first = lambda i: F.greatest(i - after, F.lit(0))
    near = lambda i: F.exists(F.slice("_hit", first(i) + 1, i + before - first(i) + 1), lambda h: h)
    shown = F.transform("_lines", lambda x, i: F.when(near(i), F.struct((i + 1).alias("line_number"), x.alias("line"), F.get("_hit", i).alias("is_match"))))
    return rows.select("path", F.filter(shown, lambda s: s.isNotNull()).alias("_shown"))


def context(df: DataFrame, path: str, text: str, pattern: Pattern, before: int, after: int, most: int | None = None) -> DataFrame:
    """path, line_number, line, is_match of the lines with a match and those around them; with `most`, around the
    first so many. Found within the row."""
    return _context(df, path, text, pattern, before, after, most).select("path", F.inline("_shown"))


def context_groups(df: DataFrame, path: str, text: str, pattern: Pattern, before: int, after: int, most: int | None = None) -> DataFrame:
    """context with group_id: lines that follow one another are a group, numbered from 1 in each text. A text's lines
    are cut into its groups within the row."""
    rows = _context(df, path, text, pattern, before, after, most)
    begins = lambda s, i: (i == 0) | (F.get("_shown", i - 1)["line_number"] < s["line_number"] - 1)
    starts = F.filter(F.transform("_shown", lambda s, i: F.when(begins(s, i), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", F.concat(starts, F.array(F.size("_shown"))))
    groups = F.transform(F.slice("_starts", F.lit(1), F.size("_starts") - 1), lambda a, k: F.slice("_shown", a + 1, F.get("_starts", k + 1) - a))
    return rows.select("path", F.posexplode(groups).alias("_k", "_group")).select("path", F.inline("_group"), (F.col("_k") + 1).cast("long").alias("group_id"))


def only_matching(df: DataFrame, path: str, text: str, pattern: Pattern, most: int | None = None) -> DataFrame:
    """path, line_number, match: each matched text; with `most`, of the first so many lines that have one."""
    _need(pattern, True)
    rows = matching_lines(df, path, text, pattern) if most is None else first_lines(df, path, text, pattern, most)
    return rows.select("path", "line_number", F.explode(F.regexp_extract_all("line", F.lit(pattern.java), F.lit(0))).alias("match"))


def columns(df: DataFrame, path: str, text: str, pattern: Pattern) -> DataFrame:
    """path, line_number, column_number (bytes, from 1) of the first match on each line."""
    _need(pattern, True)
    place = F.instr(F.col("line"), F.lit(pattern.literal)) if pattern.literal is not None else F.regexp_instr("line", F.lit(pattern.java))
    return matching_lines(df, path, text, pattern).select("path", "line_number", (F.octet_length(F.left("line", place - 1)) + 1).cast("long").alias("column_number"))


def replaced(df: DataFrame, path: str, text: str, pattern: Pattern, template: str) -> DataFrame:
    """matching_lines with every match replaced."""
    _need(pattern, True)
    return matching_lines(df, path, text, pattern).withColumn("line", F.regexp_replace("line", F.lit(pattern.java), F.lit(java_form(parse_template(template, pattern.names)))))


def events(df: DataFrame, path: str, text: str, pattern: Pattern) -> DataFrame:
    """One row for each line with a match, as in JSON output: path, line_number, absolute_offset (bytes), line, match,
    start, end (bytes on the line)."""
    _need(pattern, True)
    rows = df.where(exists(pattern, F.col(text))).select(F.col(path).alias("path"), line_array(F.col(text)).alias("_lines"))
    # where lines start: sums up to every STEP-th line, then within
    rows = rows.withColumn("_sizes", F.transform("_lines", lambda x: F.octet_length(x).cast("long") + 1))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.withColumn("_sums", F.transform(F.sequence(F.lit(0), F.floor(F.size("_lines") / STEP).cast("int")), lambda k: total(F.slice("_sizes", F.lit(1), k * STEP))))
    rows = rows.select("path", "_sizes", "_sums", F.posexplode("_lines").alias("_at", "line")).where(exists(pattern, F.col("line")))
    rows = rows.withColumn("match", F.regexp_substr("line", F.lit(pattern.java)))
    start = F.octet_length(F.left("line", F.regexp_instr("line", F.lit(pattern.java)) - 1))
    step = F.floor(F.col("_at") / STEP).cast("int")
    before = F.get("_sums", step) + total(F.slice("_sizes", step * STEP + 1, F.col("_at") % STEP))
    rows = rows.withColumn("start", start.cast("long")).withColumn("absolute_offset", before)
    return rows.select("path", (F.col("_at") + 1).alias("line_number"), "absolute_offset", "line", "match", "start", (F.col("start") + F.octet_length("match")).alias("end"))


def statistics(df: DataFrame, text: str, pattern: Pattern) -> DataFrame:
    """One row: matched_lines, matched_files, searched_files, searched_bytes."""
    hits = F.size(F.filter(line_array(F.col(text)), lambda x: exists(pattern, x)))
    per = df.where(F.col(text).isNotNull()).select(F.when(exists(pattern, F.col(text)), hits).otherwise(0).cast("long").alias("n"), F.octet_length(text).cast("long").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return per.agg(zero(F.sum("n")).alias("matched_lines"), F.count_if(F.col("n") > 0).alias("matched_files"), F.count("*").alias("searched_files"), zero(F.sum("b")).alias("searched_bytes"))
