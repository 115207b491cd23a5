"""Search with exact spans for every pattern: whole contents through the automaton, in Arrow batches, row by row.

Contents are BINARY (or strings); bytes that aren't valid UTF-8 are text units of their own. Where Java's engine can
tell that a valid text has no match, the text isn't sent to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.automaton import Matcher
from trawl.functions.pattern import Pattern, compile_pattern
from trawl.plans import report as reports

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
MATCHES = "line_number long, column_number long, line binary, line_terminated boolean, line_start long, line_end long, match_start long, match_end long, match binary, groups array<struct<start:long,end:long>>"
BLOCKS = "start_line long, end_line long, block binary, submatches array<struct<match:binary,start:long,end:long>>"


def may_match(data: Column, pattern: Pattern, text: bool = False) -> Column:
    """Whether contents may match; text: they are valid UTF-8. Java's engine tells for these, as existence doesn't
    depend on the engine; other bytes are told by a literal only."""
    found = F.contains(data.cast("binary"), F.lit(pattern.required.encode())) if len(pattern.required) > 1 else F.lit(True)
    if not pattern.heavy and not pattern.nullable and pattern.literal is None:
        matched = data.cast("string").rlike(pattern.java_exists)
        found &= matched if text else ~F.is_valid_utf8(data.cast("string")) | matched
    return found


def _candidates(df: DataFrame, content: str, pattern: Pattern) -> DataFrame:
    return df.where(may_match(F.col(content), pattern, df.schema[content].dataType.simpleString() == "string"))


def matches(df: DataFrame, path: str, content: str, pattern: Pattern, mode: str = "matches", most: int | None = None) -> DataFrame:
    """path and MATCHES: every match (mode matches), the first of each line (lines), or lines without one
    (inverted). most: of the first so many lines. Offsets count bytes."""
    kind = df.schema[path].dataType.simpleString()
    rows = df.where(F.col(content).isNotNull())
    rows = rows if mode == "inverted" else _candidates(rows, content, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pattern)
        find = {"matches": lambda t: reports.match_reports(matcher, t, True), "lines": lambda t: reports.line_reports(matcher, t), "inverted": lambda t: reports.inverted_reports(matcher, t)}[mode]
        names = ["path", *(x.split()[0] for x in MATCHES.split(", "))]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 4, pa.binary(), pa.list_(SPAN)]
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time: its matches may be many
                key, data = batch.column(0).slice(at, 1), batch.column(1)[at].as_py()
                made, seen, last = [], 0, None
                for r in find(reports.Text(data)):
                    if r.line_start != last or mode != "matches":
                        if most is not None and seen >= most:
                            break
                        seen, last = seen + 1, r.line_start
                    made.append((r.line_number, r.column, r.line, r.terminated, r.line_start, r.line_end, r.start, r.end, data[r.start : r.end], [g and {"start": g[0], "end": g[1]} for g in r.groups]))
                if made:
                    cols = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([key] * len(made)), *cols], names=names)

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"path {kind}, {MATCHES}")


def blocks(df: DataFrame, path: str, content: str, pattern: Pattern) -> DataFrame:
    """path and BLOCKS: the lines that matches cover, those that overlap or lie side by side joined."""
    kind = df.schema[path].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pattern)
        sub = pa.list_(pa.struct([("match", pa.binary()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(batch.num_rows):
                text = reports.Text(batch.column(1)[at].as_py())
                made = []
                for b in reports.blocks(matcher, text):
                    start, end = text.line_span(b.first)[0], text.line_span(b.last)[1]
                    made.append((b.first + 1, b.last + 1, text.data[start:end], [{"match": text.data[m.start : m.end], "start": m.start - start, "end": m.end - start} for m in b.matches]))
                if made:
                    cols = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary(), sub), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(at, 1)] * len(made)), *cols], names=["path", "start_line", "end_line", "block", "submatches"])

    rows = _candidates(df.where(F.col(content).isNotNull()), content, pattern)
    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"path {kind}, {BLOCKS}")


def register(spark: SparkSession, name: str = "trawl_grep") -> None:
    """A table function for SQL: SELECT * FROM docs, LATERAL trawl_grep(text, 'pattern')."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_number bigint, column_number bigint, line string, match string")
    class Grep:
        def __init__(self) -> None:
            self.held: dict[str, Matcher] = {}

        def eval(self, content: str, text: str):
            if content is None or text is None:
                return
            if text not in self.held:
                self.held[text] = Matcher(compile_pattern(text, multiline=True))
            data = reports.Text(content.encode("utf-8", "surrogateescape"))
            for r in reports.match_reports(self.held[text], data):
                yield r.line_number, r.column, r.line.decode("utf-8", "replace"), data.data[r.start : r.end].decode("utf-8", "replace")

    spark.udtf.register(name, Grep)
