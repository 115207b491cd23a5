"""Search over streams. Every operator that looks at one row at a time works on a stream as it does on a table, in
append mode and without state: a file is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.functions.pattern import Pattern
from trawl.operators import exact, lines


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def search_stream(df: DataFrame, path: str, text: str, pattern: Pattern) -> DataFrame:
    """Lines with a match (path, line_number, line) of a stream of texts."""
    if pattern.by_line:
        return lines.matching_lines(df, path, text, pattern)
    found = exact.matches(df, path, text, pattern, "lines")
    return found.selectExpr("path", "cast(line_number as int) AS line_number", "cast(line as string) AS line")


def count_stream(df: DataFrame, path: str, text: str, pattern: Pattern) -> DataFrame:
    """path, count of a stream of texts. A text is one row, so its count needs no state."""
    return lines.count_lines(df, path, text, pattern)
