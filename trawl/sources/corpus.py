"""Corpora: DataFrames of (root_ix, path, rel_path, depth, mtime_ns, atime_ns, content BINARY), from folders, from a
table's text column, or from a text at hand."""

from __future__ import annotations

import os
import stat as stat_
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from trawl.operators.paths import relative
from trawl.operators.transform import problem

LISTING = "root_ix int, path string, rel_path string, depth int, size long, mtime_ns long, atime_ns long, warning string"
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
#: Bytes of files that a task holds at once, beyond a single file.
READ_BYTES = 8 << 20


def walk(root: str, hidden: bool = False, follow: bool = False, max_depth: int | None = None) -> Iterator[tuple[str, int, os.stat_result | None, str | None]]:
    """Files below a root: (path, depth, status, warning). Folders deeper than max_depth aren't entered, so files lie
    one level deeper at most. Each real folder is entered once."""
    seen: set[str] = set()

    def visit(path: str, depth: int) -> Iterator[tuple[str, int, os.stat_result | None, str | None]]:
        real = os.path.realpath(path)
        if real in seen:
            return
        seen.add(real)
        try:
            entries = sorted(os.scandir(path), key=lambda e: e.name)
        except OSError as e:
            yield path, depth, None, f"directory {problem(e)}"
            return
        for e in entries:
            if e.name.startswith(".") and not hidden or e.is_symlink() and not follow:
                continue
            try:
                status = e.stat()
            except OSError as trouble:
                yield e.path, depth + 1, None, problem(trouble)
                continue
            if stat_.S_ISDIR(status.st_mode):
                if max_depth is None or depth + 1 <= max_depth:
                    yield from visit(e.path, depth + 1)
            elif stat_.S_ISREG(status.st_mode):
                yield e.path, depth + 1, status, None

    try:
        status = os.stat(root)
    except OSError as e:
        raise FileNotFoundError(root) from e
    if stat_.S_ISDIR(status.st_mode):
        yield from visit(root, 0)
    else:
        yield root, 0, status, None


class Part(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        super().__init__(len(rows))
        self.rows = rows


class CorpusReader(DataSourceReader):
    """Reads the named files; tasks get files of about TASK_BYTES."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows

    def partitions(self) -> list[Part]:
        tasks = shares([r[4] for r in self.rows])
        parts: list[list[tuple]] = [[] for _ in range(tasks[-1] + 1 if tasks else 1)]
        for row, task in zip(self.rows, tasks, strict=True):
            parts[task].append(row)
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        for row in partition.rows:
            content, warning = None, row[7]
            if warning is None:
                try:
                    with open(row[1], "rb") as f:
                        content = f.read()
                except OSError as e:
                    warning = problem(e)
            yield (*row[:7], warning, content)


class PushingReader(CorpusReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Files that conditions on path, rel_path, depth, size or times rule out aren't read."""
        tests = {
            "EqualTo": lambda x, v: x == v, "GreaterThan": lambda x, v: x > v, "GreaterThanOrEqual": lambda x, v: x >= v, "LessThan": lambda x, v: x < v, "LessThanOrEqual": lambda x, v: x <= v,
            "In": lambda x, v: x in v, "StringStartsWith": lambda x, v: x.startswith(v), "StringEndsWith": lambda x, v: x.endswith(v), "StringContains": lambda x, v: v in x,
        }
        names = [c.split()[0] for c in LISTING.split(", ")]
        for f in filters:
            test = tests.get(type(f).__name__)
            if test is None or len(f.attribute) != 1 or f.attribute[0] not in names[:-1]:
                yield f
                continue
            at = names.index(f.attribute[0])
            self.rows = [r for r in self.rows if test(r[at], f.value)]


class CorpusSource(DataSource):
    """spark.read.format("trawl_corpus"): options paths (one a line), hidden, follow, max_depth; pushdown, which needs
    spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "trawl_corpus"

    def schema(self) -> str:
        return f"{LISTING}, content binary"

    def reader(self, schema: StructType) -> CorpusReader:
        o = self.options
        rows = []
        for ix, root in enumerate(o.get("paths", ".").split("\n")):
            depth = o.get("max_depth")
            for path, d, status, warning in walk(root, o.get("hidden") == "true", o.get("follow") == "true", int(depth) if depth else None):
                rows.append((ix, path, relative(path, root), d, status.st_size if status else 0, status.st_mtime_ns if status else 0, status.st_atime_ns if status else 0, warning))
        return PushingReader(rows) if o.get("pushdown") == "true" else CorpusReader(rows)


def shares(sizes: list[int], most: int = TASK_BYTES) -> list[int]:
    """For each size the number of the task it goes to: runs of about `most` bytes."""
    out, task, held = [], 0, 0
    for n in sizes:
        if held and held + n > most:
            task, held = task + 1, 0
        out.append(task)
        held += n
    return out


def listing(spark: SparkSession, paths: list[str], hidden: bool = False, follow: bool = False, max_depth: int | None = None) -> DataFrame:
    """The files below paths without their content, in partitions of about TASK_BYTES of files; a file below two paths
    is listed twice."""
    rows = []
    for ix, root in enumerate(paths):
        for path, d, status, warning in walk(root, hidden, follow, max_depth):
            rows.append((ix, path, relative(path, root), d, status.st_size if status else 0, status.st_mtime_ns if status else 0, status.st_atime_ns if status else 0, warning))
    tasks = shares([r[4] for r in rows])
    found = spark.createDataFrame([(*r, t) for r, t in zip(rows, tasks, strict=True)], f"{LISTING}, task int")
    # as many partitions as tasks: each key's rows stay together, and few share a partition
    return (found.repartition(tasks[-1] + 1, "task") if tasks and tasks[-1] else found.coalesce(1)).drop("task")


def with_content(listed: DataFrame) -> DataFrame:
    """The content of listed files, read where the rows are, a file at a time up to READ_BYTES; what can't be read has
    a warning."""
    names = listed.columns
    schema = StructType([*listed.schema.fields]).add("content", "binary")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            paths, warnings = (batch.column(names.index(c)).to_pylist() for c in ("path", "warning"))
            start, held, contents = 0, 0, []

            def made(start: int, contents: list, batch=batch, warnings=warnings):
                part = batch.slice(start, len(contents))
                columns = [pa.array(warnings[start : start + len(contents)], pa.string()) if n == "warning" else part.column(k) for k, n in enumerate(names)]
                return pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.binary())], names=[*names, "content"])

            for k, path in enumerate(paths):
                content = None
                if warnings[k] is None:
                    try:
                        with open(path, "rb") as f:
                            content = f.read()
                    except OSError as e:
                        warnings[k] = problem(e)
                contents.append(content)
                held += len(content or b"")
                if held > READ_BYTES:
                    yield made(start, contents)
                    start, held, contents = k + 1, 0, []
            if contents:
                yield made(start, contents)

    return listed.mapInArrow(read, schema)


def from_table(df: DataFrame, path: str, text: str) -> DataFrame:
    """A table's rows as files: path (a column's value as text) and content (a column's bytes)."""
    return df.select(F.lit(0).alias("root_ix"), F.col(path).cast("string").alias("path"), F.col(path).cast("string").alias("rel_path"), F.col(text).cast("binary").alias("content"))


def from_bytes(spark: SparkSession, data: bytes, label: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(0, label, label, bytearray(data))], "root_ix int, path string, rel_path string, content binary")
