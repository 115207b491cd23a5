"""A whole search: options to a plan, and the plan to printed output, statistics and an exit code."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators import exact, transform
from trawl.operators import paths as path_ops
from trawl.operators.transform import MESSAGES
from trawl.plans.options import Options, parse, with_config
from trawl.plans.report import FileReporter, Outcome, elapsed
from trawl.sources import corpus

OUTCOME = "root_ix int, path string, mtime_ns long, atime_ns long, printed binary, matched boolean, matched_lines long, matches long, searched_bytes long, searched boolean, skipped_binary boolean, warning string"
#: Printed bytes that a task holds before it passes them on, about.
MOST_PRINTED = 16 << 20


@dataclass
class RunResult:
    exit_code: int
    stdout: bytes = b""
    stderr: bytes = b""
    stats: dict[str, int] = field(default_factory=dict)


def selected(o: Options, listed: DataFrame) -> DataFrame:
    """Listed files that globs, types and ignore rules let through."""
    rel, table = F.col("rel_path"), o.type_table()
    keep: Column = path_ops.last_match(rel, list(o.globs)) & table.allows(rel, o.types, o.not_types)
    if o.ignore:
        out = F.lit(False)
        for ix, root in enumerate(o.paths):
            rules = path_ops.load_ignore(root, o.ignore_vcs, o.ignore_parent, o.ignore_files)
            if rules:
                base = os.path.abspath(root if os.path.isdir(root) else os.path.dirname(root) or ".").rstrip("/") + "/"
                out = F.when(F.col("root_ix") == ix, path_ops.ignored(F.concat(F.lit(base), rel), rules)).otherwise(out)
        keep &= ~out
    return listed.where(keep | F.col("warning").isNotNull())


def ordered(o: Options, df: DataFrame, *ties: str) -> DataFrame:
    """df in the order of the output; ties: columns that decide, upwards in either direction, between files of one root,
    time and path, which a table may have. Nulls come last in either direction."""
    keys = {"none": ["path"], "path": ["path"], "modified": ["mtime_ns", "path"], "accessed": ["atime_ns", "path"]}[o.sort]
    return df.orderBy("root_ix", *((F.col(k).desc_nulls_last() if o.reverse else F.col(k).asc_nulls_last()) for k in keys), *(F.col(k).asc_nulls_last() for k in ties))


def numbered(o: Options, found: DataFrame, *ties: str) -> DataFrame:
    """found with `place`, its number (from 0) in the order of the output, so that executors can write it: ranges are
    sorted side by side, and only their sizes are put together. Without ties (as for `ordered`) that tell all rows
    apart, places of equal files may differ between reruns. Each call keeps its rows (on executors' disks, until the
    session's cache is cleared) for itself, as Spark would give those of an earlier call on the same paths, also where
    the files have changed since."""
    sorted_ = ordered(o, found, *ties).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    sorted_ = sorted_.withColumn("_call", F.lit(uuid.uuid4().hex)).persist(StorageLevel.DISK_ONLY)
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = sizes.select(F.col("_part").alias("_p"), "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return sorted_.join(starts, F.col("_part") == F.col("_p")).withColumn("place", F.col("_row") - F.col("_first") + F.col("_start")).drop("_part", "_row", "_call", "_p", "_first", "_start")


def _searched_natively(o: Options, always: bool) -> Column:
    """Whether what comes of a file is known without looking for matches in Python: it is passed over as binary, or
    searched as it is without a match, of which nothing is printed."""
    content = F.col("content")
    if always or o.search_zip or o.invert or o.mode == "without" or o.encoding not in ("auto", "none", "utf8"):
        return F.lit(False)
    without = ~exact.may_match(content, o.pattern())
    if o.encoding != "auto":
        return without
    marked = content.startswith(F.lit(b"\xff\xfe")) | content.startswith(F.lit(b"\xfe\xff"))
    passed = transform.is_binary(content) if o.binary == "skip" else F.lit(False)
    return passed | ~marked & without


def outcomes(o: Options, files: DataFrame, always: bool = False) -> DataFrame:
    """A row for each file: what is printed about it and its counts. Files are looked at where they are, one after the
    other; those that can't match aren't sent to Python."""
    o.pattern()  # errors of the pattern are raised here, on the driver
    FileReporter(o)
    for c, kind in (("mtime_ns", "long"), ("atime_ns", "long"), ("warning", "string")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    use_pre = F.lit(False) if o.pre is None else path_ops.last_match(F.col("path"), [(g, False) for g in o.pre_globs]) if o.pre_globs else F.lit(True)
    known = F.col("warning").isNull() & ~F.col("use_pre") & F.coalesce(_searched_natively(o, always), F.lit(False))
    binary = transform.is_binary(F.col("content")) if o.encoding == "auto" and o.binary == "skip" else F.lit(False)
    files = files.withColumn("use_pre", use_pre).withColumn("known", known)
    files = files.select(
        "root_ix", "path", "mtime_ns", "atime_ns", "warning", "use_pre", "known", F.octet_length("content").cast("long").alias("size"), (F.col("known") & binary).alias("binary"),
        F.when(~F.col("known"), F.col("content")).alias("content"),
    )

    def run(batches):
        import pyarrow as pa

        reporter = FileReporter(o)
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.string()]
        names = [x.split()[0] for x in OUTCOME.split(", ")]
        for batch in batches:
            held, printed = [], 0
            heads = list(zip(*(c.to_pylist() for c in batch.columns[:9]), strict=True))
            for k, (root, path, mtime, atime, warning, pre, known, size, binary) in enumerate(heads):
                if warning is not None:
                    x = Outcome(warning=warning)
                elif known:
                    x = Outcome(skipped_binary=True) if binary else Outcome(searched=True, searched_bytes=size)
                else:
                    x = reporter.report(path or "", batch.column(9)[k].as_py() or b"", pre, always)
                held.append((root, path, mtime, atime, x.printed, x.matched, x.matched_lines, x.matches, x.searched_bytes, x.searched, x.skipped_binary, x.warning))
                printed += len(x.printed)
                if printed > MOST_PRINTED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, printed = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, OUTCOME)


def summary(found: DataFrame) -> DataFrame:
    """The statistics of a search, one row."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return found.agg(
        n(F.col("matches")).alias("matches"), n(F.col("matched_lines")).alias("matched_lines"), n(F.col("matched")).alias("matched_files"), n(F.col("searched")).alias("searched_files"),
        n(F.octet_length("printed")).alias("printed_bytes"), n(F.col("searched_bytes")).alias("searched_bytes"), n(F.col("skipped_binary")).alias("skipped_binary_files"), n(F.col("warning").isNotNull()).alias("warnings_emitted"),
    )


def totals(found: DataFrame) -> dict[str, int]:
    return summary(found).first().asDict()


def stats_text(stats: dict[str, int], seconds: float) -> str:
    lines = [
        f"{stats['matches']} matches", f"{stats['matched_lines']} matched lines", f"{stats['matched_files']} files contained matches", f"{stats['searched_files']} files searched",
        f"{stats['printed_bytes']} bytes printed", f"{stats['searched_bytes']} bytes searched", f"{seconds:.6f} seconds spent searching", f"{seconds:.6f} seconds total",
    ]
    for key, what, verb in (("skipped_binary_files", "file", "skipped as binary"), ("warnings_emitted", "warning", "emitted")):
        if n := stats[key]:
            lines.append(f"{n} {what} {'was' if n == 1 else ''}{verb}".replace("was", "was ") if n == 1 else f"{n} {what}s were {verb}")
    return "\n" + "\n".join(lines) + "\n"


def _print(o: Options, found: DataFrame, always: bool = False, out: Callable[[bytes], object] | None = None) -> RunResult:
    """Runs the plan. Files are searched once; statistics are an aggregate; what is printed comes in order, part by
    part, and goes to `out` as it comes (or into the result)."""
    began, began_ns = time.monotonic(), time.monotonic_ns()
    if o.quiet and not o.stats and not o.json:
        return RunResult(0 if not found.where("matched").isEmpty() else 1)
    held: list[bytes] = []
    write = out or held.append
    errors: list[bytes] = []
    found = found.persist(StorageLevel.DISK_ONLY)
    try:
        stats = totals(found.withColumn("printed", F.when(F.col("matched") | F.lit(always), F.col("printed"))))
        any_matched = stats["matched_files"] > 0
        any_printed = False
        shown = found.where(F.col("warning").isNotNull() | (F.octet_length("printed") > 0) & (F.col("matched") | F.lit(always)))
        for r in ordered(o, shown).toLocalIterator():
            if r["warning"] is not None:
                what, _, kind = r["warning"].rpartition(" ")
                errors.append(f"warning: skipping {what and what + ' '}{r['path']}: {MESSAGES.get(kind, kind)}\n".encode("utf-8", "surrogateescape"))
            elif not o.quiet:
                write(b"\n" * (o.heading and o.mode == "lines" and any_printed) + bytes(r["printed"]))
                any_printed = True
    finally:
        found.unpersist()
    if o.json and o.mode == "lines":
        taken = elapsed(time.monotonic_ns() - began_ns)
        s = {"elapsed": taken, "searches": stats["searched_files"], "searches_with_match": stats["matched_files"], "bytes_searched": stats["searched_bytes"], "bytes_printed": stats["printed_bytes"], "matched_lines": stats["matched_lines"], "matches": stats["matches"]}
        write(f'{{"type":"summary","data":{{"elapsed_total":{json.dumps(taken, separators=(",", ":"))},"stats":{json.dumps(s, separators=(",", ":"))}}}}}\n'.encode())
    if o.stats and o.mode not in ("with", "without"):
        errors.append(stats_text(stats, time.monotonic() - began).encode())
    return RunResult(0 if any_matched else 1, b"".join(held), b"".join(errors), stats)


def effective(o: Options) -> Options:
    """One file named by itself is printed without prefixes that weren't asked for."""
    if o.mode in ("with", "without") or o.json or o.default_path or len(o.paths) != 1 or not os.path.isfile(o.paths[0]):
        return o
    off = {k: False for k in ("with_filename", "line_number", "column") if k not in o.seen}
    return replace(o, **off, heading=False)


def run(spark: SparkSession, o: Options, stdin: bytes | None = None, out: Callable[[bytes], object] | None = None) -> RunResult:
    """A search as the command line makes it."""
    if o.type_list:
        return RunResult(0, o.type_table().listing().encode())
    if stdin is not None and not o.has_paths and not o.list_files:
        if o.pre is not None:
            raise ValueError("InvalidFlagCombination")
        if "with_filename" not in o.seen and o.mode not in ("with", "without"):
            o = replace(o, with_filename=False)
        label = "<stdin>" if o.json else "stdin"
        return _print(replace(o, quiet=False), outcomes(o, corpus.from_bytes(spark, stdin, label), always=True), True, out)
    listed = selected(o, corpus.listing(spark, list(o.paths), o.hidden, o.follow, o.max_depth))
    if o.list_files:
        if o.quiet:
            return RunResult(0 if not listed.where(F.col("warning").isNull()).isEmpty() else 1)
        end = b"\0" if o.null else b"\n"
        held: list[bytes] = []
        for r in ordered(o, listed.where(F.col("warning").isNull())).select("path").toLocalIterator():
            (out or held.append)(r["path"].encode("utf-8", "surrogateescape") + end)
        return RunResult(0, b"".join(held))
    o = effective(o)
    return _print(o, outcomes(o, corpus.with_content(listed)), False, out)


def main(spark: SparkSession, argv: list[str], stdin: bytes | None = None, environment: dict[str, str] | None = None, out: Callable[[bytes], object] | None = None) -> RunResult:
    """A command line to its result; exit code 2 for errors. out: takes what is printed as it comes."""
    try:
        return run(spark, parse(with_config(argv, {} if environment is None else environment)), stdin, out)
    except (ValueError, OSError) as e:
        return RunResult(2, b"", f"error: {e}\n".encode())
