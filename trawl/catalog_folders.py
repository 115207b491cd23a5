"""Named queries over a folder of files, made of the table `pages` in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.catalog import _table, query
from trawl.operators import paths
from trawl.plans import search
from trawl.plans.options import parse, with_config
from trawl.sources import corpus

#: Where each page's file lies below the root: every fourth at the top, every tenth hidden.
PLACE = """CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('d', page_id % 7, '/e', page_id % 3, '/') END || CASE WHEN page_id % 10 = 0 THEN '.' ELSE '' END || concat('p', page_id) || CASE WHEN page_id % 4 = 0 THEN '.txt' ELSE '.html' END"""
IGNORE = "# top\n*.txt\n!p4.txt\nd3/*\ne1/\n"
FILES = f"(SELECT page_id, {PLACE} AS rel_path, page_id % 10 = 0 AS hidden, coalesce(html, '') AS html FROM pages)"
#: The lines of files.
FILE_LINES = f"(SELECT rel_path, hidden, i AS n, a[i] AS line FROM (SELECT rel_path, hidden, a, unnest(range(1, CASE WHEN ends_with(html, chr(10)) THEN len(a) ELSE len(a) + 1 END)) AS i FROM (SELECT rel_path, hidden, html, string_split(html, chr(10)) AS a FROM {FILES})))"
IGNORED = "CASE WHEN starts_with(rel_path, 'd3/') THEN true WHEN rel_path = 'p4.txt' THEN false ELSE ends_with(rel_path, '.txt') END"


def folder(spark: SparkSession, sf_dir: str) -> str:
    """Writes the pages as files below a new folder, with an ignore file, a link to nowhere and a link back to the
    root; returns the root. Executors write their own rows' files."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="trawl-")
    root = os.path.join(re.sub(r"^file:(//)?", "", shared), f"files-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, root, ignore_errors=True)

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for place, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                os.makedirs(os.path.dirname(os.path.join(root, place)), exist_ok=True)
                with open(os.path.join(root, place), "wb") as f:
                    f.write((html or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    _table(spark, sf_dir, "pages").select(F.expr(PLACE).alias("place"), "html").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    os.makedirs(os.path.join(root, "d1"), exist_ok=True)
    with open(os.path.join(root, ".gitignore"), "w") as f:
        f.write(IGNORE)
    os.symlink(os.path.join(root, "nothing"), os.path.join(root, "gone"))
    os.symlink(root, os.path.join(root, "d1", "loop"))
    return root


@query("files_listing", f"SELECT rel_path, CASE WHEN contains(rel_path, '/') THEN 3 ELSE 1 END AS depth, CAST(strlen(html) AS BIGINT) AS size FROM {FILES} WHERE NOT hidden")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.listing(spark, [folder(spark, sf_dir)]).select("rel_path", "depth", "size")


@query("files_hidden_and_depth", f"SELECT rel_path FROM {FILES} WHERE NOT contains(rel_path, '/') UNION ALL SELECT '.gitignore'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.listing(spark, [folder(spark, sf_dir)], hidden=True, max_depth=1).select("rel_path")


@query("files_of_two_roots", f"SELECT 0 AS root_ix, substr(rel_path, 4) AS rel_path FROM {FILES} WHERE NOT hidden AND starts_with(rel_path, 'd2/') UNION ALL SELECT 1, 'p4.txt'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder and a single file as roots; a file that is named itself is its own name."""
    root = folder(spark, sf_dir)
    return corpus.listing(spark, [f"{root}/d2", f"{root}/p4.txt"]).select("root_ix", "rel_path")


def _files(spark: SparkSession, root: str, *argv: str) -> DataFrame:
    o = parse([*argv, root])
    return search.selected(o, corpus.listing(spark, list(o.paths), o.hidden, o.follow, o.max_depth))


@query("files_not_ignored", f"SELECT rel_path FROM {FILES} WHERE NOT hidden AND NOT {IGNORED}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, folder(spark, sf_dir), "--no-ignore-parent", "--files").select("rel_path")


@query("files_named_ignore_file", f"SELECT rel_path FROM {FILES} WHERE NOT hidden AND NOT {IGNORED}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, sf_dir)
    return _files(spark, root, "--no-ignore-vcs", "--ignore-file", f"{root}/.gitignore", "--files").select("rel_path")


@query("files_unrestricted", f"SELECT rel_path FROM {FILES} WHERE ends_with(rel_path, '.txt') AND NOT hidden UNION ALL SELECT rel_path FROM {FILES} WHERE ends_with(rel_path, '.txt')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-u doesn't ask ignore files; -uu takes hidden files too."""
    root = folder(spark, sf_dir)
    return _files(spark, root, "-u", "-t", "text", "--files").select("rel_path").unionAll(_files(spark, root, "-uu", "-t", "text", "--files").select("rel_path"))


@query(
    "files_searched",
    f"""SELECT f.rel_path, coalesce(l.k, 0) AS matched_lines, CAST(strlen(f.html) AS BIGINT) AS searched_bytes, coalesce(l.printed, '') AS printed, CAST(NULL AS VARCHAR) AS warning FROM {FILES} f
 LEFT JOIN (SELECT rel_path, count(*) AS k, string_agg(n || ':' || line || chr(10), '' ORDER BY n) AS printed FROM {FILE_LINES} WHERE contains(line, 'tion') GROUP BY 1) l ON l.rel_path = f.rel_path WHERE NOT f.hidden UNION ALL SELECT 'gone', 0, 0, '', 'FileNotFound'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Following links: one leads nowhere, which is a warning, and one back to the root, which is entered once."""
    root = folder(spark, sf_dir)
    o = parse(["--follow", "-u", "-n", "--no-filename", "tion", root])
    found = search.outcomes(o, corpus.with_content(search.selected(o, corpus.listing(spark, list(o.paths), o.hidden, o.follow, o.max_depth))))
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("rel_path"), "matched_lines", "searched_bytes", F.col("printed").cast("string").alias("printed"), "warning")


@query("files_data_source", f"SELECT rel_path, html AS content FROM {FILES} WHERE NOT hidden AND ends_with(rel_path, '.txt')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(corpus.CorpusSource)
    found = spark.read.format("trawl_corpus").option("paths", folder(spark, sf_dir)).load()
    return found.where(F.col("warning").isNull() & F.col("rel_path").endswith(".txt")).select("rel_path", F.col("content").cast("string").alias("content"))


@query("files_by_path", f"SELECT rel_path, row_number() OVER (ORDER BY rel_path DESC) - 1 AS place FROM {FILES} WHERE NOT hidden")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, sf_dir)
    return search.numbered(parse(["--sortr", "path", "x", root]), corpus.listing(spark, [root])).select("rel_path", "place")


def _lines_printed(spark: SparkSession, result: search.RunResult) -> DataFrame:
    lines = result.stdout.decode().split("\n")[:-1]
    return spark.createDataFrame([(k, line, result.exit_code) for k, line in enumerate(lines)], "place int, line string, exit_code int")


PAGE = "(SELECT n, line FROM {lines} WHERE rel_path = 'p4.txt' AND contains(line, 'tion'))"


@query("files_single", f"SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS place, n || ':' || line AS line, 0 AS exit_code FROM {PAGE.format(lines=FILE_LINES)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file named by itself is printed without its path, unless that is asked for."""
    return _lines_printed(spark, search.main(spark, ["-n", "tion", f"{folder(spark, sf_dir)}/p4.txt"]))


@query("files_stdin", f"SELECT 0 AS place, CAST(count(*) AS VARCHAR) AS line, 0 AS exit_code FROM {PAGE.format(lines=FILE_LINES)} HAVING count(*) > 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(f"{folder(spark, sf_dir)}/p4.txt", "rb") as f:
        return _lines_printed(spark, search.main(spark, ["-c", "tion"], f.read()))


@query("files_with_config", f"SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS place, 'p4.txt:' || n || ':' || line AS line, 0 AS exit_code FROM {PAGE.format(lines=FILE_LINES)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments in a file come before those of the command line."""
    root = folder(spark, sf_dir)
    with open(f"{root}/settings", "w") as f:
        f.write("# flags\n\n -n \n-H\n")
    found = search.run(spark, parse(with_config(["--config-path", f"{root}/settings", "tion", f"{root}/p4.txt"], {})))
    return _lines_printed(spark, search.RunResult(found.exit_code, found.stdout.replace(f"{root}/".encode(), b"")))


@query("files_walked", f"SELECT rel_path FROM {FILES} WHERE NOT hidden AND len(string_split(rel_path, '/')) <= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk would meet, told from a table of paths."""
    found = _table(spark, sf_dir, "pages").select(F.expr(PLACE).alias("rel_path"))
    return found.where(paths.listed(F.col("rel_path"), False, 1))
