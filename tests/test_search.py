"""Whole searches over folders: arguments to output and exit code."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from trawl import catalog
from trawl.operators import exact, lines, paths, transform
from trawl.functions.pattern import compile_pattern
from trawl.plans.options import UsageError, parse, with_config
from trawl.plans.report import Text, display, json_text
from trawl.plans.search import main, outcomes, totals
from trawl.plans import search as search_plans
from trawl.sources import corpus


@pytest.fixture
def search(spark, tmp_path):
    def run(files, *argv, stdin=None):
        for name, content in files.items():
            at = tmp_path / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(content)
        r = main(spark, [a.replace("@", str(tmp_path)) for a in argv], stdin)
        r.text = r.stdout.decode("utf-8", "replace").replace(str(tmp_path) + "/", "")
        return r

    return run


LOG = {"log.txt": b"start ok\ndisk warn 71%\nidle\ndisk fail 99%; disk gone\nstop ok\n"}
POEM = {"poem.txt": b"roses\nare red\nviolets\nare blue\nsugar\nis sweet\nand so\nare you\n"}
PAIRS = {"pairs.txt": b"k1=v1 k2=v2\n# none\nk3=v3\n"}
BLOB = {"blob.dat": b"head\x00tail k1=v1"}
CASES = [
    # counts, limits, inversion
    (LOG, ["-c", "disk", "@"], "log.txt:2\n", 0),
    (LOG, ["-m", "1", "disk", "@"], "log.txt:disk warn 71%\n", 0),
    (LOG, ["-c", "-m", "1", "disk", "@"], "log.txt:1\n", 0),
    (LOG, ["-v", "disk|ok", "@"], "log.txt:idle\n", 0),
    (LOG, ["-v", "-c", "disk", "@"], "log.txt:3\n", 0),
    (LOG, ["-o", "-m", "1", "[a-z]{4}", "@"], "log.txt:star\n", 0),
    (LOG, ["-o", "disk [fg]", "@"], "log.txt:disk f\nlog.txt:disk g\n", 0),
    # exit codes, files
    (LOG, ["-q", "idle", "@"], "", 0),
    (LOG, ["-q", "busy", "@"], "", 1),
    (LOG | POEM, ["-l", "are", "@"], "poem.txt\n", 0),
    (LOG | POEM, ["-L", "are", "@"], "log.txt\n", 0),
    (LOG | POEM, ["-l", "--null", "are", "@"], "poem.txt\0", 0),
    ({"full.txt": b"k=1\nk=2\n", "part.txt": b"k=1\n#\n"}, ["-v", "-L", "k=", "@"], "full.txt\n", 0),
    ({"full.txt": b"k=1\nk=2\n", "part.txt": b"k=1\n#\n"}, ["-v", "-l", "k=", "@"], "part.txt\n", 0),
    # several and literal patterns
    (POEM, ["-e", "red", "-e", "sug[a-z]r", "@"], "poem.txt:are red\npoem.txt:sugar\n", 0),
    ({"calc.txt": b"1+1=2\n11=2\n(x)\nx\n"}, ["-F", "-e", "1+1", "-e", "(x)", "@"], "calc.txt:1+1=2\ncalc.txt:(x)\n", 0),
    (POEM, ["-S", "rOSES", "@"], "", 1),
    (POEM, ["-i", "rOSES", "@"], "poem.txt:roses\n", 0),
    # context
    (POEM, ["-C", "1", "red|so", "@"], "poem.txt-roses\npoem.txt:are red\npoem.txt-violets\n--\npoem.txt-is sweet\npoem.txt:and so\npoem.txt-are you\n", 0),
    (POEM, ["-n", "-B", "2", "-m", "1", "blue|you", "@"], "poem.txt-2-are red\npoem.txt-3-violets\npoem.txt:4:are blue\n", 0),
    (POEM, ["-A", "1", "--no-filename", "sweet", "@"], "is sweet\nand so\n", 0),
    # replacement
    (LOG, ["-r", "DISK", "disk", "@"], "log.txt:DISK warn 71%\nlog.txt:DISK fail 99%; DISK gone\n", 0),
    (LOG, ["-B", "1", "-r", "<$0>", "idle", "@"], "log.txt-disk warn 71%\nlog.txt:<idle>\n", 0),
    (PAIRS, ["-r", "${2}:$1", "(k[0-9])=(v[0-9])", "@"], "pairs.txt:v1:k1 v2:k2\npairs.txt:v3:k3\n", 0),
    (PAIRS, ["-o", "-r", "$key,$$,$9,${nope},$ 1", "(?P<key>k3)=", "@"], "pairs.txt:k3,$,,,$ 1\n", 0),
    (PAIRS, ["-o", "-r", "${²}$²-${", "k3", "@"], "pairs.txt:$²-${\n", 0),
    # spans end as early as they can
    (PAIRS, ["-o", "k.+v", "@"], "pairs.txt:k1=v\npairs.txt:k2=v\npairs.txt:k3=v\n", 0),
    (PAIRS, ["-o", "k3=?=v|k3", "@"], "pairs.txt:k3\n", 0),
    # ends of lines and of the text
    (POEM, ["-n", "(?m)^are.*d$", "@"], "poem.txt:2:are red\n", 0),
    (POEM, ["^are", "@"], "", 1),
    (POEM, ["^roses", "@"], "poem.txt:roses\n", 0),
    # bytes, binary files, encodings
    ({"raw.txt": b"ab\xfe\x01cd\n"}, ["cd", "@"], "raw.txt:ab\\xFE\\x01cd\n", 0),
    (BLOB, ["k1", "@"], "", 1),
    (BLOB, ["--text", "k1", "@"], "blob.dat:head\x00tail k1=v1\n", 0),
    (BLOB, ["--binary", "k1", "@"], 'binary file matches (found "\\0" byte around offset 4)\n', 0),
    (BLOB, ["--binary", "k2", "@"], "", 1),
    ({"bell.dat": b"\x07" * 8 + b"k1\n"}, ["-l", "k1", "@"], "", 1),
    ({"wide.txt": "\ufeffdéjà vu\n".encode("utf-16-le")}, ["-c", "vu", "@"], "wide.txt:1\n", 0),
    ({"wide.txt": "\ufeffdéjà vu\n".encode("utf-16-be")}, ["vu", "@"], "wide.txt:déjà vu\n", 0),
    ({"wide.txt": "vu\n".encode("utf-16-be")}, ["-E", "utf16be", "vu", "@"], "wide.txt:vu\n", 0),
    ({"old.txt": b"na\xefve\n"}, ["-E", "latin1", "ï", "@"], "old.txt:naïve\n", 0),
    ({"z.gz": gzip.compress(b"idle\n"), "plain.txt": b"not idle\n"}, ["-z", "idle", "@"], "plain.txt:not idle\nz.gz:idle\n", 0),
    # several lines
    (POEM, ["-U", "-n", "red\\nvio", "@"], "poem.txt:2:are red\nviolets\n", 0),
    (POEM, ["-U", "-C", "1", "red\\nvio|sweet\\nand", "@"], "poem.txt-roses\npoem.txt:are red\nviolets\npoem.txt-are blue\npoem.txt-sugar\npoem.txt:is sweet\nand so\npoem.txt-are you\n", 0),
    (POEM, ["-U", "-c", "s(?s:.)are", "@"], "poem.txt:2\n", 0),
    (POEM, ["-U", "-o", "d\\nv", "@"], "poem.txt:d\nv\n", 0),
    # which files
    ({"top.txt": b"-", "in/mid.txt": b"-", "in/deep/low.txt": b"-"}, ["--max-depth", "1", "--files", "@"], "in/mid.txt\ntop.txt\n", 0),
    ({"READ.Me": b"-", "other.txt": b"-"}, ["--iglob", "*.ME", "--files", "@"], "READ.Me\n", 0),
    ({"x.cfg": b"-", "y.cfg": b"-", "z.ini": b"-"}, ["-g", "*.cfg", "-g", "!y.*", "--files", "@"], "x.cfg\n", 0),
    ({"run.py": b"-", "run.sh": b"-"}, ["-T", "shell", "--files", "@"], "run.py\n", 0),
    ({"a.conf": b"-", "run.sh": b"-"}, ["--type-add", "conf:*.conf,*.cnf", "-t", "conf", "--files", "@"], "a.conf\n", 0),
    ({".gitignore": b"# cached\n*.tmp\n  !kept.tmp \nout/\n/only-top\n", "a.tmp": b"-", "kept.tmp": b"-", "out/b.txt": b"-", "only-top": b"-", "out/only-top": b"-"}, ["--files", "@"], "kept.tmp\nout/b.txt\nout/only-top\n", 0),
    ({".gitignore": b"*.tmp\n", "a.tmp": b"-", ".rc": b"-"}, ["-u", "--files", "@"], "a.tmp\n", 0),
    ({".gitignore": b"*.tmp\n", "a.tmp": b"-", ".rc": b"-"}, ["-uu", "--files", "@"], ".gitignore\n.rc\na.tmp\n", 0),
    ({"my.rules": b"*.md\n", "a.md": b"-"}, ["--ignore-file", "@/my.rules", "--files", "@"], "my.rules\n", 0),
    # order and form
    ({"p.txt": b"idle\n", "q.txt": b"idle\n"}, ["--sortr", "path", "idle", "@"], "q.txt:idle\np.txt:idle\n", 0),
    ({"p.txt": b"idle\n", "q.txt": b"-\nidle\n"}, ["--heading", "-n", "idle", "@"], "p.txt\n1:idle\n\nq.txt\n2:idle\n", 0),
    ({"p.txt": b"so idle\n"}, ["-n", "--column", "idle", "@/p.txt"], "1:4:so idle\n", 0),
    ({"p.txt": b"so idle\n"}, ["idle", "@/p.txt"], "so idle\n", 0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_search(search, case):
    files, argv, want, code = CASES[case]
    r = search(files, *argv)
    assert (r.text, r.exit_code) == (want, code), r.stderr


def test_stdin(search):
    assert search({}, "-c", "o", stdin=b"one\nskip\ntwo\n").text == "2\n"
    assert '"type":"begin"' in search({}, "--json", "three", stdin=b"one").text


def test_output_comes_as_it_is_made(spark, tmp_path):
    for name in "pq":
        (tmp_path / name).write_bytes(b"idle\n")
    parts = []
    r = main(spark, ["--stats", "idle", str(tmp_path)], None, None, parts.append)
    assert r.stdout == b"" and parts == [f"{tmp_path}/{n}:idle\n".encode() for n in "pq"] and r.stats["printed_bytes"] == sum(map(len, parts))


def test_warnings(search, tmp_path):
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    r = search({"p.txt": b"idle\n"}, "--follow", "idle", "@")
    assert r.text == "p.txt:idle\n" and b"lost: file not found" in r.stderr
    assert search({}, "idle", "@/missing").exit_code == 2


def test_sort_by_time(search, tmp_path):
    for argv, want in ((["--sort", "modified"], "old.txt\nnew.txt\n"), (["--sortr", "accessed"], "new.txt\nold.txt\n")):
        for k, name in enumerate(("new.txt", "old.txt")):  # each time, as reading changes the time of access
            (tmp_path / name).write_bytes(b"idle\n")
            os.utime(tmp_path / name, ns=(10**18 - k * 10**12, 10**18 - k * 10**12))
        assert search({}, *argv, "-l", "idle", "@").text == want


@pytest.fixture
def placed(spark, tmp_path):
    """Ids of pages (page_id, url) by their places in a query, from a table in files of three rows."""

    def run(name, rows):
        at = tmp_path / f"pages_{len(list(tmp_path.iterdir()))}"
        parts = [spark.createDataFrame(rows[k : k + 3], "page_id long, url string").coalesce(1) for k in range(0, len(rows), 3)]
        for part in parts:
            part.withColumn("html", F.lit("tion")).write.mode("append").parquet(str(at / "pages.parquet"))
        found = catalog.QUERIES[name](spark, str(at)).collect()
        assert sorted(r.place for r in found) == list(range(len(rows)))
        return [r.path for r in sorted(found, key=lambda r: r.place)]

    return run


def test_equal_paths_by_id(placed):
    rows = [(k, "ab"[k % 2]) for k in (9, 4, 1, 8, 7, 2, 3, 6, 5, 0)]
    assert placed("grep_sort_order", rows) == placed("grep_sort_order", rows[::-1]) == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]


def test_equal_times_of_access_by_id(placed):
    rows = [(97 * k + k % 2, "a") for k in (6, 1, 5, 0, 7, 3, 2, 4)]
    assert placed("grep_sort_accessed", rows) == placed("grep_sort_accessed", rows[::-1]) == [98, 292, 486, 680, 0, 194, 388, 582]


def test_equal_times_of_change_by_id(placed):
    rows = [(101 * k + k % 2, "a") for k in (6, 1, 5, 0, 7, 3, 2, 4)]
    assert placed("grep_sort_modified", rows) == placed("grep_sort_modified", rows[::-1]) == [0, 202, 404, 606, 102, 304, 506, 708]


def test_nulls_are_last_as_in_sql(placed):
    import duckdb

    rows = [(0, None), (101, "b"), (202, "a"), (None, "c"), (3, ""), (1, "d")]  # no ties, which the SQL leaves open
    values = ", ".join(f"({'NULL' if i is None else i}, {'NULL' if u is None else repr(u)}, 'tion')" for i, u in rows)
    for name in ("grep_sort_modified", "grep_sort_accessed", "grep_sort_order"):
        found = duckdb.sql(catalog.ORACLES[name].replace("FROM pages", f"FROM (VALUES {values}) pages(page_id, url, html)")).fetchall()
        assert placed(name, rows) == [p for p, _ in sorted(found, key=lambda r: r[1])]


@pytest.mark.parametrize("name", ["grep_sort_accessed", "grep_sort_modified", "grep_sort_order"])
def test_rewritten_table_is_read_anew(spark, tmp_path, name):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path / "pages.parquet"
    for ids in ([3, 1, 2], [9, 8, 7, 6], [1, 2, 3]):  # not by Spark, which would drop what it keeps of the path
        pq.write_table(pa.table({"page_id": ids, "url": [f"{i * 5 % 7}/{i}" for i in ids], "html": ["tion"] * len(ids)}), at)
        found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, found)) == sorted(duckdb.sql(catalog.ORACLES[name].replace("FROM pages", f"FROM '{at}'")).fetchall())


def test_symlinks(search, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f.txt").write_bytes(b"x")
    (tmp_path / "d/loop").symlink_to(tmp_path)
    assert search({}, "--files", "@").text == "d/f.txt\n"
    assert search({}, "--follow", "--files", "@").text == "d/f.txt\n"


def test_json(search):
    r = search({"p.txt": b"up\ndown\nup\ndown\n"}, "-U", "--json", "up\\ndown", "@")
    assert '"submatches":[{"match":{"text":"up\\ndown"},"start":0,"end":7},{"match":{"text":"up\\ndown"},"start":8,"end":15}]' in r.text
    assert '"matched_lines":4,"matches":2' in r.text and '"elapsed":{"secs":' in r.text
    assert [json.loads(line)["type"] for line in r.text.splitlines()] == ["begin", "match", "end", "summary"]


def test_preprocessor(search):
    assert search({"a.txt": b"idle\n"}, "--pre", "cat", "idle", "@").text == "a.txt:idle\n"
    r = search({"a.txt": b"idle\n"}, "--pre", "false", "idle", "@")
    assert r.exit_code == 1 and b"preprocessor exited with non-zero status" in r.stderr


def test_broken_gzip_and_stats(search):
    r = search({"a.gz": b"\x1f\x8bbad", "b.txt": b"idle\nidle\n", "c": b"\0"}, "--stats", "-z", "idle", "@")
    assert b"invalid compressed input" in r.stderr and b"2 matches\n2 matched lines\n1 files contained matches\n1 files searched" in r.stderr
    assert b"1 file was skipped as binary\n1 warning was emitted" in r.stderr


@pytest.mark.parametrize(
    ("argv", "kind"),
    [
        (["-C", "1", "-c", "x"], "InvalidFlagCombination"), (["-v", "-o", "x"], "InvalidFlagCombination"), (["--json", "-C", "1", "x"], "InvalidFlagCombination"), (["--null", "x"], "InvalidFlagCombination"),
        (["--heading", "-c", "x"], "InvalidFlagCombination"), (["--pre-glob", "*", "x"], "InvalidFlagCombination"), (["--multiline-dotall", "x"], "InvalidFlagCombination"), (["-r", "y", "--json", "x"], "InvalidFlagCombination"),
        (["-U", "-v", "x"], "InvalidFlagCombination"), (["--files", "-e", "x"], "InvalidFlagCombination"), ([], "MissingPattern"), (["-t", "nope", "x"], "UnknownType"), (["--sort", "created", "x"], "CreationTimeUnavailable"),
        (["-m", "0", "x"], "InvalidNumber"), (["--nope"], "UnknownFlag"), (["-E", "ebcdic", "x"], "InvalidEncoding"), (["-e"], "MissingFlagValue"),
    ],
)
def test_usage(argv, kind):
    with pytest.raises(UsageError) as e:
        parse(argv)
    assert e.value.kind == kind


def test_config(tmp_path):
    at = tmp_path / "rc"
    at.write_text("# flags\n\n -n \n--hidden\n")
    assert with_config(["--config-path", str(at), "x"], {}) == ["-n", "--hidden", "x"]
    assert with_config(["x", "--no-config"], {"TRAWL_CONFIG_PATH": str(at)}) == ["x"]


def test_display():
    assert display(b"\x00 \xfe\x7f~\x1b\t\r\xc3\xa9\n", False) == b"\\x00 \\xFE\\x7F~\\x1B\t\\x0D\xc3\xa9\\x0A"
    assert json_text(b'"\\ \x02\xfe\n', True) == '{"text":"\\"\\\\ \\\\x02\\\\xFE\\n\\n"}'


def test_lines_of_text():
    assert Text(b"").lines == 1 and Text(b"a\n").lines == 1 and Text(b"a\nb").lines == 2 and Text(b"\n\n").lines == 2


def test_binary_column(spark):
    cases = [b"", b"text", b"a\0", bytes(range(1, 8)) + b"\x0e", bytes(range(1, 7)), b"\xff\xfe\0", b"\xef\xbb\xbf\0", b"x" * 1024 + b"\0", b"\t\n\r\x0c" * 20, b"\x7f" * 8]
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "c binary")
    assert [r[0] for r in df.select(transform.is_binary(df.c)).collect()] == [transform.first_binary(c) is not None for c in cases]


def test_native_and_exact_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for text in ("th[aeiou]n", r"\bthe\b", "(?i)ERST", "[äöü]{2}"):
        p = compile_pattern(text)
        native = sorted(map(tuple, lines.matching_lines(docs, "doc_id", "text", p).collect()))
        found = exact.matches(docs, "doc_id", "text", p, "lines").selectExpr("path", "cast(line_number as int)", "cast(line as string)")
        assert native == sorted(map(tuple, found.collect()))
    one = lines.count_lines(docs.coalesce(1), "doc_id", "text", compile_pattern("the")).collect()
    assert sorted(one) == sorted(lines.count_lines(docs.repartition(7), "doc_id", "text", compile_pattern("the")).collect())


def test_exact_on_binary(spark):
    rows = [(1, b"a\xffb"), (2, b"axb"), (3, b"ab"), (4, None), (5, b"")]
    df = spark.createDataFrame([(i, c and bytearray(c)) for i, c in rows], "p int, c binary")
    found = exact.matches(df, "p", "c", compile_pattern("a.b")).select("path", "match_start", "match_end").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 3), (2, 0, 3)]
    assert exact.matches(df, "p", "c", compile_pattern("^$")).select("path").collect() == [(5,)]


def test_events_of_many_lines(spark):
    text = "\n".join("é" * (i % 7) + ("idle" if i % 3 == 0 else "") for i in range(1500))
    rows = lines.events(spark.createDataFrame([(1, text)], "p int, t string"), "p", "t", compile_pattern("idle")).collect()
    data = text.encode()
    assert len(rows) == 500
    for r in rows:
        at = r["absolute_offset"]
        assert data[at : at + len(r["line"].encode())] == r["line"].encode() and (at == 0 or data[at - 1] == 10)
        assert data[at + r["start"] : at + r["end"]] == b"idle"


def test_not_native():
    for p in ("a*", "^a", "[^a]b", "x(?:ab)+c", "a[ab]*b*b*c"):
        with pytest.raises(lines.NotNative):
            lines.exists(compile_pattern(p), None)


def test_table_and_empty(spark):
    df = spark.createDataFrame([("a", "x\ny\n"), ("b", None), ("c", "")], "p string, t string")
    files = corpus.from_table(df.where("t is not null"), "p", "t")
    assert totals(outcomes(parse(["x"]), files)) | {"printed_bytes": 0} == {"matches": 1, "matched_lines": 1, "matched_files": 1, "searched_files": 2, "printed_bytes": 0, "searched_bytes": 4, "skipped_binary_files": 0, "warnings_emitted": 0}
    assert lines.lines(df, "p", "t").count() == 3
    assert lines.matching_lines(df.limit(0), "p", "t", compile_pattern("x")).count() == 0


def test_data_source(spark, tmp_path):
    (tmp_path / "_a").write_bytes(b"idle")
    (tmp_path / ".b").write_bytes(b"x")
    spark.dataSource.register(corpus.CorpusSource)
    df = spark.read.format("trawl_corpus").option("paths", str(tmp_path)).load()
    assert [(r.rel_path, bytes(r.content)) for r in df.collect()] == [("_a", b"idle")]
    (tmp_path / "c.txt").write_bytes(b"y")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("trawl_corpus").option("paths", str(tmp_path)).option("hidden", "true").option("pushdown", "true").load()
    assert [r.rel_path for r in df.where("rel_path LIKE '%.txt' AND depth = 1 AND size < 5").collect()] == ["c.txt"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_table_function(spark):
    exact.register(spark)
    spark.createDataFrame([("zzaxxbxxbyy",)], "t string").createOrReplaceTempView("one_text")
    assert [tuple(r) for r in spark.sql("SELECT g.* FROM one_text, LATERAL trawl_grep(t, 'a.+b') g").collect()] == [(1, 3, "zzaxxbxxbyy", "axxb")]


def test_preprocessor_output_is_bounded(monkeypatch):
    monkeypatch.setattr(transform, "PRE_MOST", 1000)
    with pytest.raises(transform.ContentError, match="PreprocessorTooMuchOutput"):
        transform.preprocess("cat /dev/zero", "/dev/null")
    assert transform.preprocess("echo", "x") == b"x\n"


def test_files_are_read_one_by_one(spark, tmp_path, monkeypatch):
    for k in range(30):
        (tmp_path / f"{k:02d}").write_bytes(b"x" * 10 * k)
    monkeypatch.setattr(corpus, "READ_BYTES", 100)
    assert corpus.shares([5, 5, 20, 1, 1, 1], 10) == [0, 0, 1, 2, 2, 2]
    found = corpus.with_content(corpus.listing(spark, [str(tmp_path)])).select("rel_path", "content").collect()
    assert sorted((r.rel_path, len(r.content)) for r in found) == [(f"{k:02d}", 10 * k) for k in range(30)]


def test_known_without_python(spark):
    """What Java can tell of a file agrees with what the reporter makes of it."""
    contents = [b"k1\n", b"none\n", b"", b"\x00k1", b"\x00", b"\xff\xfek\x001\x00", b"\xfe k1", b"\xfe", b"\xef\xbb\xbfk1"]
    files = spark.createDataFrame([(0, str(i), bytearray(c)) for i, c in enumerate(contents)], "root_ix int, path string, content binary")
    for argv in (["k[0-9]"], ["-c", "k1"], ["-l", "k1"], ["-L", "k1"], ["-v", "k1"], ["--binary", "k1"], ["--text", "k1"], ["-E", "none", "k.*1"], ["-E", "utf16le", "k1"], ["--json", "k1"]):
        o = parse(argv)
        reporter = search_plans.FileReporter(o)
        want = [(str(i), x.printed, x.matched, x.matched_lines, x.matches, x.searched_bytes, x.searched, x.skipped_binary) for i, c in enumerate(contents) if (x := attempt(reporter, str(i), c)) is not None]
        rows = outcomes(o, files.where(F.col("path").isin([w[0] for w in want]))).orderBy("path").collect()
        got = [(r.path, bytes(r.printed), r.matched, r.matched_lines, r.matches, r.searched_bytes, r.searched, r.skipped_binary) for r in rows]
        if "--json" in argv:  # it tells how long it took
            want, got = ([w[0], *w[2:]] for w in want), ([g[0], *g[2:]] for g in got)
        assert list(got) == list(want), argv


def attempt(reporter, path, content):
    try:
        return reporter.report(path, content)
    except ValueError:  # broken UTF-16 ends a search
        return None


def test_listed(spark):
    rows = ["a", ".a", "d/a", "d/.a", ".d/a", "d/e/a"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    shown = lambda **o: [r.p for r in df.where(paths.listed(F.col("p"), **o)).collect()]
    assert shown() == ["a", "d/a", "d/e/a"] and shown(hidden=True) == rows and shown(max_depth=1) == ["a", "d/a"] and shown(max_depth=0) == ["a"]


def test_ignore_lines():
    text = "# c\n  # c\n\n!\n/\nx\n !y \n/z\nd/\n!#e\n a b \n"
    assert paths.ignore_lines(text, "/at") == [("/at/", "x", True), ("/at/", "y", False), ("/at/", "/z", True), ("/at/", "#e", False), ("/at/", "a b", True)]


def test_context_groups(spark):
    text = "\n".join("x" if i in (2, 3, 9, 20) else "-" for i in range(25))
    df = spark.createDataFrame([(1, text), (2, "-")], "p int, t string")
    found = lines.context_groups(df, "p", "t", compile_pattern("x"), 1, 1).collect()
    assert [(r.line_number, r.is_match, r.group_id) for r in found] == [(i + 1, i in (2, 3, 9, 20), g) for g, part in enumerate(((1, 2, 3, 4), (8, 9, 10), (19, 20, 21)), 1) for i in part]


def test_stream(spark, sf_dir, tmp_path):
    from trawl.streaming.search import search_stream, stream_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    for k, text in enumerate(("the", "(an|on)+ed")):
        p = compile_pattern(text)
        q = search_stream(stream_table(spark, str(tmp_path / "in"), docs.schema), "doc_id", "text", p).writeStream.format("memory").queryName(f"found{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
        want = exact.matches(docs, "doc_id", "text", p, "lines").count()
        assert spark.table(f"found{k}").count() == want > 0


def test_type_table():
    t = paths.TypeTable.build(("web:*.web, *.w",))
    assert t.types["web"] == ["*.web", "*.w"] and "rust: *.rs\n" in t.listing()
    with pytest.raises(ValueError):
        paths.TypeTable.build(("broken",))
