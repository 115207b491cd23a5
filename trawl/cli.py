"""trawl on the command line: python -m trawl.cli [FLAGS] PATTERN [PATH...]"""

from __future__ import annotations

import os
import sys

VERSION = "0.1.0"
USAGE = """usage: trawl [FLAGS] PATTERN [PATH...]
Searches the files below each PATH (the current folder if there is none) for PATTERN.

pattern   -e PATTERN (may be repeated)  -F literal  -i ignore case  -S smart case  -U multi-line  --multiline-dotall
lines     -v those without a match  -m N at most N  -A N  -B N  -C N context  -o matched text only  -r TEXT replacement
report    -c counts  -l files with a match  -L files without  --json  --stats  -q exit code only  --files list files
form      -H/--no-filename  -n/--no-line-number  --column/--no-column  --heading  --null
files     --hidden  --follow  --max-depth N  -g GLOB  --iglob GLOB  -t TYPE  -T TYPE  --type-add NAME:GLOBS  --type-list
          --ignore-file FILE  --no-ignore  --no-ignore-vcs  --no-ignore-parent  -u, -uu, -uuu  --sort KEY  --sortr KEY
content   -z gzip  --pre COMMAND  --pre-glob GLOB  -E ENCODING  --text  --binary
other     --config-path FILE  --no-config  -h  -V; --buffered, --mmap and -j N are taken and change nothing
"""


def main(argv: list[str]) -> int:
    if {"-h", "--help"} & {*argv}:
        print(USAGE, end="")
        return 0
    if {"-V", "--version"} & {*argv}:
        print(f"trawl {VERSION}")
        return 0
    from pyspark.sql import SparkSession

    from trawl.plans import search

    spark = SparkSession.builder.appName("trawl").getOrCreate()
    stdin = None if sys.stdin is None or sys.stdin.isatty() else sys.stdin.buffer.read()
    result = search.main(spark, argv, stdin, dict(os.environ), sys.stdout.buffer.write)
    sys.stdout.buffer.write(result.stdout)  # of what didn't come as it was made
    sys.stderr.buffer.write(result.stderr)
    return result.exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
