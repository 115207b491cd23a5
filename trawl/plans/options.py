"""Options of a search: what a command line can say, and which combinations make no sense."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from trawl.functions.pattern import Pattern, any_of
from trawl.operators.paths import BUILTIN_TYPES, TypeTable

ENCODINGS = ("auto", "none", "utf8", "latin1", "utf16le", "utf16be")
SORTS = ("none", "path", "modified", "accessed", "created")
MODES = ("lines", "count", "with", "without")
CONFIG_MOST = 64 << 10
CONFIG_VARIABLE = "TRAWL_CONFIG_PATH"


class UsageError(ValueError):
    """kind: what is wrong (InvalidFlagCombination, MissingPattern, ...)."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass(frozen=True)
class Options:
    patterns: tuple[str, ...] = ()
    paths: tuple[str, ...] = (".",)
    # walking and filtering
    hidden: bool = False
    follow: bool = False
    max_depth: int | None = None
    globs: tuple[tuple[str, bool], ...] = ()  # (glob, without case)
    types: tuple[str, ...] = ()
    not_types: tuple[str, ...] = ()
    type_adds: tuple[str, ...] = ()
    ignore: bool = True
    ignore_vcs: bool = True
    ignore_parent: bool = True
    ignore_files: tuple[str, ...] = ()
    sort: str = "none"
    reverse: bool = False
    # content
    search_zip: bool = False
    pre: str | None = None
    pre_globs: tuple[str, ...] = ()
    encoding: str = "auto"
    binary: str = "skip"  # or text, suppress
    # pattern
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    multiline: bool = False
    multiline_dotall: bool = False
    invert: bool = False
    # report
    mode: str = "lines"
    json: bool = False
    only_matching: bool = False
    replacement: str | None = None
    max_count: int | None = None
    before: int = 0
    after: int = 0
    with_filename: bool = True
    line_number: bool = False
    column: bool = False
    heading: bool = False
    null: bool = False
    stats: bool = False
    quiet: bool = False
    list_files: bool = False
    type_list: bool = False
    help: bool = False
    version: bool = False
    # how it was said
    seen: frozenset = field(default_factory=frozenset)
    default_path: bool = True
    has_paths: bool = False

    def pattern(self) -> Pattern:
        return any_of(list(self.patterns), fixed=self.fixed, ignore_case=self.ignore_case, smart_case=self.smart_case, multiline=self.multiline, dot_all=self.multiline_dotall)

    def type_table(self) -> TypeTable:
        return TypeTable.build(self.type_adds)


# The flags, what they set, and the names under which rules ask whether they were given.
FLAGS = {
    "--hidden": {"hidden": True}, "-v": {"invert": True}, "--invert-match": {"invert": True}, "--type-list": {"type_list": True}, "--json": {"json": True}, "--files": {"list_files": True},
    "--stats": {"stats": True}, "-q": {"quiet": True}, "--quiet": {"quiet": True}, "--null": {"null": True}, "--heading": {"heading": True}, "--no-ignore": {"ignore": False}, "--no-ignore-vcs": {"ignore_vcs": False},
    "--no-ignore-parent": {"ignore_parent": False}, "--follow": {"follow": True}, "-i": {"ignore_case": True}, "--ignore-case": {"ignore_case": True}, "-F": {"fixed": True}, "--fixed-strings": {"fixed": True},
    "-S": {"smart_case": True}, "--smart-case": {"smart_case": True}, "--text": {"binary": "text"}, "--binary": {"binary": "suppress"}, "-z": {"search_zip": True}, "--search-zip": {"search_zip": True},
    "--buffered": {}, "--mmap": {}, "-U": {"multiline": True}, "--multiline": {"multiline": True}, "--multiline-dotall": {"multiline_dotall": True}, "-H": {"with_filename": True}, "--with-filename": {"with_filename": True},
    "-c": {"mode": "count"}, "--count": {"mode": "count"}, "-l": {"mode": "with"}, "--files-with-matches": {"mode": "with"}, "-L": {"mode": "without"}, "--files-without-match": {"mode": "without"},
    "-o": {"only_matching": True}, "--only-matching": {"only_matching": True}, "--no-filename": {"with_filename": False}, "-n": {"line_number": True}, "--line-number": {"line_number": True},
    "--no-line-number": {"line_number": False}, "--column": {"column": True}, "--no-column": {"column": False}, "-h": {"help": True}, "--help": {"help": True}, "-V": {"version": True}, "--version": {"version": True},
}
VALUED = {
    "-e": "patterns", "--regexp": "patterns", "-r": "replacement", "--replace": "replacement", "--ignore-file": "ignore_files", "--type-add": "type_adds", "-t": "types", "-T": "not_types", "--pre": "pre",
    "--pre-glob": "pre_globs", "--sort": "sort", "--sortr": "sortr", "-g": "glob", "--glob": "glob", "--iglob": "iglob", "-E": "encoding", "--encoding": "encoding", "-j": "threads", "--threads": "threads",
    "--max-depth": "max_depth", "-A": "after", "--after-context": "after", "-B": "before", "--before-context": "before", "-C": "context", "--context": "context", "-m": "max_count", "--max-count": "max_count",
    "--config-path": "config",
}


def _number(text: str, least: int) -> int:
    if not re.fullmatch(r"\d+", text) or int(text) < least:
        raise UsageError("InvalidNumber", text)
    return int(text)


def config_arguments(path: str) -> list[str]:
    """Arguments in a file: one for each line that isn't empty and doesn't start with #."""
    data = Path(path).read_bytes()
    if len(data) > CONFIG_MOST:
        raise UsageError("ConfigTooLarge", path)
    lines = (line.strip(" \t\r") for line in data.decode("utf-8").split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def with_config(argv: list[str], environment: dict[str, str] | None = None) -> list[str]:
    """argv after the arguments of the configuration file, if one is named."""
    environment = os.environ if environment is None else environment
    path = environment.get(CONFIG_VARIABLE)
    rest, i, off = [], 0, False
    while i < len(argv):
        if argv[i] == "--config-path":
            if i + 1 == len(argv):
                raise UsageError("MissingFlagValue", argv[i])
            path, i = argv[i + 1], i + 1
        elif argv[i] == "--no-config":
            off = True
        else:
            rest.append(argv[i])
        i += 1
    return (config_arguments(path) if path and not off else []) + rest


def parse(argv: list[str]) -> Options:
    """Options of a command line. After the first argument that is no flag, all are paths."""
    held: dict = {}
    seen: set[str] = set()
    positional: list[str] = []
    unrestricted, i = 0, 0
    while i < len(argv):
        arg = argv[i]
        i += 1
        if positional:
            positional.append(arg)
        elif arg == "--":
            positional += argv[i:]
            break
        elif re.fullmatch(r"-u{1,3}", arg) or arg == "--unrestricted":
            unrestricted += 1 if arg.startswith("--") else len(arg) - 1
        elif arg in FLAGS:
            held |= FLAGS[arg]
            seen |= {*FLAGS[arg]}
        elif arg in VALUED:
            if i == len(argv):
                raise UsageError("MissingFlagValue", arg)
            value, name, i = argv[i], VALUED[arg], i + 1
            seen.add(name)
            if name in ("patterns", "ignore_files", "type_adds", "types", "not_types", "pre_globs"):
                held[name] = (*held.get(name, ()), value)
            elif name in ("glob", "iglob"):
                held["globs"] = (*held.get("globs", ()), (value, name == "iglob"))
            elif name in ("sort", "sortr"):
                if value not in SORTS:
                    raise UsageError("InvalidSortMode", value)
                held |= {"sort": value, "reverse": name == "sortr"}
            elif name == "encoding":
                if value not in ENCODINGS:
                    raise UsageError("InvalidEncoding", value)
                held[name] = value
            elif name == "context":
                held |= {"before": _number(value, 0), "after": _number(value, 0)}
            elif name in ("threads", "max_count"):
                n = _number(value, 1)
                held |= {name: n} if name == "max_count" else {}
            elif name in ("max_depth", "after", "before"):
                held[name] = _number(value, 0)
            elif name != "config":
                held[name] = value
        elif arg.startswith("-") and arg != "-":
            raise UsageError("UnknownFlag", arg)
        else:
            positional.append(arg)
    if unrestricted:
        held["ignore"] = False
        held |= {"hidden": True} if unrestricted > 1 else {}
        held |= {"binary": "text"} if unrestricted > 2 else {}
    made = Options(**held, seen=frozenset(seen))
    if made.help or made.version or made.type_list:
        return made
    if made.list_files:
        paths = tuple(positional)
    elif made.patterns:
        paths = tuple(positional)
    else:
        if not positional:
            raise UsageError("MissingPattern")
        made, paths = replace(made, patterns=(positional[0],)), tuple(positional[1:])
    made = replace(made, paths=paths or (".",), default_path=not paths, has_paths=bool(paths))
    validate(made)
    return made


def validate(o: Options) -> None:
    """Raises UsageError for combinations that make no sense."""
    context = bool(o.before or o.after)

    def no(*conditions: bool) -> None:
        if any(conditions):
            raise UsageError("InvalidFlagCombination")

    if o.list_files:
        shape = {"with_filename", "line_number", "column", "encoding", "binary"} & o.seen
        no(bool(o.patterns), o.fixed, o.invert, o.search_zip, o.pre is not None, o.multiline, o.max_count is not None, context, o.json, o.mode != "lines", o.only_matching, o.heading, o.ignore_case, o.smart_case, bool(shape - {"with_filename"}))
    no(bool(o.pre_globs) and o.pre is None, o.multiline_dotall and not o.multiline)
    no(context and (o.mode != "lines" or o.only_matching or o.invert), o.invert and o.only_matching, o.json and context)
    no(o.null and o.mode not in ("with", "without") and not o.list_files, o.heading and (o.mode != "lines" or o.json))
    no(o.binary == "suppress" and (o.json or o.only_matching or o.mode == "count" or o.heading))
    no(o.replacement is not None and (o.json or o.mode != "lines" or o.invert or o.multiline or o.binary == "suppress"))
    no(o.multiline and (o.invert or o.max_count is not None or o.heading and o.mode != "lines"))
    table = TypeTable.build(o.type_adds)
    for name in (*o.types, *o.not_types):
        if name not in table.types:
            raise UsageError("UnknownType", name)
    if o.sort == "created":
        raise UsageError("CreationTimeUnavailable")


__all__ = ["BUILTIN_TYPES", "Options", "UsageError", "config_arguments", "parse", "validate", "with_config"]
