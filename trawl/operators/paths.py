"""Path predicates: globs, file types and ignore rules, as Catalyst expressions over a relative path.

In a glob only * is special; it stands for any run of characters, slashes too.
"""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# The built-in file types.
BUILTIN_TYPES = {
    "zig": ["*.zig"], "c": ["*.c", "*.h"], "cpp": ["*.cc", "*.cpp", "*.cxx", "*.hpp", "*.hh", "*.hxx"], "rust": ["*.rs"], "python": ["*.py"], "shell": ["*.sh", "*.bash", "*.zsh"], "markdown": ["*.md"],
    "json": ["*.json"], "yaml": ["*.yaml", "*.yml"], "toml": ["*.toml"], "html": ["*.html", "*.htm"], "css": ["*.css"], "javascript": ["*.js", "*.mjs", "*.cjs"], "typescript": ["*.ts", "*.tsx"], "text": ["*.txt"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _like(glob: str) -> str:
    return "".join("%" if c == "*" else f"\\{c}" if c in "%_\\" else c for c in glob)


def glob_matches(text: Column, glob: str) -> Column:
    """Whether a whole text matches a glob."""
    return F.like(text, F.lit(_like(glob)), F.lit("\\")) if "*" in glob else text == F.lit(glob)


def path_matches(path: Column, glob: str, ignore_case: bool = False) -> Column:
    """A glob that starts with / is held against the whole path, others against the path and each segment."""
    if ignore_case:
        path, glob = F.translate(path, UPPER, LOWER), "".join(c.lower() if c.isascii() else c for c in glob)
    if glob.startswith("/"):
        return glob_matches(path, glob[1:])
    return glob_matches(path, glob) | F.exists(F.split(path, "/"), lambda s: glob_matches(s, glob))


def last_match(path: Column, globs: list[tuple[str, bool]]) -> Column:
    """A list of (glob, without case) of which the last that matches decides; ! excludes. If any includes, paths that
    none matches are out, else in."""
    rules = [(g, fold) for g, fold in globs if g.removeprefix("!")]
    result = F.lit(not any(not g.startswith("!") for g, _ in rules))
    for g, fold in rules:
        out = g.startswith("!")
        result = F.when(path_matches(path, g[1:] if out else g, fold), F.lit(not out)).otherwise(result)
    return result


@dataclass(frozen=True)
class TypeTable:
    types: dict[str, list[str]]

    @classmethod
    def build(cls, adds: tuple[str, ...] = ()) -> TypeTable:
        """The built-in types and those of name:glob,glob specifications."""
        types = {n: list(g) for n, g in BUILTIN_TYPES.items()}
        for spec in adds:
            name, colon, globs = spec.partition(":")
            parts = [g.strip() for g in globs.split(",")]
            if not colon or not name.strip() or not all(parts):
                raise ValueError(f"InvalidTypeAddSpec: {spec}")
            types.setdefault(name.strip(), []).extend(parts)
        return cls(types)

    def listing(self) -> str:
        return "".join(f"{n}: {', '.join(g)}\n" for n, g in self.types.items())

    def allows(self, path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
        any_of = lambda names: reduce(or_, (path_matches(path, g) for n in names for g in self.types[n]))
        result = any_of(include) if include else F.lit(True)
        return result & ~any_of(exclude) if exclude else result


#: A line of an ignore file: a mark that lets paths in again, a glob, slashes that make it speak of folders.
IGNORE_LINE = re.compile(r"^[ \t\r]*+(?!#)(?P<again>!?)(?P<glob>[^\n]*?)(?P<folder>/*)[ \t\r]*$", re.M)

#: Below which folder a line counts, its glob, and whether what it matches is ignored.
Ignore = tuple[str, str, bool]


def ignore_lines(text: str, folder: str) -> list[Ignore]:
    """The lines of an ignore file of a folder that speak of files."""
    found = IGNORE_LINE.finditer(text)
    return [(folder.rstrip("/") + "/", m["glob"], not m["again"]) for m in found if m["glob"].strip("/") and not m["folder"]]


def load_ignore(root: str, vcs: bool, parents: bool, files: tuple[str, ...]) -> list[Ignore]:
    """Rules of the .gitignore files from the file system's root down to the search's, then of named files. Driver
    only: the folders above a search are few."""
    folder = os.path.abspath(root if os.path.isdir(root) else os.path.dirname(root) or ".")
    rules: list[Ignore] = []
    if vcs:
        chain = [folder]
        while parents and (up := os.path.dirname(chain[-1])) != chain[-1]:
            chain.append(up)
        for at in reversed(chain):
            file = Path(at, ".gitignore")
            if file.is_file():
                rules += ignore_lines(file.read_text(errors="surrogateescape"), at)
    for name in files:
        rules += ignore_lines(Path(name).read_text(errors="surrogateescape"), os.path.dirname(os.path.abspath(name)))
    return rules


def ignored(absolute: Column, rules: list[Ignore]) -> Column:
    """Whether the last line that matches an absolute path ignores it. A line doesn't reach out of its folder."""
    verdict = F.lit(False)
    for folder, glob, out in rules:
        below = F.substring(absolute, len(folder) + 1, 1 << 30)
        verdict = F.when(absolute.startswith(folder) & path_matches(below, glob), F.lit(out)).otherwise(verdict)
    return verdict


def listed(path: Column, hidden: bool = False, max_depth: int | None = None) -> Column:
    """Whether a walk meets a path from its root: no part of it is hidden (unless those are asked for), and no folder
    on the way lies deeper than max_depth."""
    parts = F.split(path, "/")
    met = F.lit(True) if hidden else ~F.exists(parts, lambda p: p.startswith("."))
    return met if max_depth is None else met & (F.size(parts) <= max_depth + 1)


def relative(path: str, root: str) -> str:
    """A path from its root, or its name if it is the root."""
    return posixpath.basename(path) if path == root else posixpath.relpath(path, root)
