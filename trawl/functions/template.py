"""Replacement templates: $$ is a dollar sign; $1, ${1}, $name and ${name} are groups ($0 is the whole match); a group
that the pattern lacks gives nothing, and a dollar sign before anything else stands for itself."""

from __future__ import annotations

import re

REFERENCE = re.compile(r"\$(?:(?P<dollar>\$)|\{(?P<braced>[^}]*)\}|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*))")


def parse_template(template: str, names: tuple[str | None, ...]) -> list[str | int]:
    """Texts, and numbers of groups, in order. names: the names of the pattern's groups, None where one has none."""
    numbers = {str(k): k for k in range(len(names) + 1)} | {n: k for k, n in enumerate(names, 1) if n is not None}
    parts: list[str | int] = []
    at = 0
    for found in REFERENCE.finditer(template):
        parts.append(template[at : found.start()])
        at = found.end()
        token = found[found.lastgroup]
        if found.lastgroup == "dollar":
            parts.append("$")
        elif (group := numbers.get(token.lstrip("0") or "0" if token.isascii() and token.isdigit() else token)) is not None:
            parts.append(group)
    return [p for p in (*parts, template[at:]) if p != ""]


def java_form(parts: list[str | int]) -> str:
    """The same for Java's regular expressions."""
    return "".join(f"${p}" if isinstance(p, int) else re.sub(r"[\\$0-9]", r"\\\g<0>", p) for p in parts)
