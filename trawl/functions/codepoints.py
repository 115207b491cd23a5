"""Sets of code points as sorted ranges, Unicode properties and simple case folding. All of it runs on the driver.

Tables come from the `regex` package where it is installed (scripts and derived properties) and from unicodedata;
their Unicode versions are those of the installation.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict

try:
    import regex
except ImportError:
    regex = None

TOP = 0x10FFFF
Ranges = tuple[tuple[int, int], ...]
ALL: Ranges = ((0, TOP),)
ASCII: Ranges = ((0, 0x7F),)
#: Words, digits and white space without Unicode.
ASCII_WORD: Ranges = ((48, 57), (65, 90), (95, 95), (97, 122))
ASCII_DIGIT: Ranges = ((48, 57),)
ASCII_SPACE: Ranges = ((9, 13), (32, 32))

# Names of general categories, of derived properties, and what is searched for them.
CATEGORIES = {
    "letter": "L", "number": "N", "mark": "M", "punctuation": "P", "punct": "P", "separator": "Z", "symbol": "S", "other": "C",
    "lowercase": "Ll", "lower": "Ll", "uppercase": "Lu", "upper": "Lu", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi",
    "finalpunctuation": "Pf", "otherpunctuation": "Po", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "control": "Cc", "format": "Cf",
    "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
SHORT = {x.lower(): x for x in "L N M P Z S C Ll Lu Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Zs Zl Zp Sm Sc Sk So Cc Cf Cs Co Cn".split()}
DERIVED = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "cased": "Cased", "caseignorable": "Case_Ignorable", "idstart": "ID_Start", "idcontinue": "ID_Continue", "xidstart": "XID_Start", "xidcontinue": "XID_Continue", "defaultignorablecodepoint": "Default_Ignorable_Code_Point", "emoji": "Emoji", "whitespace": "White_Space", "space": "White_Space"}


def normal(ranges) -> Ranges:
    """Sorted, disjoint, and joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        elif a <= b:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def union(*sets: Ranges) -> Ranges:
    return normal(r for s in sets for r in s)


def complement(s: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in s:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    if at <= TOP:
        out.append((at, TOP))
    return tuple(out)


def intersect(a: Ranges, b: Ranges) -> Ranges:
    return complement(union(complement(a), complement(b)))


def subtract(a: Ranges, b: Ranges) -> Ranges:
    return intersect(a, complement(b))


def contains(s: Ranges, cp: int) -> bool:
    i = bisect_right(s, (cp, TOP + 1)) - 1
    return i >= 0 and s[i][0] <= cp <= s[i][1]


def squeeze(name: str) -> str:
    """Names are compared without case, spaces, hyphens and low lines."""
    return re.sub(r"[\s_-]", "", name).lower()


@functools.cache
def _every() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, TOP + 1))))


def _spans(found) -> Ranges:
    return normal((ord(c), ord(c)) for m in found for c in m)


@functools.cache
def _by_category() -> dict[str, Ranges]:
    sets: dict[str, list[list[int]]] = defaultdict(list)
    last = None
    for cp in range(TOP + 1):
        c = unicodedata.category(chr(cp))
        if c == last:
            sets[c][-1][1] = cp
        else:
            sets[c].append([cp, cp])
            last = c
    return {c: tuple((a, b) for a, b in r) for c, r in sets.items()}


@functools.cache
def category(name: str) -> Ranges:
    return union(*(r for c, r in _by_category().items() if c.startswith(name)))


@functools.cache
def _searched(expression: str) -> Ranges:
    out: list[tuple[int, int]] = []
    for m in regex.finditer(rf"{expression}+", _every()):
        a, b = ord(m[0][0]), ord(m[0][-1])
        out += [(a, 0xD7FF), (0xE000, b)] if a < 0xD800 and b > 0xDFFF else [(a, b)]
    return normal(out)


@functools.cache
def script(name: str, extensions: bool) -> Ranges | None:
    """Code points of a script, or None if there is no such script."""
    if regex is None:
        return None
    try:
        regex.compile(rf"\p{{Script={name}}}")
    except regex.error:
        return None
    kind = "Script_Extensions" if extensions else "Script"
    try:
        found = _searched(rf"\p{{{kind}={name}}}")
    except regex.error:
        found = _searched(rf"\p{{Script={name}}}")
    return union(found, category("Cn"), category("Co"), category("Cs")) if squeeze(name) in ("unknown", "zzzz") else found


@functools.cache
def property_set(name: str) -> Ranges | None:
    """Code points of a property by any of its names, or None."""
    if "=" in name:
        kind, _, value = name.partition("=")
        kinds = {"script": False, "sc": False, "scriptextensions": True, "scx": True}
        return script(squeeze(value), kinds[squeeze(kind)]) if squeeze(kind) in kinds else None
    key = squeeze(name)
    if key == "any":
        return ALL
    if key == "ascii":
        return ASCII
    if (short := CATEGORIES.get(key) or SHORT.get(key)) is not None:
        return category(short)
    if key in DERIVED:
        if key in ("whitespace", "space"):
            return SPACE()
        return _searched(rf"\p{{{DERIVED[key]}}}") if regex is not None else None
    return script(key, False) if key else None


@functools.cache
def WORD() -> Ranges:
    alphabetic = _searched(r"\p{Alphabetic}") if regex is not None else union(category("L"), category("Nl"))
    return union(alphabetic, category("M"), category("Nd"), category("Pc"), ((0x200C, 0x200D),))


@functools.cache
def DIGIT() -> Ranges:
    return category("Nd")


@functools.cache
def SPACE() -> Ranges:
    return union(ASCII_SPACE, ((0x85, 0x85), (0xA0, 0xA0)), category("Z"))


def fold(cp: int) -> int:
    """Simple case folding: one code point to one."""
    c = chr(cp)
    for made in (c.casefold(), c.lower()):
        if len(made) == 1:
            return ord(made)
    return cp


@functools.cache
def _groups() -> tuple[dict[int, tuple[int, ...]], tuple[tuple[int, ...], ...]]:
    by: dict[int, set[int]] = defaultdict(set)
    for c in _every():
        f = fold(ord(c))
        if f != ord(c):
            by[f] |= {f, ord(c)}
    groups = tuple(tuple(sorted(g)) for g in by.values())
    return {cp: g for g in groups for cp in g}, groups


def same_folded(cp: int) -> tuple[int, ...]:
    """All code points that fold alike."""
    return _groups()[0].get(cp, (cp,))


def close_under_folding(s: Ranges) -> Ranges:
    if sum(b - a + 1 for a, b in s) <= 64:
        return union(s, tuple((x, x) for a, b in s for cp in range(a, b + 1) for x in same_folded(cp)))
    return union(s, tuple((x, x) for g in _groups()[1] if any(contains(s, cp) for cp in g) for x in g))
