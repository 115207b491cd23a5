"""Content transforms between reading and matching, row by row: gunzip, preprocessor, binary detection, decoding."""

from __future__ import annotations

import errno
import gzip
import re
import subprocess
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that are looked at to tell binary files.
HEAD = 1024
#: Bytes that a preprocessor may print.
PRE_MOST = 32 << 20
CONTROLS = re.compile(rb"[\x00-\x08\x0b\x0e-\x1f\x7f]")
MOST_CONTROLS = 8


# How problems with a file are told, and which of the system's errors are such problems.
MESSAGES = {
    "FileNotFound": "file not found", "AccessDenied": "access denied", "NotDir": "not a directory", "NameTooLong": "name too long", "SymLinkLoop": "symlink loop", "InvalidCompressedInput": "invalid compressed input",
    "PreprocessorFailed": "preprocessor exited with non-zero status", "PreprocessorSignaled": "preprocessor terminated by signal", "PreprocessorTooMuchOutput": "preprocessor output exceeded limit",
}
SYSTEM = {errno.ENOENT: "FileNotFound", errno.EACCES: "AccessDenied", errno.EPERM: "AccessDenied", errno.ENOTDIR: "NotDir", errno.ENAMETOOLONG: "NameTooLong", errno.ELOOP: "SymLinkLoop"}


class ContentError(ValueError):
    """A file that is passed over with a warning."""


def problem(e: OSError) -> str:
    """The kind of a system error that a search passes over; others end it."""
    if e.errno not in SYSTEM:
        raise e
    return SYSTEM[e.errno]


def gunzip(data: bytes) -> bytes:
    """Data as it is if it isn't gzip."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise ContentError("InvalidCompressedInput") from e


def preprocess(command: str, path: str) -> bytes:
    """What a command (its words, then the path) prints; no more than PRE_MOST bytes of it are ever held. A command
    that can't be started is an error of the search."""
    with subprocess.Popen([*command.split(), path], stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        made = run.stdout.read(PRE_MOST + 1)
        if len(made) > PRE_MOST:
            run.kill()
            raise ContentError("PreprocessorTooMuchOutput")
        if code := run.wait():
            raise ContentError("PreprocessorSignaled" if code < 0 else "PreprocessorFailed")
    return made


def has_bom(data: bytes) -> bool:
    return data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"))


def first_binary(data: bytes) -> int | None:
    """Where a file first looks binary (a NUL, or one of many control characters), or None."""
    head = data[:HEAD]
    if has_bom(head):
        return None
    if (nul := head.find(b"\0")) >= 0:
        return nul
    found = [m.start() for m in CONTROLS.finditer(head)]
    return found[0] if len(found) >= MOST_CONTROLS else None


def is_binary(content: Column) -> Column:
    """first_binary(...) is not null, without Python: over BINARY columns."""
    head = F.substring(content, 1, HEAD)
    marked = content.startswith(F.lit(b"\xef\xbb\xbf")) | content.startswith(F.lit(b"\xff\xfe")) | content.startswith(F.lit(b"\xfe\xff"))
    codes = F.regexp_replace(F.hex(head), "(..)", "$1 ")
    controls = F.regexp_count(codes, F.lit("(?:0[0-8BEF]|1.|7F) "))
    return ~marked & (F.contains(head, F.lit(b"\0")) | (controls >= MOST_CONTROLS))


def decoded(data: bytes, encoding: str) -> bytes:
    """UTF-8 (or bytes as they are) for an encoding's name; an error where UTF-16 is broken."""
    if encoding == "latin1":
        return data.decode("latin-1").encode()
    if encoding == "auto":
        if not data.startswith((b"\xff\xfe", b"\xfe\xff")):
            return data
        encoding = "utf16le" if data.startswith(b"\xff\xfe") else "utf16be"
    if encoding in ("utf16le", "utf16be"):
        body = data.removeprefix(b"\xff\xfe" if encoding == "utf16le" else b"\xfe\xff")
        try:
            return body.decode("utf-16-le" if encoding == "utf16le" else "utf-16-be").encode()
        except UnicodeDecodeError as e:
            raise ValueError("InvalidUtf16") from e
    return data


def decode_column(content: Column, encoding: str) -> Column:
    """decoded(...) as a string, without Python."""
    le, be = F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff")
    rest = F.substring(content, 3, 1 << 30)
    match encoding:
        case "latin1":
            return F.decode(content, "ISO-8859-1")
        case "utf16le":
            return F.decode(F.when(content.startswith(le), rest).otherwise(content), "UTF-16LE")
        case "utf16be":
            return F.decode(F.when(content.startswith(be), rest).otherwise(content), "UTF-16BE")
        case "auto":
            return F.when(content.startswith(le), F.decode(rest, "UTF-16LE")).when(content.startswith(be), F.decode(rest, "UTF-16BE")).otherwise(content.cast("string"))
    return content.cast("string")
