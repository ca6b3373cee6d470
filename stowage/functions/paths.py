"""Virtual paths as column expressions: canonical form, parts, extension, destination safety. ASCII only, by design."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Device names no file may have, whatever its extension (fixed values of the platform).
DEVICES = ("con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def display(path: Column) -> Column:
    """Separators as archives show them."""
    return F.translate(path, "/", "\\")


def is_valid(path: Column) -> Column:
    """No empty, ``.`` or ``..`` segment (so no leading or trailing separator), no drive, no NUL."""
    bad = F.exists(F.split(with_slashes(path), "/"), lambda s: s.isin("", ".", ".."))
    return path.isNotNull() & ~(bad | path.rlike("^[A-Za-z]:") | path.contains("\0"))


def canonical(path: Column) -> Column:
    """Lower case with forward slashes; null for a path that is not valid."""
    return F.when(is_valid(path), F.translate(path, UPPER + "\\", LOWER + "/"))


def path_error(path: Column) -> Column:
    return F.when(~is_valid(F.coalesce(path, F.lit(""))), F.lit("invalid_argument"))


def file_of(path: Column) -> Column:
    return F.element_at(F.split(with_slashes(path), "/"), -1)


def folder_of(path: Column) -> Column:
    """Everything before the last separator; empty without one."""
    p = with_slashes(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, "^(.*)/", 1)).otherwise("")


def join_parts(folder: Column, file: Column) -> Column:
    return F.when(folder == "", file).otherwise(F.concat_ws("\\", folder, file))


def extension(path: Column) -> Column:
    """From the last dot of the file name on, in lower case; empty without a dot."""
    return ascii_lower(F.regexp_extract(file_of(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_of(path), r"\.[^.]*$", "")


def is_sound(path: Column) -> Column:
    p = ascii_lower(with_slashes(path))
    return p.startswith("sound/") | p.endswith(".wav") | p.endswith(".xwm") | p.endswith(".fuz")


def is_safe_destination(path: Column) -> Column:
    """May be created below a target folder: relative, no ``..``, device name, colon, or segment ending in dot or space."""

    def odd(s: Column) -> Column:
        base = ascii_lower(F.regexp_extract(s, r"^([^.]*)", 1))
        return s.isin("", ".", "..") | s.contains(":") | s.endswith(".") | s.endswith(" ") | F.rtrim(base).isin(*DEVICES) | s.rlike(r"[\x00-\x1f<>\"|?*]")

    return path.isNotNull() & ~F.exists(F.split(with_slashes(path), "/"), odd)


def escaped(text: Column) -> Column:
    """Control characters made visible for one-line listings: by letter or as ``\\xNN``; backslashes stay as they are."""
    out = text
    for code in (*range(32), 127):
        seen = {9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\x{code:02X}")
        out = F.replace(out, F.lit(chr(code)), F.lit(seen))
    return out


def diagnostic(text: Column) -> Column:
    """A command's message without the context in parentheses before its error code, to compare those of two runs."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^error \(.*?\): (?=[a-z_]+: )", "error: "))


def host_path_error(raw: Column) -> Column:
    """``invalid_argument`` for a host path (as bytes) that is null, isn't UTF-8, or holds a NUL; else null."""
    bad = raw.isNull() | ~F.is_valid_utf8(raw.cast("string")) | (F.instr(F.decode(raw, "ISO-8859-1"), "\0") > 0)
    return F.when(bad, F.lit("invalid_argument"))
