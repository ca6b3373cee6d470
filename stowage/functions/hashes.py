"""Name hashes of the archive families as folds over the bytes of a name, all inside the JVM.

Words of 32 bits are kept in longs and masked after each step, as ANSI arithmetic does not wrap. A 64-bit hash is a
long in two's complement; ``low32`` and ``high32`` give its unsigned halves, which also serve to sort unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import UPPER, LOWER

M32 = 0xFFFFFFFF
POLY = 0xEDB88320
#: Bits that mark an extension in a record name (fixed values of the format).
EXTENSION_BITS = {".kf": 0x80, ".nif": 0x8000, ".dds": 0x8080, ".wav": 0x80000000}


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def name_bytes(name: Column, encoding: str = "UTF-8") -> Column:
    """Bytes of a name as longs, A-Z in lower case. A name of unknown encoding comes as ISO-8859-1, a character a byte."""
    one_each = F.translate(name, UPPER, LOWER)
    one_each = one_each if encoding == "ISO-8859-1" else F.decode(F.encode(one_each, encoding), "ISO-8859-1")  # a character for each byte
    return F.transform(F.filter(F.split(one_each, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def low32(h: Column) -> Column:
    return h.bitwiseAND(_long(M32))


def high32(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def rotate_right(value: Column, amount: Column) -> Column:
    n = amount.bitwiseAND(F.lit(31)).cast("int")
    up = F.call_function("shiftleft", value, (F.lit(32) - n).cast("int"))
    return F.call_function("shiftrightunsigned", value, n).bitwiseOR(up).bitwiseAND(_long(M32))


def unsigned_order(h: Column) -> list[Column]:
    return [high32(h), low32(h)]


def joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _xor_fold(data: Column, rotate: bool) -> Column:
    """Bytes shifted by 0, 8, 16, 24, 0, ... and combined; the rotating form turns by the shifted byte."""
    start = F.struct(_long(0).alias("sum"), F.lit(0).alias("at"))

    def step(acc: Column, b: Column) -> Column:
        t = F.call_function("shiftleft", b, (acc["at"] % 4 * 8).cast("int")).bitwiseAND(_long(M32))
        s = acc["sum"].bitwiseXOR(t)
        return F.struct((rotate_right(s, t) if rotate else s).alias("sum"), (acc["at"] + 1).alias("at"))

    return F.aggregate(data, start, step, lambda acc: acc["sum"])


def hash_tes3(name: Column, encoding: str = "UTF-8") -> Column:
    """Over the name as stored; separators are not folded."""
    def halves(data: Column) -> Column:
        half = F.floor(F.size(data) / 2).cast("int")
        return joined(_xor_fold(F.slice(data, F.lit(1), half), False), _xor_fold(F.slice(data, half + 1, F.size(data)), True))

    return bound(name_bytes(name, encoding), halves)


def _multiply_fold(data: Column) -> Column:
    return F.aggregate(data, _long(0), lambda h, b: (b + h * 65599).bitwiseAND(_long(M32)))


def hash_tes4(stem: Column, extension: Column, encoding: str = "UTF-8") -> Column:
    """Of a file stem and its extension with the dot, or of a folder with an empty extension."""
    first4 = F.substring(F.translate(extension, UPPER, LOWER), 1, 4)
    bits = _long(0)
    for e, b in EXTENSION_BITS.items():
        bits = F.when(first4 == e, _long(b)).otherwise(bits)
    ext = _multiply_fold(name_bytes(extension, encoding))

    def parts(name: Column) -> Column:
        n = F.size(name)
        low = F.element_at(name, -1).bitwiseOR(F.when(n > 2, F.shiftleft(F.element_at(name, F.greatest(n - 1, F.lit(1))), 8)).otherwise(0))
        low = low.bitwiseOR(F.shiftleft(n.cast("long"), 16).bitwiseAND(_long(M32))).bitwiseOR(F.shiftleft(F.element_at(name, 1), 24))
        high = (_multiply_fold(F.slice(name, F.lit(2), F.greatest(n - 3, F.lit(0)))) + ext).bitwiseAND(_long(M32))
        return F.when(n == 0, _long(0)).otherwise(joined(high, low.bitwiseOR(bits)))

    return bound(name_bytes(stem, encoding), parts)


def hash_fo4(name: Column) -> Column:
    """Reflected CRC-32 that starts from 0 and is not inverted; bytes over 127 are skipped, ``/`` counts as ``\\``."""
    data = F.filter(name_bytes(F.translate(name, "/", "\\")), lambda b: b <= 127)
    table = F.array(*(_long(x) for x in _crc_table()))

    def step(h: Column, b: Column) -> Column:
        at = h.bitwiseXOR(b).bitwiseAND(_long(0xFF)).cast("int")
        return F.shiftrightunsigned(h, 8).bitwiseXOR(F.element_at(table, at + 1))

    return F.aggregate(data, _long(0), step)


def _crc_table() -> list[int]:
    """Remainder of each byte, by eight steps of the reflected polynomial."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ POLY * (v & 1)
        out.append(v)
    return out


def extension_magic(extension: Column) -> Column:
    """First four bytes of an extension, lower case, as a little-endian number."""
    data = F.slice(name_bytes(extension), F.lit(1), F.lit(4))
    return F.aggregate(F.reverse(data), _long(0), lambda v, b: v * 256 + b)


def ba2_identity(path: Column) -> Column:
    """(fourcc, name hash, directory hash) of a canonical path; the extension goes without its dot, padded with NULs."""
    from .paths import extension, folder_of, stem

    return F.struct(F.substring(F.rpad(F.substring(extension(path), 2, 4), 4, "\0"), 1, 4).alias("fourcc"), hash_fo4(stem(path)).alias("name_hash"), hash_fo4(folder_of(path)).alias("directory_hash"))
