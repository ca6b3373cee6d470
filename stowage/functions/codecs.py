"""Payload codecs as Arrow functions: zlib, LZ4 block, LZ4 frame, and none.

A payload that does not decode to exactly its declared size gives an error, never an exception."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_MAGIC = 0x184D2204
CODECS = ("none", "zlib", "lz4_block", "lz4_frame")


def inflate(data: bytes, size: int) -> bytes:
    """zlib data of exactly ``size`` bytes; a checksum cut off at the end is let pass, a wrong one is not."""
    if not data and size == 0:
        return b""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, size + 1)
        if len(out) != size or not d.eof or d.unused_data:
            if len(out) == size and not d.eof:
                return _without_trailer(data, size)
            raise ValueError("size")
        return out
    except zlib.error:
        return _without_trailer(data, size)


def _without_trailer(data: bytes, size: int) -> bytes:
    if len(data) < 2 or data[0] & 15 != 8 or (data[0] << 8 | data[1]) % 31 or data[1] & 32:
        raise ValueError("header")
    d = zlib.decompressobj(-15)
    out = d.decompress(data[2:], size + 1)
    if len(out) != size or not d.eof or len(d.unused_data) >= 4:
        raise ValueError("body")
    return out


def lz4_block(data: bytes, size: int | None, prefix: bytes = b"") -> bytes:
    """One LZ4 block; ``prefix`` is what earlier blocks of a linked frame gave."""
    out = bytearray(prefix)
    i, n = 0, len(data)
    while i < n:
        token = data[i]
        i += 1
        run = token >> 4
        if run == 15:
            while True:
                run += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        if i + run > n:
            raise ValueError("literals")
        out += data[i : i + run]
        i += run
        if i == n:
            break
        back = data[i] | data[i + 1] << 8
        i += 2
        run = (token & 15) + 4
        if run == 19:
            while True:
                run += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        at = len(out) - back
        if back == 0 or at < 0:
            raise ValueError("offset")
        while run > 0:  # a match may run into what it writes
            part = out[at : at + run]
            out += part
            at += len(part)
            run -= len(part)
        if size is not None and len(out) - len(prefix) > size:
            raise ValueError("size")
    got = bytes(out[len(prefix) :])
    if size is not None and len(got) != size:
        raise ValueError("size")
    return got


def lz4_compress_block(data: bytes) -> bytes:
    """Greedy LZ4 block: four bytes that were seen within 64 KiB become a match."""
    out, seen, anchor, i, n = bytearray(), {}, 0, 0, len(data)

    def emit(literals: bytes, back: int, length: int) -> None:
        a, b = min(len(literals), 15), min(length - 4, 15) if back else 0
        out.append(a << 4 | b)
        if a == 15:
            out.extend(b"\xff" * ((len(literals) - 15) // 255) + bytes([(len(literals) - 15) % 255]))
        out.extend(literals)
        if back:
            out.extend(struct.pack("<H", back))
            if b == 15:
                out.extend(b"\xff" * ((length - 19) // 255) + bytes([(length - 19) % 255]))

    while i < n - 12:  # the last bytes of a block are literals
        key = data[i : i + 4]
        at = seen.get(key, -1)
        seen[key] = i
        if at >= 0 and i - at < 65536:
            length = 4
            while i + length < n - 5 and data[at + length] == data[i + length]:
                length += 1
            emit(data[anchor:i], i - at, length)
            i += length
            anchor = i
        else:
            i += 1
    emit(data[anchor:], 0, 0)
    return bytes(out)


def lz4_frame(data: bytes, size: int) -> bytes:
    import xxhash

    magic, flags = struct.unpack_from("<IB", data)
    if magic != FRAME_MAGIC or flags >> 6 != 1:
        raise ValueError("magic")
    at = 6
    if flags & 8:
        if struct.unpack_from("<Q", data, at)[0] != size:
            raise ValueError("size")
        at += 8
    at += 4 * (flags & 1)
    if xxhash.xxh32(data[4:at]).intdigest() >> 8 & 255 != data[at]:
        raise ValueError("header checksum")
    at += 1
    out = bytearray()
    while True:
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        if n == 0:
            break
        body = data[at : at + (n & 0x7FFFFFFF)]
        if len(body) != n & 0x7FFFFFFF:
            raise ValueError("truncated")
        at += len(body)
        if flags & 16:
            if struct.unpack_from("<I", data, at)[0] != xxhash.xxh32(body).intdigest():
                raise ValueError("block checksum")
            at += 4
        out += body if n & 0x80000000 else lz4_block(body, None, b"" if flags & 32 else bytes(out[-65536:]))
        if len(out) > size:
            raise ValueError("size")
    if flags & 4:
        if struct.unpack_from("<I", data, at)[0] != xxhash.xxh32(bytes(out)).intdigest():
            raise ValueError("content checksum")
        at += 4
    if at != len(data) or len(out) != size:
        raise ValueError("end")
    return bytes(out)


def lz4_compress_frame(data: bytes) -> bytes:
    import xxhash

    head = struct.pack("<BBQ", 0b01101100, 0x40, len(data))
    out = [struct.pack("<I", FRAME_MAGIC), head, bytes([xxhash.xxh32(head).intdigest() >> 8 & 255])]
    for i in range(0, len(data), 65536):
        part = data[i : i + 65536]
        packed = lz4_compress_block(part)
        out += [struct.pack("<I", len(packed)), packed] if len(packed) < len(part) else [struct.pack("<I", len(part) | 0x80000000), part]
    return b"".join([*out, struct.pack("<II", 0, xxhash.xxh32(data).intdigest())])


def decode_one(codec: str, data: bytes, size: int) -> bytes:
    if codec == "none":
        if len(data) != size:
            raise ValueError("size")
        return data
    if codec == "zlib":
        return inflate(data, size)
    if codec == "lz4_block":
        return lz4_block(data, size)
    if codec == "lz4_frame":
        return lz4_frame(data, size)
    raise KeyError(codec)


def encode_one(codec: str, data: bytes) -> bytes:
    if codec == "none":
        return data
    return {"zlib": zlib.compress, "lz4_block": lz4_compress_block, "lz4_frame": lz4_compress_frame}[codec](data)


def decoded(codec: Column, data: Column, size: Column) -> Column:
    """(content, error) of a stored payload: ``format_error`` if it is damaged, ``unsupported`` for another codec."""

    @F.pandas_udf("content binary, error string")
    def run(codecs: pd.Series, payloads: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for c, p, n in zip(codecs, payloads, sizes, strict=True):
            try:
                out.append((decode_one(c, bytes(p), int(n)), None))
            except KeyError:
                out.append((None, "unsupported"))
            except (ValueError, IndexError, TypeError, struct.error, zlib.error):
                out.append((None, "format_error"))
        return pd.DataFrame(out, columns=["content", "error"])

    return run(codec, data, size)


def encoded(codec: Column, data: Column) -> Column:
    """Stored form of a payload; an empty payload is stored as it is, whatever its codec.

    Only what a codec changes goes through Python, one payload at a time out of its Arrow batch."""

    @F.arrow_udf("binary")
    def run(codecs: pa.Array, payloads: pa.Array) -> pa.Array:
        return pa.array((encode_one(c.as_py(), p.as_py()) if p.is_valid else None for c, p in zip(codecs, payloads, strict=True)), pa.binary(), size=len(payloads))

    packed = F.coalesce((codec != "none") & (F.octet_length(data) > 0), F.lit(False))
    return F.when(packed, run(codec, F.when(packed, data))).otherwise(F.coalesce(data, F.lit(b"")))
