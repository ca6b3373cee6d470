"""A second reading of archives in plain Python, which shares no code with the library: what writers made must hold."""

import struct

MARK = 0xBAADF00D


def names_after(data, at, count):
    out = []
    for _ in range(count):
        (n,) = struct.unpack_from("<H", data, at)
        out.append(data[at + 2 : at + 2 + n])
        at += 2 + n
    assert at == len(data), "names end the file"
    return out


def inspect_ba2(data):
    magic, version, kind, count, names_at = struct.unpack_from("<4sI4sIQ", data)
    assert magic == b"BTDX" and version in (1, 2, 3)
    at = {1: 24, 2: 32, 3: 36}[version]
    if version > 1:
        assert struct.unpack_from("<II", data, 24) == (1, 0)
    spans, out = set(), []
    for _ in range(count):
        if kind == b"GNRL":
            _, ext, _, flags, place, packed, raw, mark = struct.unpack_from("<I4sIIQIII", data, at)
            assert mark == MARK
            at += 36
            spans.add((place, packed or raw))
            out.append({"ext": ext, "flags": flags, "raw": raw})
        else:
            _, ext, _, unknown, chunks, width, h, w, mips, fmt, cube = struct.unpack_from("<I4sIBBHHHBBH", data, at)
            assert (unknown, width) == (0, 24) and cube in (2048, 2049) and ext == b"dds\0" and chunks and h and w and mips and fmt
            at += 24
            tops = 0
            for _ in range(chunks):
                place, packed, raw, first, last, mark = struct.unpack_from("<QIIHHI", data, at)
                assert mark == MARK and packed and raw and first <= last < mips
                tops += first == 0
                spans.add((place, packed))
                at += 24
            assert cube == 2048 or tops % 6 == 0
            out.append({"cube": cube == 2049, "mips": mips})
    check_spans(spans, at, names_at)
    names = names_after(data, names_at, count)
    assert names == sorted(names)
    return dict(zip(names, out, strict=True))


def check_spans(spans, start, stop):
    """Payloads fill what lies between tables and names, none overlapping another."""
    at = start
    for place, size in sorted(s for s in spans if s[1]):
        assert place == at, "a gap or an overlap"
        at += size
    assert at == stop


def inspect_tes3(data):
    magic, hash_at, count = struct.unpack_from("<III", data)
    assert magic == 0x100
    records = [struct.unpack_from("<II", data, 12 + 8 * i) for i in range(count)]
    starts = struct.unpack_from(f"<{count}I", data, 12 + 8 * count)
    blob = data[12 + 12 * count : 12 + hash_at]
    hashes = [struct.unpack_from("<II", data, 12 + hash_at + 8 * i) for i in range(count)]
    assert hashes == sorted(set(hashes))
    check_spans({(at, size) for size, at in records}, 0, len(data) - 12 - hash_at - 8 * count)
    names = [blob[s : blob.index(b"\0", s)] for s in starts]
    assert b"".join(n + b"\0" for n in names) == blob
    return names


def inspect_tes4(data):
    magic, version, place, flags, folders, files, folder_bytes, name_bytes, classes = struct.unpack_from("<4s8I", data)
    assert magic == b"BSA\0" and place == 36 and flags & 3 == 3
    width = 24 if version == 105 else 16
    at, order, records, names, seen = 36 + width * folders, [], [], [], 0
    for k in range(folders):
        h, n = struct.unpack_from("<QI", data, 36 + width * k)
        (said,) = struct.unpack_from("<Q" if width == 24 else "<I", data, 36 + width * k + (16 if width == 24 else 12))
        assert said - name_bytes == at
        size = data[at]
        name = data[at + 1 : at + size]
        assert data[at + size] == 0
        seen += size
        at += 1 + size
        own = [struct.unpack_from("<QII", data, at + 16 * i) for i in range(n)]
        assert [r[0] for r in own] == sorted(r[0] for r in own)
        at += 16 * n
        order.append(h)
        records += own
        names += [name] * n
    assert order == sorted(order) and len(records) == files and seen == folder_bytes
    listed = data[at : at + name_bytes].split(b"\0")[:-1]
    assert len(listed) == files and data[at + name_bytes - 1] == 0
    check_spans({(p, s & 0x3FFFFFFF) for _, s, p in records}, at + name_bytes, len(data))
    whole = [f + b"\\" + n if f != b"." else n for f, n in zip(names, listed, strict=True)]
    if flags & 0x100:
        for (_, _, p), f, n in zip(records, names, listed, strict=True):
            assert data[p + 1 : p + 1 + data[p]] == f + b"\\" + n
    return {"flags": flags, "classes": classes, "names": whole}


def inspect(path):
    data = path.read_bytes()
    return (inspect_ba2 if data[:4] == b"BTDX" else inspect_tes4 if data[:4] == b"BSA\0" else inspect_tes3)(data)
