"""Writers, readers, checks and extraction: round trips and damaged files."""

import hashlib
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from stowage.functions import codecs
from stowage.operators.validation import first_error
from stowage.sources import archives, extract, measurements, writers
from structure import inspect


def sample():
    rng = random.Random(4)
    body = bytes(rng.randrange(256) for _ in range(300))
    return {"Meshes/Tiny/Probe.nif": b"mesh" * 200, "textures\\a.dds": body, "Sound/x.wav": b"w" * 5000, "textures/b.dds": body, "readme.txt": b"", "a/b/c/deep.bin": b"z", "meshes/tiny/other.kf": b"k" * 40}


def frame(spark, files, name="one", compress=True):
    return spark.createDataFrame([(name, p, bytearray(b), compress) for p, b in files.items()], "archive_id string, path string, payload binary, compress boolean")


def canonical(p):
    return p.replace("\\", "/").lower()


@pytest.mark.parametrize(("target", "compress"), [("bsa-tes3", False), ("bsa-fo3", True), ("bsa-sse", True), ("ba2-gnrl-fo4", False), ("ba2-gnrl-sf-v3", True)])
def test_round_trip(spark, tmp_path, target, compress):
    files = sample()
    suffix = ".ba2" if writers.TARGETS[target][0] == "gnrl" else ".bsa"
    done = writers.write(writers.segments(frame(spark, files, compress=compress), target), str(tmp_path), suffix).collect()
    assert [(r.failure, r.bytes) for r in done] == [(None, os.path.getsize(tmp_path / f"one{suffix}"))]
    inspect(tmp_path / f"one{suffix}")
    rows = archives.read_archives(spark, archives.archive_files(str(tmp_path)))
    a = archives.with_profile(archives.archives(rows)).first()
    assert a.profile_codec == writers.TARGETS[target][2] and a.header_bytes
    assert (a.error, a.file_count, a.version) == (None, len(files), writers.TARGETS[target][1])
    assert archives.checked(rows).count() == 0
    e = archives.entries(rows)
    assert {r.path for r in e.collect()} == set(map(canonical, files))
    assert e.where("path = 'textures/a.dds' or path = 'textures/b.dds'").select("payload_offset").distinct().count() == (2 if target == "bsa-tes3" else 1)
    assert archives.identity_mismatch(e).where("record_identity_mismatch").count() == 0
    got = {r.path: (bytes(r.content), r.failure) for r in extract.payloads(e).collect()}
    assert got == {canonical(p): (b, None) for p, b in files.items()}
    if target == "bsa-tes3":
        assert {r.failure for r in writers.write(writers.segments(frame(spark, files), target), str(tmp_path), suffix).collect()} == {"exists"}
        assert archives.read_archives_from_store(spark, str(tmp_path)).where("kind = 'entry'").count() == len(files)


def test_textures(spark, tmp_path):
    parts = [(0, 0, 0, b"a" * 256), (1, 1, 2, b"b" * 80), (0, 0, 2, b"c" * 336), (0, 0, 0, b"a" * 256), (1, 1, 2, b"q" * 80)]
    names = ["T/X.dds", "T/X.dds", "t/y.dds", "t/z.dds", "t/z.dds"]
    rows = [("tex", n, i, s, e, bytearray(b), 8, 8, 3, 28, False) for n, (i, s, e, b) in zip(names, parts, strict=True)]
    rows += [("tex", "t/cube.dds", i, 0, 0, bytearray(bytes([i]) * 64), 4, 4, 1, 28, True) for i in range(6)]
    c = spark.createDataFrame(rows, "archive_id string, path string, nth int, start_mip int, end_mip int, payload binary, width int, height int, mip_count int, dxgi_format int, is_cubemap boolean")
    for target in ("ba2-dx10-fo4", "ba2-dx10-sf-v3"):
        writers.write(writers.segments(c, target), str(tmp_path), f"-{target}.ba2").collect()
    made = [inspect(tmp_path / f"tex-{t}.ba2") for t in ("ba2-dx10-fo4", "ba2-dx10-sf-v3")]
    assert made[0][b"t/cube.dds"] == {"cube": True, "mips": 1} and made[0] == made[1]
    read = archives.read_archives(spark, archives.archive_files(str(tmp_path)))
    assert archives.checked(read).count() == 0
    e = archives.entries(read)
    assert e.count() == 8 and {(r.path == "t/cube.dds", r.array_size, r.is_cubemap, r.cube_maps_raw) for r in e.collect()} == {(False, 1, False, 2048), (True, 1, True, 2049)}
    for r in extract.payloads(e).collect():
        assert r.failure is None and len(r.content) == 148 + (384 if r.path == "t/cube.dds" else 336)
        # flags, sizes, pitch, depth and mips; then capabilities of a plain and of a cube texture without smaller mips
        side, mips = (4, 1) if r.path == "t/cube.dds" else (8, 3)
        assert struct.unpack_from("<4s7I", r.content) == (b"DDS ", 124, 0x2100F, side, side, 0, 0, mips)
        assert struct.unpack_from("<II", r.content, 108) == ((0x1008, 0xFE00) if mips == 1 else (0x401008, 0))
        assert struct.unpack_from("<5I", r.content, 128) == (28, 3, 4 if mips == 1 else 0, 1, 0)
    first = e.where("path = 't/x.dds'").first().chunks[0].payload_offset
    assert e.where("path = 't/z.dds'").first().chunks[0].payload_offset == first

    good = (tmp_path / "tex-ba2-dx10-fo4.ba2").read_bytes()

    def case(at, value):
        p = tmp_path / "bad.bin"
        p.write_bytes(good[:at] + value + good[at + len(value) :])
        return errors(spark, p)

    cube = 24  # the first record: t/cube.dds, 6 chunks
    assert case(cube + 14, struct.pack("<H", 25)) == ("format_error", "chunk_header_size")
    assert case(cube + 24 + 12, struct.pack("<I", 5)) == ("format_error", "chunk_size")
    assert case(cube + 24 + 16, struct.pack("<H", 1)) == ("format_error", "chunk_sequence")
    assert case(cube + 22, struct.pack("<H", 1)) is None  # no cube map: an array of six
    names_at = struct.unpack_from("<Q", good, 16)[0]
    assert case(cube + 24, struct.pack("<Q", names_at + 1)) == ("format_error", "span_in_names")
    assert case(cube + 24, struct.pack("<Q", 30)) == ("format_error", "span_in_tables")
    assert case(cube + 24 + 12, struct.pack("<I", 0)) == ("format_error", "chunk_empty")


def errors(spark, path):
    rows = archives.read_archives(spark, [str(path)])
    found = first_error(archives.checked(rows), ["archive_id"]).collect()
    return (found[0].code, found[0].rule) if found else None


@pytest.mark.parametrize("target", ["bsa-tes3", "bsa-sse", "ba2-gnrl-fo4"])
def test_damaged(spark, tmp_path, target):
    suffix = ".ba2" if target == "ba2-gnrl-fo4" else ".bsa"
    writers.write(writers.segments(frame(spark, {"a/b.txt": b"0123456789" * 9, "c/d.txt": b"x" * 50}), target), str(tmp_path), suffix).collect()
    good = (tmp_path / f"one{suffix}").read_bytes()

    def case(data):
        p = tmp_path / "bad.bin"
        p.write_bytes(data)
        return errors(spark, p)

    assert case(good) is None
    assert case(b"") == ("format_error", "truncated_header")
    assert case(b"none of it") == ("unsupported", "magic")
    assert case(good[:20])[0] == "format_error"
    assert case(good[:-20])[0] == "format_error"
    if target == "bsa-tes3":
        swapped = bytearray(good)
        at = 12 + 12 * 2 + 16
        swapped[at : at + 8], swapped[at + 8 : at + 16] = good[at + 8 : at + 16], good[at : at + 8]
        assert case(bytes(swapped))[0] == "format_error"
        named = good.replace(b"a\\b.txt", b"a\\\xe9.txt")
        assert case(named) == ("format_error", "hash_mismatch")
    if target == "ba2-gnrl-fo4":
        assert case(good[:4] + struct.pack("<I", 9) + good[8:]) == ("unsupported", "version")
        assert case(good[:8] + b"XXXX" + good[12:]) == ("unsupported", "subtype")
        twice = bytearray(good)
        twice[24 + 36 + 16 : 24 + 36 + 24] = struct.pack("<Q", struct.unpack_from("<Q", good, 24 + 16)[0] + 1)
        assert case(bytes(twice)) == ("format_error", "payload_overlap")


def test_writer_problems(spark):
    e = spark.createDataFrame([("a", "x/y"), ("a", "X\\Y"), ("b", "../z"), ("c", "ok")], "archive_id string, path string").withColumn("payload", F.lit(b"1"))
    assert sorted(map(tuple, writers.problems(e).select("archive_id", "rule").collect())) == [("a", "duplicate_path"), ("b", "invalid_path")]


def test_publish(spark, tmp_path):
    c = spark.createDataFrame([("a/b.txt", bytearray(b"1"), None), ("../x", bytearray(b"2"), None), ("c.txt", None, "not_found")], "path string, content binary, failure string")
    assert {r.path: r.failure for r in extract.publish(c, str(tmp_path)).collect()} == {"a/b.txt": None, "../x": "invalid_argument", "c.txt": "not_found"}
    assert (tmp_path / "a/b.txt").read_bytes() == b"1"
    assert {r.path: r.failure for r in extract.publish(c, str(tmp_path)).collect()}["a/b.txt"] == "exists"


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs(codec):
    rng = random.Random(1)
    for data in (b"", b"a", b"abc" * 1000, bytes(rng.randrange(256) for _ in range(70_000)), b"x" * 200_000, bytes(rng.randrange(3) for _ in range(9000))):
        packed = codecs.encode_one(codec, data)
        assert codecs.decode_one(codec, packed, len(data)) == data
        with pytest.raises(ValueError):
            codecs.decode_one(codec, packed, len(data) + 1)


def test_zlib_tolerance():
    z = zlib.compress(b"hello" * 50)
    assert codecs.inflate(z[:-4], 250) == b"hello" * 50
    assert codecs.inflate(z[:-2], 250) == b"hello" * 50
    with pytest.raises(ValueError):
        codecs.inflate(z[:-4] + b"\0\0\0\0", 250)
    with pytest.raises(ValueError):
        codecs.inflate(b"\xff\xff" + z[2:], 250)


def test_decode_errors(spark):
    d = spark.createDataFrame([("zlib", bytearray(b"junk"), 5), ("none", bytearray(b"ab"), 2), ("other", bytearray(b""), 0), ("lz4_block", bytearray(b"\xf0"), 20)], "codec string, data binary, size long")
    got = [tuple(r.x) for r in d.select(codecs.decoded(F.col("codec"), F.col("data"), F.col("size")).alias("x")).collect()]
    assert got == [(None, "format_error"), (b"ab", None), (None, "unsupported"), (None, "format_error")]


def oldest(records):
    """An archive of the oldest family from (name, offset, size, hash or None), in the order given; 40 payload bytes."""
    names = b"".join(n + b"\0" for n, *_ in records)
    starts = [sum(len(n) + 1 for n, *_ in records[:i]) for i in range(len(records))]
    out = struct.pack("<III", 0x100, 12 * len(records) + len(names), len(records))
    out += b"".join(struct.pack("<II", size, at) for _, at, size, _ in records)
    return out + struct.pack(f"<{len(starts)}I", *starts) + names + b"".join(struct.pack("<II", h >> 32, h & 0xFFFFFFFF) for *_, h in records) + b"x" * 40


def hash_oldest(name):
    """The oldest family's hash, in plain Python, over stored bytes."""
    data = name.lower()
    half = len(data) // 2
    high = low = 0
    for i, b in enumerate(data[:half]):
        high ^= b << 8 * (i % 4)
    for i, b in enumerate(data[half:]):
        t = b << 8 * (i % 4)
        low ^= t
        n = t & 31
        low = (low >> n | low << 32 - n) & 0xFFFFFFFF
    return high << 32 | low


def test_names_of_any_encoding(spark, tmp_path):
    assert hash_oldest(b"Icons/EmptyMarker.txt") == 0x030A386AC2E19931 and hash_oldest(b"Meshes/Tiny/Probe.nif") == 0x1C5C78611A5E4FEE
    records = sorted(((n, 4 * i, 4, hash_oldest(n)) for i, n in enumerate((b"caf\xe9\\a.txt", b"caf\xe8\\a.txt", "ö/b".encode()))), key=lambda r: r[3])
    (tmp_path / "a.bsa").write_bytes(oldest(records))
    rows = archives.read_archives(spark, [str(tmp_path / "a.bsa")])
    assert archives.checked(rows).count() == 0 and {r.path for r in archives.entries(rows).collect()} == {"café/a.txt", "cafè/a.txt", "ö/b"}


def test_first_error_of_the_oldest_family(spark, tmp_path):
    good = sorted(((n, 4 * i, 4, hash_oldest(n)) for i, n in enumerate((b"a\\b.txt", b"c\\d.txt", b"e.txt"))), key=lambda r: r[3])
    (n0, _, _, h0), (n1, _, _, h1), (n2, _, _, h2) = good
    bad = hash_oldest(b"..\\x")
    cases = {
        "unsorted_hash": [good[1], (n0, 0, 8, h0), good[2]],  # also overlaps
        "duplicate_hash": [good[0], (n1, 0, 4, h0), good[2]],  # also a wrong hash and an overlap
        "hash_mismatch": [(n0, 0, 4, h0 - 1), (n1, 999, 4, h1), good[2]],  # a span outside comes later
        "invalid_path": [(b"..\\x", 0, 4, bad)],
        "duplicate_path": sorted([(b"a/b.txt", 0, 4, hash_oldest(b"a/b.txt")), (b"a\\b.txt", 900, 4, hash_oldest(b"a\\b.txt"))], key=lambda r: r[3]),
        "span_outside": [(n0, 0, 8, h0), (n1, 4, 8, h1), (n2, 999, 4, h2)],  # overlaps come after all records
        "payload_overlap": [(n0, 0, 4, h0), (n1, 0, 4, h1), (n2, 20, 4, h2)],  # equal spans overlap here
    }
    for i, (rule, records) in enumerate(cases.items()):
        if rule == "duplicate_path":  # the later record breaks it; its span would be next
            records = [records[0][:1] + (0, 4) + records[0][3:], records[1][:1] + (900, 4) + records[1][3:]]
        (tmp_path / f"{i}.bsa").write_bytes(oldest(records))
        assert errors(spark, tmp_path / f"{i}.bsa") == ("format_error", rule)


def tables(spark, tmp_path, change, target="bsa-sse"):
    """A good archive of three files in one folder with each record's (hash, size, offset) changed."""
    files = {f"meshes/{n}.bin": bytes([i]) * 8 for i, n in enumerate(("first", "second", "third"))}
    writers.write(writers.segments(frame(spark, files, compress=False), target), str(tmp_path), ".bsa", overwrite=True).collect()
    data = bytearray((tmp_path / "one.bsa").read_bytes())
    at = 36 + 24 + 1 + len("meshes") + 1
    records = [list(struct.unpack_from("<QII", data, at + 16 * i)) for i in range(3)]
    change(records, data)
    for i, r in enumerate(records):
        struct.pack_into("<QII", data, at + 16 * i, *r)
    (tmp_path / "bad.bsa").write_bytes(data)
    return errors(spark, tmp_path / "bad.bsa")


def test_first_error_of_record_tables(spark, tmp_path):
    def outside(r, _):
        r[1][2], r[1][1] = r[0][2] + 4, 0x1000000

    def in_tables(r, data):
        r[1][2], r[1][1] = 0, len(data)

    def wrong_hash(r, _):
        r[1][0], r[1][2] = 0xDEADBEEF, r[0][2] + 4

    def overlap_first(r, _):
        r[1][2], r[2][1] = r[0][2] + 4, 0x1000000

    def span_first(r, _):
        r[2][2], r[1][1] = r[0][2] + 4, 0x1000000

    def folder(r, data):
        struct.pack_into("<Q", data, 36, 77)
        r[0][1] = 0x1000000

    wanted = {outside: "span_outside", in_tables: "span_in_tables", wrong_hash: "hash_mismatch", overlap_first: "payload_overlap", span_first: "span_outside", folder: "folder_hash_mismatch"}
    for change, rule in wanted.items():
        assert tables(spark, tmp_path, change) == ("format_error", rule)


def test_first_error_of_textures_and_general(spark, tmp_path):
    files = {"a/b.txt": b"0123456789", "c/d.txt": b"x" * 50}
    writers.write(writers.segments(frame(spark, files, compress=False), "ba2-gnrl-fo4"), str(tmp_path), ".ba2").collect()
    good = (tmp_path / "one.ba2").read_bytes()

    def case(*changes):
        data = bytearray(good)
        for at, value in changes:
            data[at : at + len(value)] = value
        (tmp_path / "bad.ba2").write_bytes(data)
        return errors(spark, tmp_path / "bad.ba2")

    second, name = 24 + 36, good.index(b"c/d.txt")
    first_at, names_at = struct.unpack_from("<Q", good, 24 + 16)[0], struct.unpack_from("<Q", good, 16)[0]
    assert case((second + 16, struct.pack("<Q", first_at + 1))) == ("format_error", "payload_overlap")
    assert case((name, b"a/b.txt"), (second + 16, struct.pack("<Q", first_at + 1))) == ("format_error", "duplicate_path")
    assert case((name, b"../.txt"), (second + 16, struct.pack("<Q", 1 << 50))) == ("format_error", "invalid_path")
    assert case((second + 16, struct.pack("<Q", 1 << 50)), (second + 28, struct.pack("<I", 9))) == ("format_error", "span_outside")
    assert case((second + 16, struct.pack("<Q", 30)), (name, b"c/d.txt")) == ("format_error", "span_in_tables")
    assert case((second + 16, struct.pack("<Q", names_at - 1)), (second + 28, struct.pack("<I", 3))) == ("format_error", "span_in_names")
    assert case((24 + 16, struct.pack("<Q", 1 << 50)), (name, b"a/b.txt")) == ("format_error", "span_outside")


@pytest.mark.parametrize(("target", "policy", "embed", "flags"), [("bsa-oblivion", "default", True, 3), ("bsa-oblivion", "compressed", False, 7), ("bsa-fo3", "default", True, 0x107), ("bsa-sse", "raw", True, 0x103), ("bsa-sse", "default", False, 7)])
def test_archive_flags_and_policies(spark, tmp_path, target, policy, embed, flags):
    files = {"a/x.txt": b"text " * 40, "a/empty.txt": b"", "b/raw.txt": b"raw " * 30, "b/packed.txt": b"packed " * 30, "top.txt": b"top " * 9}
    says = {"b/raw.txt": False, "b/packed.txt": True}
    rows = [("one", p, bytearray(b), says.get(p)) for p, b in files.items()]
    e = spark.createDataFrame(rows, "archive_id string, path string, payload binary, compress boolean")
    writers.write(writers.segments(e, target, policy=policy, embed=embed), str(tmp_path), ".bsa").collect()
    assert inspect(tmp_path / "one.bsa")["flags"] == flags
    read = archives.read_archives(spark, [str(tmp_path / "one.bsa")])
    assert archives.checked(read).count() == 0
    packs = bool(flags & 4)
    codec = writers.TARGETS[target][2]
    got = {r.path: r for r in archives.entries(read).collect()}
    for p, b in files.items():
        packed = says.get(p, packs) and bool(b)
        assert got[p].compression == (codec if packed else "none") and got[p].raw_size == len(b)
        assert bool(got[p].record_flags & 0x40000000) == (packed != packs)
        assert got[p].embedded_name_prefix_size == (1 + len(p if "/" in p else ".\\" + p) if flags & 0x100 else 0)
    assert {r.path: bytes(r.content) for r in extract.payloads(archives.entries(read)).collect()} == files


def test_general_records_keep_their_flags(spark, tmp_path):
    e = spark.createDataFrame([("one", "a.txt", bytearray(b"a"), 0), ("one", "b.txt", bytearray(b"b"), None), ("one", "c.txt", bytearray(b"c" * 90), 7)], "archive_id string, path string, payload binary, record_flags long")
    writers.write(writers.segments(e, "ba2-gnrl-fo4"), str(tmp_path), ".ba2").collect()
    got = archives.entries(archives.read_archives(spark, [str(tmp_path / "one.ba2")])).collect()
    assert {(r.path, r.record_flags, r.compression) for r in got} == {("a.txt", 0, "zlib"), ("b.txt", 0x00100100, "zlib"), ("c.txt", 7, "zlib")}


def test_extraction_refuses_what_is_too_large_or_changed(spark, tmp_path):
    files = {"a.txt": b"a" * 100, "b.txt": b"b" * 10}
    writers.write(writers.segments(frame(spark, files, compress=False), "ba2-gnrl-fo4"), str(tmp_path), ".ba2").collect()
    e = archives.entries(archives.read_archives(spark, [str(tmp_path / "one.ba2")]))
    assert {r.path: r.failure for r in extract.payloads(e, most=50).collect()} == {"a.txt": "too_large", "b.txt": None}
    assert {r.failure for r in extract.payloads(e.withColumn("size_bytes", F.col("size_bytes") + 1)).collect()} == {"io_error"}


def test_unfit_for_record_tables(spark):
    head = bytearray(148)
    head[:4], head[84:88] = b"DDS ", b"DX10"
    struct.pack_into("<II", head, 12, 4, 4)
    struct.pack_into("<II", head, 128, 98, 3)
    rows = [("a", "t/new.dds", bytes(head)), ("b", "t/junk.dds", b"junk"), ("c", "d/" + "n" * 256, b""), ("d", "f" * 200 + "/" + "n" * 60, b"")]
    e = spark.createDataFrame(rows, "archive_id string, path string, payload binary")
    said = lambda *a: {(r.archive_id, r.code, r.rule) for r in writers.problems(e, *a).collect()}
    assert said("bsa-fo3") == {("a", "format_error", "texture_format"), ("c", "format_error", "name_too_long")}
    assert said("bsa-sse", True) == {("c", "format_error", "name_too_long"), ("d", "format_error", "name_too_long")}
    assert said("ba2-gnrl-fo4") == set()
    wanted = spark.createDataFrame([("a",), ("z",)], "archive_id string")
    assert {tuple(r) for r in writers.problems(e, wanted=wanted).collect()} == {("z", "invalid_argument", "empty")}


def test_evidence(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    writers.write(writers.segments(frame(spark, {"a.txt": b"a"}), "ba2-gnrl-sf-v3"), str(tmp_path / "sub"), ".ba2").collect()
    (tmp_path / "junk.bsa").write_bytes(b"junk")
    got = {r.path: r for r in measurements.inventory(spark, str(tmp_path)).collect()}
    body = (tmp_path / "sub/one.ba2").read_bytes()
    assert (got["sub/one.ba2"].sha256, got["sub/one.ba2"].size, got["sub/one.ba2"].compression_method, got["sub/one.ba2"].entry_count) == (hashlib.sha256(body).hexdigest(), len(body), 3, 1)
    assert got["junk.bsa"].error == "unsupported" and len(got) == 2
    (tmp_path / "runs.csv").write_text("archive,elapsed_ms,diagnostic,label\nx,1.5,error (C:/a (b)): format_error: bad,before\nx,oops,,before\ny,2,fine,after\n")
    runs = measurements.read_runs(spark, str(tmp_path / "runs.csv"))
    assert sorted((r.archive, r.elapsed_ms, r.diagnostic) for r in runs.collect() if r.elapsed_ms) == [("x", 1.5, "error: format_error: bad"), ("y", 2.0, "fine")]
    assert [r.archive for r in measurements.repeated_archives(runs).collect()] == ["x"]
    pixels = bytes(range(64))
    head = lambda flags, pitch: struct.pack("<4s7I", b"DDS ", 124, flags, 4, 4, pitch, 0, 1) + bytes(52) + b"DX10" + bytes(40) + struct.pack("<5I", 28, 3, 0, 1, 0)
    files = [("a", head(0x2100F, 0) + pixels), ("b", head(0x81007, 64) + pixels), ("c", head(0x2100F, 0) + pixels[::-1]), ("d", b"text"), ("e", None)]
    seen = {r.path: r for r in measurements.fingerprints(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert seen["a"].identity == seen["b"].identity != seen["c"].identity and seen["a"].sha256 != seen["b"].sha256
    assert len(seen["a"].dds_header_hex) == 296 and seen["a"].payload_sha256_148 == hashlib.sha256(pixels).hexdigest()
    assert seen["d"].dds_header_hex is None and seen["d"].identity == hashlib.sha256(b"text").hexdigest()


@pytest.mark.parametrize("target", ["ba2-gnrl-fo4", "bsa-tes3", "bsa-fo3"])
def test_raw_payloads_stay_out_of_python(spark, capsys, monkeypatch, target):
    """An archive whose payloads are stored as they are is planned without Python workers."""
    plans, write = [], writers.written
    monkeypatch.setattr(writers, "written", lambda df, name: (df.explain(), plans.append(capsys.readouterr().out)) and write(df, name))
    plan = writers.segments(frame(spark, {"a/b.txt": b"0123456789" * 9, "c/d.txt": b"", "c/e.txt": b"x" * 50}).drop("compress"), target, policy="raw")
    assert plans and not any("EvalPython" in p for p in plans)
    assert plan.selectExpr("sum(octet_length(data)) n", "max(offset + octet_length(data)) m").first().asDict() == {"n": (n := plan.selectExpr("sum(octet_length(data)) n").first().n), "m": n}


def test_encoded_keeps_what_needs_no_codec(spark):
    rows = [("none", b"a" * 40), ("zlib", b"a" * 40), ("zlib", b""), ("lz4_block", b"abc" * 30), ("none", None), ("zlib", None)]
    got = spark.createDataFrame(rows, "codec string, data binary").select("codec", "data", codecs.encoded(F.col("codec"), F.col("data")).alias("e")).collect()
    for r in got:
        assert bytes(r.e) == (codecs.encode_one(r.codec, bytes(r.data)) if r.data else b"")
