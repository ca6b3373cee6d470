import random

from pyspark.sql import functions as F

from stowage.sources import archives, dds, extract, writers


def texture(spark, width, height, mips, fmt, block, side, array, cube, seed):
    rng = random.Random(seed)
    size = lambda m: -(-max(width >> m, 1) // side) * -(-max(height >> m, 1) // side) * block
    body = bytes(rng.randrange(256) for _ in range(sum(map(size, range(mips))) * array * (6 if cube else 1)))
    lit = F.lit
    head = spark.range(1).select(extract.dds_header(lit(width), lit(height), lit(mips), lit(fmt), lit(array), lit(cube)).alias("h")).first().h
    return bytes(head) + body, [size(m) for m in range(mips)]


def test_round_trip_and_parts(spark, tmp_path):
    made = {"t/plain.dds": texture(spark, 16, 8, 4, 71, 8, 4, 1, False, 1), "t/cube.dds": texture(spark, 8, 8, 2, 28, 4, 1, 1, True, 2), "t/array.dds": texture(spark, 600, 512, 3, 77, 16, 4, 2, False, 3)}
    bad = {"x/short.dds": made["t/plain.dds"][0][:-1], "x/none.dds": b"", "x/odd.dds": made["t/plain.dds"][0][:128] + (999).to_bytes(4, "little") + made["t/plain.dds"][0][132:]}
    rows = [("tex", p, bytearray(b)) for p, b in [(p, b) for p, (b, _) in made.items()] + list(bad.items())]
    files = spark.createDataFrame(rows, "archive_id string, path string, content binary")
    assert {r.path: r.code for r in dds.rejected(files).collect()} == {"x/short.dds": "format_error", "x/none.dds": "format_error", "x/odd.dds": "unsupported"}
    assert {r.path for r in dds.rejected(files, newest=False).collect()} == set(bad)
    assert {r.path for r in dds.rejected_as_records(files.where("path like 't/%'"), 104).collect()} == set()
    subs = {(r.path, r.array_index, r.face, r.mip): (r.offset, len(r.payload)) for r in dds.subresources(files).collect()}
    assert len(subs) == 4 + 12 + 6
    sizes = made["t/array.dds"][1]
    assert subs["t/array.dds", 1, 0, 1] == (148 + sum(sizes) + sizes[0], sizes[1])
    parts = dds.chunks(files)
    assert [(r.start_mip, r.end_mip) for r in parts.where("path = 't/array.dds'").orderBy("nth").collect()] == [(0, 0), (1, 2)] * 2
    writers.write(writers.segments(parts, "ba2-dx10-sf-v3"), str(tmp_path), ".ba2").collect()
    read = archives.read_archives(spark, archives.archive_files(str(tmp_path)))
    assert archives.checked(read).count() == 0
    e = archives.entries(read)
    assert {r.path: (r.array_size, r.is_cubemap) for r in e.collect()} == {"t/plain.dds": (1, False), "t/cube.dds": (1, True), "t/array.dds": (2, False)}
    got = {r.path: bytes(r.content) for r in extract.payloads(e).collect()}
    assert got == {p: b for p, (b, _) in made.items()}


def test_layout_violations(spark, tmp_path):
    made = {"five": (5, 336), "six": (6, 336), "seven": (7, 336), "long": (6, 340)}
    rows = [("tex", f"t/{n}.dds", i, 0, 2, bytearray(random.Random(i).randbytes(size)), 8, 8, 3, 28, True) for n, (faces, size) in made.items() for i in range(faces)]
    c = spark.createDataFrame(rows, "archive_id string, path string, nth int, start_mip int, end_mip int, payload binary, width int, height int, mip_count int, dxgi_format int, is_cubemap boolean")
    writers.write(writers.segments(c, "ba2-dx10-fo4"), str(tmp_path), ".ba2").collect()
    read = archives.read_archives(spark, archives.archive_files(str(tmp_path)))
    path = {r.record_index: r.path for r in archives.entries(read).collect()}
    assert {(path[r.record_index], r.rule) for r in archives.checked(read).collect()} == {("t/five.dds", "chunk_sequence"), ("t/seven.dds", "chunk_sequence"), ("t/long.dds", "chunk_size")}
