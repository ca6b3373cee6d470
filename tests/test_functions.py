import pytest
from pyspark.sql import functions as F

from stowage.functions import hashes, numbers, paths


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("stem", "ext", "want"),
    [("packedscript", ".pex", "83E92AA4700C7074"), ("rawscript", ".pex", "A538479272097074"), ("scripts\\sse", "", "8CA70A2C730B7365")],
)
def test_record_hash(spark, stem, ext, want):
    assert one(spark, F.hex(hashes.hash_tes4(F.lit(stem), F.lit(ext)))) == want


@pytest.mark.parametrize(("name", "want"), [("sfrawlz4", 0x6B40D233), ("textures/generated", 0x873F049B), ("sfarray", 0x64033F5B), ("", 0), ("é", 0)])
def test_crc_hash(spark, name, want):
    assert one(spark, hashes.hash_fo4(F.lit(name))) == want


@pytest.mark.parametrize(("name", "want"), [("Icons/EmptyMarker.txt", "30A386AC2E19931"), ("Meshes/Tiny/Probe.nif", "1C5C78611A5E4FEE")])
def test_stored_name_hash(spark, name, want):
    assert one(spark, F.hex(hashes.hash_tes3(F.lit(name)))) == want
    assert one(spark, F.hex(hashes.hash_tes3(F.lit(name.replace("/", "\\"))))) != want


def test_identity(spark):
    got = one(spark, hashes.ba2_identity(F.lit("textures/generated/sfarray.dds")))
    assert tuple(got) == ("dds\0", 0x64033F5B, 0x873F049B)


@pytest.mark.parametrize(
    ("path", "want"),
    [("A\\B/c.TXT", "a/b/c.txt"), ("Ä\\X", "Ä/x"), ("", None), ("/a", None), ("a/", None), ("a//b", None), ("a/./b", None), ("..", None), ("C:\\x", None), ("a\0b", None), (None, None), ("a..b/c", "a..b/c")],
)
def test_canonical(spark, path, want):
    assert one(spark, paths.canonical(F.lit(path).cast("string"))) == want


@pytest.mark.parametrize(
    ("path", "safe"),
    [("a/b.txt", True), ("con.txt", False), ("a/NUL", False), ("a/b.", False), ("a /b", False), ("../a", False), ("a:b", False), ("comx/lpt1x", True), ("lpt1/x", False)],
)
def test_destination(spark, path, safe):
    assert one(spark, paths.is_safe_destination(F.lit(path))) is safe


def test_parts(spark):
    r = spark.range(1).select(*(f(F.lit("a\\b.c/Dee.TXT")).alias(n) for n, f in (("folder", paths.folder_of), ("file", paths.file_of), ("ext", paths.extension), ("stem", paths.stem), ("shown", paths.display)))).first()
    assert tuple(r) == ("a/b.c", "Dee.TXT", ".txt", "Dee", "a\\b.c\\Dee.TXT")
    assert one(spark, paths.extension(F.lit("a.b/c"))) == ""


def test_numbers(spark):
    assert one(spark, numbers.little_endian(F.unhex(F.lit("00DF0ADBA0")), 1, 3)) == 0xDB0ADF
    assert one(spark, F.hex(numbers.encode_little_endian(F.lit(0xBAADF00D), 4))) == "0DF0ADBA"
    assert one(spark, numbers.little_endian(numbers.encode_little_endian(F.lit(-2), 8), 0, 8)) == -2
    top = 9223372036854775807
    assert one(spark, numbers.span_fits(F.lit(top), F.lit(1), F.lit(top))) is False
    assert one(spark, numbers.spans_overlap(F.lit(top - 1), F.lit(5), F.lit(top - 3), F.lit(3))) is True
    assert one(spark, numbers.spans_overlap(F.lit(1), F.lit(0), F.lit(0), F.lit(9))) is False


def test_escapes_and_messages(spark):
    rows = [("a\\b\t\n\r\x01\x7f é",), ("error (C:\\x (1)): format_error: bad",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(paths.escaped(F.col("t")), paths.diagnostic(F.col("t"))).collect()
    assert got[0][0] == "a\\b\\t\\n\\r\\x01\\x7F é" and got[1][1] == "error: format_error: bad" and got[2][1] == ""
    raw = spark.createDataFrame([(b"a/\xc3\xa9",), (b"a\xe9",), (b"a\0",), (None,)], "r binary").select(paths.host_path_error(F.col("r")))
    assert [r[0] for r in raw.collect()] == [None, *["invalid_argument"] * 3]


def test_checked_arithmetic(spark):
    big = F.lit((1 << 62) + 1)
    got = spark.range(1).select(numbers.checked_add(big, big), numbers.checked_multiply(big, F.lit(2)), numbers.checked_multiply(F.lit(6), F.lit(7))).first()
    assert tuple(got) == (None, None, 42)
