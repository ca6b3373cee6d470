"""Archive catalogs as DataFrames.

``read_archives`` plans one task for each file; a task opens its file once, reads the header and the tables, never the
payloads (but for the few bytes before a payload that hold its size), and gives one row for the archive and one for
each entry. Tables are decoded a column at a time, not a row. All checks on those rows are DataFrame operations
(``checked``)."""

from __future__ import annotations

import io
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, paths
from ..functions.numbers import span_fits, spans_overlap
from ..operators import spans, textures, validation

ENTRY_LIMIT, FOLDER_LIMIT = 1_000_000, 65_536
SENTINEL = 0xBAADF00D
CHUNK = "struct<payload_offset:long,stored_size:long,raw_size:long,start_mip:int,end_mip:int,compression:string>"
SCHEMA = (
    "archive_id string, kind string, family string, variant string, version long, archive_flags long, file_count long, default_compression string, starfield_unknown1 long, "
    "starfield_unknown2 long, compression_method long, size_bytes long, trailing_names boolean, folder_names_mismatch boolean, error string, error_rule string, record_index long, "
    "original_path string, raw_name binary, raw_folder binary, raw_file binary, folder string, file string, raw_size long, stored_size long, payload_offset long, data_offset long, archive_hash long, folder_hash long, fourcc string, compression string, "
    "record_flags long, has_embedded_name boolean, embedded_name_prefix_size long, metadata_end long, name_table_start long, name_table_end long, width int, height int, mip_count int, dxgi_format int, cube_maps_raw int, "
    f"chunks array<{CHUNK}>"
)
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(", ")]


class Fault(Exception):
    def __init__(self, code: str, rule: str):
        super().__init__(rule)
        self.code, self.rule = code, rule


class _Reader:
    """Exact reads from an open file, each checked against its size."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, 2)

    def at(self, offset: int, n: int, rule: str) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise Fault("format_error", rule)
        self.file.seek(offset)
        return self.file.read(n)

    def table(self, offset: int, count: int, dtype: np.dtype, rule: str) -> np.ndarray:
        return np.frombuffer(self.at(offset, count * dtype.itemsize, rule), dtype)


def _text(raw: bytes) -> str:
    """A stored name as text; one that isn't UTF-8 is read byte by byte, so that different names stay different."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _signed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers as two's complement."""
    return values.astype("<u8").view("<i8")


def _tes3(r: _Reader):
    _, hash_at, count = struct.unpack("<III", r.at(0, 12, "truncated_header"))
    if count > ENTRY_LIMIT:
        raise Fault("format_error", "entry_limit")
    hash_at += 12
    names_at = 12 + 12 * count
    data_at = hash_at + 8 * count
    if hash_at < names_at or data_at > r.size:
        raise Fault("format_error", "hash_table_place")
    records = r.table(12, count, np.dtype([("size", "<u4"), ("at", "<u4")]), "truncated_records")
    starts = r.table(12 + 8 * count, count, np.dtype("<u4"), "truncated_name_offsets").astype(np.int64)
    blob = r.at(names_at, hash_at - names_at, "truncated_names")
    halves = r.table(hash_at, count, np.dtype([("high", "<u4"), ("low", "<u4")]), "truncated_hashes")
    ends = np.append(np.flatnonzero(np.frombuffer(blob, np.uint8) == 0), -1)
    stops = ends[np.searchsorted(ends[:-1], starts)]
    if ((stops < 0) | (starts >= len(blob))).any():
        raise Fault("format_error", "name_span")
    names = [blob[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    size, at = records["size"].astype(np.int64), data_at + records["at"].astype(np.int64)
    head = {"family": "bsa", "variant": "tes3", "version": 256, "archive_flags": 0, "file_count": count, "default_compression": "none"}
    return head, count, {"raw_name": names, "original_path": [*map(_text, names)], "raw_size": size, "stored_size": size, "payload_offset": at, "data_offset": at, "archive_hash": _signed(halves["high"].astype(np.uint64) << np.uint64(32) | halves["low"]), "compression": "none", "record_flags": 0, "has_embedded_name": False, "embedded_name_prefix_size": 0, "metadata_end": data_at}


def _tes4(r: _Reader):
    _, version, place, flags, folders, files, folder_bytes, name_bytes, _ = struct.unpack("<9I", r.at(0, 36, "truncated_header"))
    if version not in (103, 104, 105):
        raise Fault("unsupported", "version")
    if place != 36:
        raise Fault("format_error", "folder_offset")
    if not flags & 1 or not flags & 2:
        raise Fault("unsupported", "name_flags")
    if folders > FOLDER_LIMIT or files > ENTRY_LIMIT:
        raise Fault("format_error", "entry_limit")
    codec = "lz4_frame" if version == 105 else "zlib"
    kind = np.dtype([("hash", "<u8"), ("count", "<u4"), ("pad", "<u4"), ("at", "<u8")] if version == 105 else [("hash", "<u8"), ("count", "<u4"), ("at", "<u4")])
    if 36 + folders * (kind.itemsize + 2) + 16 * files + name_bytes > r.size:  # a folder's name has two bytes at least
        raise Fault("format_error", "table_bound")
    table = r.table(36, folders, kind, "truncated_folders")
    if int(table["count"].sum(dtype=np.int64)) != files:
        raise Fault("format_error", "folder_counts")
    # all tables lie together: a folder's name has at most 256 bytes with its length
    at = 36 + folders * kind.itemsize
    blob = r.at(at, min(folders * 256 + 16 * files + name_bytes, r.size - at), "truncated_folders")
    record = np.dtype([("hash", "<u8"), ("size", "<u4"), ("at", "<u4")])
    listed, names, seen_bytes, cursor = [], [], 0, 0
    for n_files, said in zip(table["count"].tolist(), table["at"].tolist(), strict=True):
        if said - name_bytes != at + cursor:
            raise Fault("format_error", "folder_block_offset")
        n = blob[cursor] if cursor < len(blob) else 0
        name = blob[cursor + 1 : cursor + 1 + n]
        if not n or len(name) < n or name[-1]:
            raise Fault("format_error", "folder_name")
        cursor += 1 + n
        if cursor + 16 * n_files > len(blob):
            raise Fault("format_error", "truncated_records")
        listed.append(np.frombuffer(blob, record, n_files, cursor))
        names.append(name[:-1])
        seen_bytes += n
        cursor += 16 * n_files
    if cursor + name_bytes > len(blob):
        raise Fault("format_error", "truncated_names")
    parts = blob[cursor : cursor + name_bytes].split(b"\0")
    if len(parts) - 1 < files:
        raise Fault("format_error", "file_names")
    file_names, end = parts[:files], at + cursor + name_bytes
    used = sum(map(len, file_names)) + files
    records = np.concatenate(listed) if listed else np.zeros(0, record)
    own = np.repeat(np.arange(folders), table["count"])
    folder_of = [names[i] for i in own.tolist()]
    flagged, place = records["size"].astype(np.int64), records["at"].astype(np.int64)
    size = flagged & ~0x40000000
    packed = ((flagged & 0x40000000) != 0) != bool(flags & 4)
    embedded = version > 103 and bool(flags & 0x100)
    readable = (place >= end) & (place <= r.size - size)
    skip, raw_size, bad = np.zeros(files, np.int64), np.where(packed, 0, size), np.zeros(files, bool)
    if embedded or packed.any():  # the few bytes before a payload, in the order of the file
        wanted = np.flatnonzero(readable & (packed | embedded))
        for i in wanted[np.argsort(place[wanted], kind="stable")].tolist():
            r.file.seek(int(place[i]))
            lead = r.file.read(260 if embedded else 4)
            own_skip = 1 + lead[0] if embedded and lead else int(embedded)
            need = own_skip + 4 * bool(packed[i])
            if need > size[i]:
                bad[i] = True
            else:
                skip[i] = own_skip
                raw_size[i] = struct.unpack_from("<I", lead, own_skip)[0] if packed[i] else size[i] - own_skip
    raw = [f + b"\\" + n if f not in (b"", b".") else n for f, n in zip(folder_of, file_names, strict=True)]
    head = {"family": "bsa", "variant": "tes4", "version": version, "archive_flags": flags, "file_count": files, "default_compression": codec, "trailing_names": used != name_bytes, "folder_names_mismatch": seen_bytes != folder_bytes}
    missing = ~readable & packed
    return head, files, {
        "raw_name": raw, "raw_folder": folder_of, "raw_file": file_names, "original_path": [*map(_text, raw)], "folder": [_text(names[i]) for i in own.tolist()], "file": [*map(_text, file_names)],
        "raw_size": pa.array(raw_size, pa.int64(), mask=missing | bad), "stored_size": size, "payload_offset": place, "data_offset": place + skip + np.where(packed & readable & ~bad, 4, 0), "archive_hash": _signed(records["hash"]),
        "folder_hash": _signed(table["hash"][own]), "compression": pa.DictionaryArray.from_arrays(pa.array(packed.astype(np.int8)), pa.array(["none", codec])).cast(pa.string()), "record_flags": flagged,
        "has_embedded_name": embedded, "embedded_name_prefix_size": skip, "metadata_end": end, "error": pa.array(np.where(bad, "format_error", ""), pa.string(), mask=~bad), "error_rule": pa.array(np.where(bad, "prefix", ""), pa.string(), mask=~bad),
    }


def _names16(r: _Reader, at: int, count: int) -> tuple[list[bytes], int]:
    """Names that follow each other, each after its length in two bytes; read in pieces."""
    out, piece, cursor = [], b"", 0
    for _ in range(count):
        if len(piece) - cursor < 2 + 65535 and at + len(piece) < r.size:
            at, piece, cursor = at + cursor, r.at(at + cursor, min(4 << 20, r.size - at - cursor), "truncated_names"), 0
        if cursor + 2 > len(piece):
            raise Fault("format_error", "truncated_names")
        n = piece[cursor] | piece[cursor + 1] << 8
        if cursor + 2 + n > len(piece):
            raise Fault("format_error", "truncated_names")
        out.append(piece[cursor + 2 : cursor + 2 + n])
        cursor += 2 + n
    return out, at + cursor


def _ba2(r: _Reader):
    _, version, subtype, count, names_at = struct.unpack("<4sI4sIQ", r.at(0, 24, "truncated_header"))
    if subtype not in (b"GNRL", b"DX10"):
        raise Fault("unsupported", "subtype")
    if version not in (1, 2, 3, 7, 8):
        raise Fault("unsupported", "version")
    head = {"family": "ba2", "variant": subtype.decode().lower(), "version": version, "archive_flags": 0, "file_count": count, "default_compression": "zlib"}
    at = 24
    if version in (2, 3):
        head["starfield_unknown1"], head["starfield_unknown2"] = struct.unpack("<II", r.at(24, 8, "truncated_header"))
        at = 32
    if version == 3:
        method = struct.unpack("<I", r.at(32, 4, "truncated_header"))[0]
        if method not in (0, 3):
            raise Fault("unsupported", "compression_method")
        head |= {"compression_method": method, "default_compression": "lz4_block" if method == 3 else "zlib"}
        at = 36
    if count > ENTRY_LIMIT:
        raise Fault("format_error", "entry_limit")
    end, columns = (_general if subtype == b"GNRL" else _textures)(r, at, count, head["default_compression"])
    if names_at < end or names_at > r.size:
        raise Fault("format_error", "name_table_place")
    names, names_end = _names16(r, names_at, count)
    return head, count, columns | {"raw_name": names, "original_path": [*map(_text, names)], "has_embedded_name": False, "embedded_name_prefix_size": 0, "metadata_end": end, "name_table_start": names_at, "name_table_end": names_end}


def _codec(packed: np.ndarray, codec: str) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array((packed != 0).astype(np.int8)), pa.array(["none", codec])).cast(pa.string())


def _general(r: _Reader, at: int, count: int, codec: str):
    kind = np.dtype([("name", "<u4"), ("ext", "V4"), ("dir", "<u4"), ("flags", "<u4"), ("at", "<u8"), ("packed", "<u4"), ("raw", "<u4"), ("end", "<u4")])
    table = r.table(at, count, kind, "truncated_records")
    if (table["end"] != SENTINEL).any():
        raise Fault("format_error", "sentinel")
    packed, size, place = table["packed"].astype(np.int64), table["raw"].astype(np.int64), _signed(table["at"])
    return at + count * kind.itemsize, {"raw_size": size, "stored_size": np.where(packed > 0, packed, size), "payload_offset": place, "data_offset": place, "archive_hash": table["name"].astype(np.int64), "folder_hash": table["dir"].astype(np.int64), "fourcc": [x.tobytes().decode("latin-1") for x in table["ext"]], "compression": _codec(packed, codec), "record_flags": table["flags"].astype(np.int64)}


def _textures(r: _Reader, at: int, count: int, codec: str):
    fixed, part = struct.Struct("<I4sIBBHHHBBH"), np.dtype([("at", "<u8"), ("packed", "<u4"), ("raw", "<u4"), ("first", "<u2"), ("last", "<u2"), ("end", "<u4")])
    records, tables, total, piece, cursor = [], [], 0, b"", 0
    for _ in range(count):
        if len(piece) - cursor < 24 + 24 * 255 and at + len(piece) < r.size:
            at, piece, cursor = at + cursor, r.at(at + cursor, min(4 << 20, r.size - at - cursor), "truncated_records"), 0
        if cursor + 24 > len(piece):
            raise Fault("format_error", "truncated_records")
        x = fixed.unpack_from(piece, cursor)
        n = x[4]
        if not n:
            raise Fault("format_error", "chunk_count")
        if x[5] != 24:
            raise Fault("format_error", "chunk_header_size")
        total += n
        if total > ENTRY_LIMIT:
            raise Fault("format_error", "chunk_limit")
        if cursor + 24 + 24 * n > len(piece):
            raise Fault("format_error", "truncated_chunks")
        chunks = np.frombuffer(piece, part, n, cursor + 24)
        if (chunks["end"] != SENTINEL).any():
            raise Fault("format_error", "sentinel")
        records.append(x)
        tables.append(chunks)
        cursor += 24 + 24 * n
    chunk = np.concatenate(tables) if tables else np.zeros(0, part)
    name, ext, folder, unknown, n, _, height, width, mips, fmt, cube = map(list, zip(*records, strict=True)) if records else ([],) * 11
    first = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    raw = chunk["raw"].astype(np.int64)
    stored, place = np.where(chunk["packed"] > 0, chunk["packed"], chunk["raw"]).astype(np.int64), _signed(chunk["at"])
    summed = lambda x, f: f.reduceat(x, first[:-1]) if count else x
    fields = {"payload_offset": pa.array(place), "stored_size": pa.array(stored), "raw_size": pa.array(raw), "start_mip": pa.array(chunk["first"].astype(np.int32)), "end_mip": pa.array(chunk["last"].astype(np.int32)), "compression": _codec(chunk["packed"], codec)}
    columns = {"raw_size": textures.HEADER + summed(raw, np.add), "stored_size": summed(stored, np.add), "payload_offset": summed(place, np.minimum), "archive_hash": name, "folder_hash": folder, "fourcc": [x.decode("latin-1") for x in ext], "compression": _codec(summed(chunk["packed"], np.maximum), codec), "record_flags": unknown}
    columns |= {"width": width, "height": height, "mip_count": mips, "dxgi_format": fmt, "cube_maps_raw": cube, "chunks": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))}
    return at + cursor, columns


def scan(file) -> tuple[dict, int, dict]:
    """The archive's own row, the number of its entries and their columns; a fault ends the scan and marks the archive."""
    r = _Reader(file)
    try:
        magic = r.at(0, 4, "truncated_header")
        reader = {b"BTDX": _ba2, b"BSA\0": _tes4, b"\x00\x01\x00\x00": _tes3}.get(magic)
        if reader is None:
            raise Fault("unsupported", "magic")
        head, count, columns = reader(r)
    except Fault as e:
        return {"kind": "archive", "size_bytes": r.size, "error": e.code, "error_rule": e.rule}, 0, {}
    same = {k: head[k] for k in ("family", "variant", "version")}
    return {"kind": "archive", "size_bytes": r.size, **head}, count, {"kind": "entry", "size_bytes": r.size, "record_index": np.arange(count), **same, **columns}


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


def _batches(archive_id: str, file, schema: pa.Schema, rows_each: int = 10_000):
    head, count, columns = scan(file)
    yield pa.RecordBatch.from_pylist([{"archive_id": archive_id, **head}], schema)
    columns["archive_id"] = archive_id

    def column(field: pa.Field) -> pa.Array:
        v = columns.get(field.name)
        if v is None:
            return pa.nulls(count, field.type)
        if isinstance(v, (str, int, bool)):
            return pa.repeat(pa.scalar(v, field.type), count)
        v = v if isinstance(v, pa.Array) else pa.array(v, None if isinstance(v, np.ndarray) else field.type)
        return v if v.type == field.type else v.cast(field.type)

    table = pa.Table.from_arrays([column(f) for f in schema], schema=schema)
    for batch in table.to_batches(rows_each):
        if batch.num_rows:
            yield batch


def archive_files(directory: str, suffixes: tuple[str, ...] = (".bsa", ".ba2")) -> list[str]:
    """Archives below a folder, by path."""
    return sorted(os.path.join(d, f) for d, _, names in os.walk(directory) for f in names if f.lower().endswith(suffixes))


def read_archives(spark: SparkSession, files: list[str], tasks: int | None = None) -> DataFrame:
    """Rows of archives on a mounted file system, one task a file unless ``tasks`` says fewer."""
    listed = spark.createDataFrame([(f,) for f in files], "archive_id string").repartition(tasks or max(len(files), 1))

    schema = _arrow_schema()

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as f:
                    yield from _batches(name, f, schema)

    return listed.mapInArrow(run, SCHEMA)


def read_archives_from_store(spark: SparkSession, path: str) -> DataFrame:
    """The same from any store that Spark reads, by whole files (under 2 GiB each)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    schema = _arrow_schema()

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(name, io.BytesIO(content.as_py()), schema)

    return files.mapInArrow(run, SCHEMA)


#: What a family, version and compression method mean: codec of compressed payloads, bytes of the header, of a record and
#: of a folder record, whether names may stand before payloads, whether writers compress unless told otherwise (fixed
#: values of the formats).
PROFILES = (
    ("tes3", 256, None, "none", 12, 8, None, False, False), ("tes4", 103, None, "zlib", 36, 16, 16, False, False), ("tes4", 104, None, "zlib", 36, 16, 16, True, True), ("tes4", 105, None, "lz4_frame", 36, 16, 24, True, True),
    ("gnrl", 1, None, "zlib", 24, 36, None, False, True), ("gnrl", 7, None, "zlib", 24, 36, None, False, True), ("gnrl", 8, None, "zlib", 24, 36, None, False, True), ("gnrl", 2, None, "zlib", 32, 36, None, False, True),
    ("gnrl", 3, 0, "zlib", 36, 36, None, False, True), ("gnrl", 3, 3, "lz4_block", 36, 36, None, False, True),
    ("dx10", 1, None, "zlib", 24, 24, None, False, True), ("dx10", 7, None, "zlib", 24, 24, None, False, True), ("dx10", 8, None, "zlib", 24, 24, None, False, True), ("dx10", 2, None, "zlib", 32, 24, None, False, True),
    ("dx10", 3, 0, "zlib", 36, 24, None, False, True), ("dx10", 3, 3, "lz4_block", 36, 24, None, False, True),
)


def profiles(spark: SparkSession) -> DataFrame:
    """Dimension table of PROFILES: a fixed number of rows."""
    return spark.createDataFrame(list(PROFILES), "variant string, version long, compression_method long, profile_codec string, header_bytes int, record_bytes int, folder_record_bytes int, embeds_names boolean, packs_by_default boolean")


def with_profile(a: DataFrame) -> DataFrame:
    """Archives with the facts of their profile; what no profile matches is ``unsupported`` unless it failed before."""
    p = profiles(a.sparkSession).withColumnsRenamed({"variant": "_v", "version": "_n", "compression_method": "_m"})
    found = a.join(F.broadcast(p), (a["variant"] == F.col("_v")) & (a["version"] == F.col("_n")) & a["compression_method"].eqNullSafe(F.col("_m")), "left")
    return found.withColumn("error", F.coalesce("error", F.when(F.col("_v").isNull(), "unsupported"))).drop("_v", "_n", "_m")


def archives(rows: DataFrame) -> DataFrame:
    keep = ["archive_id", "family", "variant", "version", "archive_flags", "file_count", "default_compression", "starfield_unknown1", "starfield_unknown2", "compression_method", "size_bytes", "trailing_names", "folder_names_mismatch", "error", "error_rule"]
    return rows.where("kind = 'archive'").select(*keep)


def entries(rows: DataFrame) -> DataFrame:
    """Entries with canonical and shown paths and texture facts."""
    e = rows.where("kind = 'entry'").withColumn("path", paths.canonical(F.col("original_path"))).withColumn("display_path", paths.display(F.col("original_path")))
    cube = F.col("cube_maps_raw") == textures.CUBE
    tops = F.size(F.filter("chunks", lambda c: c["start_mip"] == 0))
    size = F.greatest(F.when(cube, F.floor(tops / 6)).otherwise(tops), F.lit(1)).cast("int")
    return e.withColumn("is_cubemap", cube).withColumn("array_size", F.when(F.col("chunks").isNotNull(), size)).drop("kind")


#: Order in which a sequential reader looks: tables; then names of folders, spans of chunks; then records; then the
#: spans of the oldest family.
TABLES, FIRST, RECORDS, LAST = range(4)


def _span_rules(at: Column, size: Column) -> list[tuple[str, str, Column]]:
    """Rules of a stored span, in order. Empty spans lie anywhere in the file."""
    end = F.col("metadata_end")
    return [
        ("span_outside", "format_error", ~span_fits(at, size, F.col("size_bytes"))),
        ("span_in_tables", "format_error", (size > 0) & (at < end)),
        ("span_in_names", "format_error", spans_overlap(at, size, F.col("name_table_start"), F.col("name_table_end") - F.col("name_table_start"))),
    ]


def _raised(found: DataFrame, phase: int, index: Column, rank: int, rule: Column) -> DataFrame:
    return found.select("archive_id", F.lit(phase).alias("phase"), index.cast("long").alias("record_index"), F.lit(rank).alias("rule_rank"), F.lit("format_error").alias("code"), rule.alias("rule"))


def checked(rows: DataFrame) -> DataFrame:
    """Violations of all archives: (archive_id, phase, record_index, rule_rank, code, rule). Valid archives have none.

    The least (phase, record_index, rule_rank) of an archive is what a sequential reader of its family meets first:

    * oldest family: record by record unsorted, duplicate and wrong hash, invalid and duplicate path, span outside;
      overlaps after all records;
    * record tables: hashes of folders first, then record by record path, duplicate, hash, span outside, in the tables,
      damaged prefix, overlap;
    * general: record by record path, duplicate, span outside, in the tables, in the names, overlap;
    * textures: chunk by chunk sizes, span outside, in the tables, in the names, overlap (``record_index`` counts 256 a
      record there); then record by record path, duplicate, order and sizes of its chunks.

    An overlap counts at the later of two records whose spans are neighbours, or of which one spans the other."""
    a, e = archives(rows), entries(rows)
    faults = a.where("error is not null").select("archive_id", F.lit(TABLES).alias("phase"), F.lit(-1).cast("long").alias("record_index"), F.lit(0).alias("rule_rank"), F.col("error").alias("code"), F.col("error_rule").alias("rule"))
    variant = F.col("variant")
    tes3, tes4, plain = variant == "tes3", variant == "tes4", F.col("chunks").isNull()
    # names as stored: each byte a character
    file, folder = F.decode("raw_file", "ISO-8859-1"), F.decode("raw_folder", "ISO-8859-1")
    wrong = F.when(tes3, F.col("archive_hash") != hashes.hash_tes3(F.decode("raw_name", "ISO-8859-1"), "ISO-8859-1")).when(tes4, F.col("archive_hash") != hashes.hash_tes4(paths.stem(file), paths.extension(file), "ISO-8859-1"))
    folder_wrong = tes4 & (F.col("folder_hash") != hashes.hash_tes4(F.translate(folder, "/", "\\"), F.lit(""), "ISO-8859-1"))
    invalid = F.col("path").isNull()
    # ranks leave room for what needs other rows: 3 duplicate path, 10 overlap
    outside, in_tables, in_names = ((n, c, plain & x) for n, c, x in _span_rules(F.col("payload_offset"), F.col("stored_size")))
    e = e.join(F.broadcast(textures.formats(e.sparkSession)), "dxgi_format", "left")
    fault = F.when(F.col("block_bytes").isNull(), "format").otherwise(textures.layout_error(F.col("chunks"), F.col("width"), F.col("height"), F.col("mip_count"), F.col("is_cubemap"), F.col("block_bytes"), F.col("block_side")))
    never = F.lit(False)
    rules = [
        ("unsorted_hash", "format_error", never),
        ("hash_mismatch", "format_error", tes3 & wrong),
        ("invalid_path", "invalid_argument", invalid & tes4),  # this family passes on the code of the path itself
        ("invalid_path", "format_error", invalid & ~tes4),
        ("duplicate_path", "format_error", never),
        ("hash_mismatch", "format_error", tes4 & wrong),
        outside,
        in_tables,
        in_names,
        ("payload_prefix", "format_error", F.col("error").isNotNull()),
        ("texture_format", "format_error", ~plain & (fault == "format")),
        ("chunk_sequence", "format_error", ~plain & fault.isNotNull() & ~fault.isin("format", "size")),
        ("chunk_size", "format_error", ~plain & (fault == "size")),
    ]
    records = validation.violations(e, ["archive_id"], "record_index", rules, phase=RECORDS)
    folders = _raised(e.where(folder_wrong), FIRST, F.lit(-1), 0, F.lit("folder_hash_mismatch"))
    chunks = e.where(~plain).select("archive_id", "variant", "size_bytes", "metadata_end", "name_table_start", "name_table_end", "record_index", F.posexplode("chunks").alias("nth", "c"))
    chunks = chunks.withColumn("record_index", F.col("record_index") * 256 + F.col("nth")).withColumn("at", F.col("c.payload_offset")).withColumn("size", F.col("c.stored_size"))
    parts = validation.violations(chunks, ["archive_id"], "record_index", [("chunk_empty", "format_error", (F.col("size") == 0) | (F.col("c.raw_size") == 0)), *_span_rules(F.col("at"), F.col("size"))], phase=FIRST)
    named = e.where("path is not null")
    least = named.groupBy("archive_id", "path").agg(F.min("record_index").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    twice = _raised(named.join(least, ["archive_id", "path"]).where("record_index > _first"), RECORDS, F.col("record_index"), 4, F.lit("duplicate_path"))
    t3 = e.where(tes3).withColumn("hash_key", F.lpad(F.hex("archive_hash"), 16, "0"))
    order = spans.record_order(t3, "archive_id", "record_index", "hash_key")
    order = _raised(order, RECORDS, F.col("record_index"), -1, F.concat(F.col("problem"), F.lit("_hash")))
    span = e.where(plain & ~tes3).select("archive_id", "record_index", F.col("payload_offset").alias("at"), F.col("stored_size").alias("size"))
    over = _raised(spans.clashes(span, "archive_id", "at", "size", "record_index"), RECORDS, F.col("record_index"), 20, F.lit("payload_overlap"))
    over_parts = _raised(spans.clashes(chunks, "archive_id", "at", "size", "record_index"), FIRST, F.col("record_index"), 20, F.lit("payload_overlap"))
    late = spans.overlaps(e.where(tes3), "archive_id", "payload_offset", "stored_size", allow_equal=False)
    late = _raised(late, LAST, F.col("start"), 0, F.lit("payload_overlap"))
    out = faults
    for found in (records, folders, parts, twice, order, over, over_parts, late):
        out = out.unionByName(found)
    return out


def identity_mismatch(e: DataFrame) -> DataFrame:
    """Entries of BA2 archives with whether the record's identity differs from that of its path: a warning only."""
    want = hashes.ba2_identity(F.col("path"))
    odd = (want["name_hash"] != F.col("archive_hash")) | (want["directory_hash"] != F.col("folder_hash")) | (want["fourcc"] != paths.ascii_lower(F.col("fourcc")))
    return e.withColumn("record_identity_mismatch", F.when(F.col("family") == "ba2", F.coalesce(odd, F.lit(True))).otherwise(False))
