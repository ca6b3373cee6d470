"""New archives, planned as DataFrames and written as files.

A plan is a frame of segments ``(archive_id, offset, data)``: header, records, names and payloads, each built by column
expressions at an offset that placement computed. Writing streams the segments of an archive in order to a temporary
file beside the target and publishes it at the end."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dds

from ..functions import codecs, hashes, paths
from ..functions.numbers import encode_little_endian as le
from ..operators import placement, textures
from ..operators.spans import duplicates
from ..session import written

#: Target formats: token -> (family, version, codec of compressed payloads). The tokens are kept as users know them; the
#: rest are fixed values of the formats.
TARGETS = {
    "bsa-tes3": ("tes3", 256, "none"), "bsa-oblivion": ("tes4", 103, "zlib"), "bsa-fo3": ("tes4", 104, "zlib"), "bsa-sse": ("tes4", 105, "lz4_frame"),
    "ba2-gnrl-fo4": ("gnrl", 1, "zlib"), "ba2-gnrl-sf-v2": ("gnrl", 2, "zlib"), "ba2-gnrl-sf-v3": ("gnrl", 3, "lz4_block"),
    "ba2-dx10-fo4": ("dx10", 1, "zlib"), "ba2-dx10-sf-v2": ("dx10", 2, "zlib"), "ba2-dx10-sf-v3": ("dx10", 3, "lz4_block"),
}


def file_classes(version: int) -> dict[str, int]:
    """File-class bits of the record-table family by extension (fixed values of the format)."""
    out = {".nif": 1, ".kf": 1, ".dds": 2, ".wav": 4, ".pex": 8, ".psc": 8}
    if version == 103:
        out[".xml"] = 16
    if version != 105:
        out |= dict.fromkeys((".txt", ".html", ".bat", ".scc"), 256)
    return out


#: What an archive does with entries that don't say: as the target is used to, compress none, compress all.
POLICIES = ("default", "raw", "compressed")
#: Bits of the record-table family: packed unless a record says otherwise, names before payloads, a record's say
#: otherwise (fixed values of the format).
PACKED, EMBEDDED, TOGGLE = 0x4, 0x100, 0x40000000


def packs_by_default(target: str, policy: str = "default") -> bool:
    """Whether entries that don't say are compressed: general archives and all but the first record tables do so."""
    if policy not in POLICIES:
        raise ValueError(f"policy: one of {', '.join(POLICIES)}")
    family, version, codec = TARGETS[target]
    return codec != "none" and (policy == "compressed" or policy == "default" and not (family == "tes4" and version == 103))


def problems(entries: DataFrame, target: str | None = None, embed: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """archive_id, code, rule: what makes an archive's entries unfit to write; an archive of ``wanted(archive_id)`` that
    has none is unfit too.

    Record tables take names of 255 bytes at most, and of textures whose header can be read only the formats that
    games of that version draw."""
    e = entries.withColumn("_c", paths.canonical(F.col("path")))
    said = lambda rows, code, rule: rows.select("archive_id", F.lit(code).alias("code"), F.lit(rule).alias("rule"))
    found = said(e.where("_c is null"), "invalid_argument", "invalid_path")
    found = found.unionByName(said(duplicates(e.where("_c is not null"), "archive_id", "_c"), "invalid_argument", "duplicate_path"))
    found = found.unionByName(said(e.where(F.octet_length("payload") >= 1 << 30), "invalid_argument", "too_large"))
    if wanted is not None:
        found = found.unionByName(said(wanted.join(e.select("archive_id").distinct(), "archive_id", "left_anti"), "invalid_argument", "empty"))
    if target and TARGETS[target][0] == "tes4":
        version = TARGETS[target][1]
        whole = F.octet_length("_c") + F.when(paths.folder_of(F.col("_c")) == "", 2).otherwise(0)
        long = (F.octet_length(paths.folder_of(F.col("_c"))) > 254) | (F.octet_length(paths.file_of(F.col("_c"))) > 255)
        found = found.unionByName(said(e.where(long | (whole > 255 if embed and version > 103 else F.lit(False))), "format_error", "name_too_long"))
        textures = e.where(paths.extension(F.col("_c")) == ".dds").select("archive_id", "path", F.col("payload").alias("content"))
        odd = dds.rejected_as_records(textures, version).join(dds.facts(textures).where("error is null").select("archive_id", "path"), ["archive_id", "path"], "left_semi")
        found = found.unionByName(said(odd, "format_error", "texture_format"))
    return found.distinct()


def _ordered(entries: DataFrame, *order: Column) -> DataFrame:
    """Adds ``ord`` from 0 within each archive; payloads don't take part in the sort.

    Keys are range-partitioned by archive and order, so an archive spreads over tasks; a row's number is its place in
    its partition after what the archive has in the partitions before, of which there are few."""
    names = [f"_k{i}" for i in range(len(order))]
    keys = entries.select("archive_id", "canonical", *(c.alias(n) for c, n in zip(order, names, strict=True)))
    keys = keys.repartitionByRange("archive_id", *names).sortWithinPartitions("archive_id", *names)
    keys = written(keys.select("archive_id", "canonical", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)), "order")
    parts = keys.groupBy("archive_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("archive_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("archive_id", "_part", (before - F.col("_first")).alias("_shift"))
    numbered = keys.join(parts, ["archive_id", "_part"]).select("archive_id", "canonical", (F.col("_at") + F.col("_shift")).cast("long").alias("ord"))
    return entries.join(numbered, ["archive_id", "canonical"])


def _prepared(entries: DataFrame, codec: str, packs: bool) -> DataFrame:
    """Canonical path, stored bytes and codec of each entry; ``compress`` says whether one is compressed, else (null or
    no such column) ``packs`` does. Empty payloads are stored as they are."""
    e = entries.withColumn("canonical", paths.canonical(F.col("path"))).withColumn("payload", F.coalesce("payload", F.lit(b"")))
    e = e.withColumn("raw_size", F.octet_length("payload").cast("long"))
    if codec == "none" or not packs and "compress" not in entries.columns:
        return e.withColumn("codec", F.lit("none")).withColumnRenamed("payload", "stored")
    wanted = F.coalesce(F.col("compress") if "compress" in entries.columns else F.lit(None).cast("boolean"), F.lit(packs))
    e = e.withColumn("codec", F.when(wanted & (F.col("raw_size") > 0), codec).otherwise("none"))
    return e.withColumn("stored", codecs.encoded(F.col("codec"), F.col("payload"))).drop("payload")


def _segment(df: DataFrame, offset, data: Column) -> DataFrame:
    return df.select("archive_id", (offset if isinstance(offset, Column) else F.col(offset)).cast("long").alias("offset"), data.alias("data"))


def gnrl_segments(entries: DataFrame, target: str = "ba2-gnrl-fo4", share: bool = True, policy: str = "default") -> DataFrame:
    """``entries(archive_id, path, payload[, compress, record_flags])`` as a general BA2 archive each."""
    _, version, codec = TARGETS[target]
    flags = F.coalesce(F.col("record_flags").cast("long") if "record_flags" in entries.columns else F.lit(None).cast("long"), F.lit(0x00100100).cast("long"))
    e = _prepared(entries.withColumn("record_flags", flags), codec, packs_by_default(target, policy))
    e = written(_ordered(written(e, "prepared"), F.col("canonical")), "ordered")
    lead = {1: 24, 2: 32, 3: 36}[version]
    counts = e.groupBy("archive_id").agg(F.count("*").alias("n"))
    placed = placement.place(e, "archive_id", "ord", "stored", ("codec", "raw_size"), share=share).join(counts, "archive_id")
    placed = written(placed.withColumn("at", F.col("offset") + lead + 36 * F.col("n")), "placed")
    ident = hashes.ba2_identity(F.col("canonical"))
    packed = F.when(F.col("codec") == "none", 0).otherwise(F.col("size")).cast("long")
    record = F.concat(le(ident["name_hash"], 4), F.encode(ident["fourcc"], "ISO-8859-1"), le(ident["directory_hash"], 4), le(F.col("record_flags"), 4), le(F.col("at"), 8), le(packed, 4), le(F.col("raw_size"), 4), le(F.lit(0xBAADF00D), 4))
    records = _segment(placed, F.lit(lead) + 36 * F.col("ord"), record)
    payloads = _segment(placed.where("not shared and size > 0"), "at", F.col("stored"))
    end = placement.stored_bytes(placed, "archive_id").join(counts, "archive_id").withColumn("names_at", F.col("next_offset") + lead + 36 * F.col("n"))
    names = placed.select("archive_id", "ord", F.encode("canonical", "UTF-8").alias("name")).withColumn("bytes", F.octet_length("name") + 2)
    names = placement.running_offset(names, "archive_id", "ord", "bytes").join(end.select("archive_id", "names_at"), "archive_id")
    names = _segment(names, F.col("names_at") + F.col("offset"), F.concat(le(F.octet_length("name").cast("long"), 2), F.col("name")))
    head = [F.lit(b"BTDX"), le(F.lit(version), 4), F.lit(b"GNRL"), le(F.col("n"), 4), le(F.col("names_at"), 8)]
    head += [le(F.lit(1), 4), le(F.lit(0), 4)] if version > 1 else []
    head += [le(F.lit(3), 4)] if version == 3 else []
    return _segment(end, F.lit(0), F.concat(*head)).unionByName(records).unionByName(payloads).unionByName(names)


def tes3_segments(entries: DataFrame) -> DataFrame:
    """The oldest family: records by unsigned hash, nothing compressed, nothing shared."""
    e = _prepared(entries, "none", False).withColumn("name", paths.display(F.col("canonical")))
    e = written(e.withColumn("hash", hashes.hash_tes3(F.col("name"))), "prepared")
    e = _ordered(e, *hashes.unsigned_order(F.col("hash")), F.col("canonical"))
    e = written(e.withColumn("name", F.encode("name", "UTF-8")).withColumn("name_bytes", F.octet_length("name") + 1), "ordered")
    total = e.groupBy("archive_id").agg(F.count("*").alias("n"), F.sum("name_bytes").alias("names"))
    placed = placement.place(e, "archive_id", "ord", "stored", share=False).withColumnRenamed("offset", "at")
    placed = written(placement.running_offset(placed, "archive_id", "ord", "name_bytes", "name_at").join(total, "archive_id"), "placed")
    n, i = F.col("n"), F.col("ord")
    head = _segment(total, F.lit(0), F.concat(le(F.lit(0x100), 4), le(12 * n + F.col("names"), 4), le(n, 4)))
    parts = [
        _segment(placed, 12 + 8 * i, F.concat(le(F.col("size"), 4), le(F.col("at"), 4))),
        _segment(placed, 12 + 8 * n + 4 * i, le(F.col("name_at"), 4)),
        _segment(placed, 12 + 12 * n + F.col("name_at"), F.concat(F.col("name"), F.lit(b"\0"))),
        _segment(placed, 12 + 12 * n + F.col("names") + 8 * i, F.concat(le(hashes.high32(F.col("hash")), 4), le(hashes.low32(F.col("hash")), 4))),
        _segment(placed.where("size > 0"), 12 + 20 * n + F.col("names") + F.col("at"), F.col("stored")),
    ]
    for p in parts:
        head = head.unionByName(p)
    return head


def tes4_segments(entries: DataFrame, target: str = "bsa-sse", share: bool = True, policy: str = "default", embed: bool = False) -> DataFrame:
    """The record-table family: folders by hash, files by hash within a folder. ``embed`` puts each name before its
    payload, where the version knows that; equal payloads then differ and aren't shared."""
    _, version, codec = TARGETS[target]
    packs, embed = packs_by_default(target, policy), embed and version > 103
    width = 24 if version == 105 else 16
    e = _prepared(entries, codec, packs).withColumn("folder", F.when(paths.folder_of(F.col("canonical")) == "", ".").otherwise(paths.display(paths.folder_of(F.col("canonical"))))).withColumn("file", paths.file_of(F.col("canonical")))
    e = e.withColumn("folder_hash", hashes.hash_tes4(F.col("folder"), F.lit(""))).withColumn("hash", hashes.hash_tes4(paths.stem(F.col("file")), paths.extension(F.col("file"))))
    e = e.withColumn("stored", F.when(F.col("codec") != "none", F.concat(le(F.col("raw_size"), 4), F.col("stored"))).otherwise(F.col("stored")))
    if embed:
        name = F.encode(F.concat("folder", F.lit("\\"), "file"), "UTF-8")
        e = e.withColumn("stored", F.concat(le(F.octet_length(name).cast("long"), 1), name, F.col("stored")))
    e = written(e, "prepared")
    e = _ordered(e, *hashes.unsigned_order(F.col("folder_hash")), F.col("folder"), *hashes.unsigned_order(F.col("hash")), F.col("canonical"))
    e = written(e.withColumn("name", F.concat(F.encode("file", "UTF-8"), F.lit(b"\0"))).withColumn("name_bytes", F.octet_length("name")), "ordered")
    f = e.groupBy("archive_id", "folder", "folder_hash").agg(F.count("*").alias("files"), F.min("ord").alias("first")).withColumn("folder_name", F.concat(F.encode("folder", "UTF-8"), F.lit(b"\0"))).withColumn("folder_bytes", F.octet_length("folder_name"))
    f = f.withColumn("block", F.lit(1) + F.col("folder_bytes") + 16 * F.col("files")).withColumn("one", F.lit(1))
    f = placement.running_offset(f, "archive_id", "first", "block", "block_at")
    f = written(placement.running_offset(f, "archive_id", "first", "one", "k"), "folders")
    bit = F.lit(0)
    for ext, b in file_classes(version).items():
        bit = F.when(paths.extension(F.col("file")) == ext, b).otherwise(bit)
    total = e.groupBy("archive_id").agg(F.count("*").alias("n"), F.sum("name_bytes").alias("names"), F.bit_or(bit).cast("long").alias("classes"))
    total = total.join(f.groupBy("archive_id").agg(F.count("*").alias("folders"), F.sum("folder_bytes").alias("folder_names"), F.sum("block").alias("blocks")), "archive_id")
    total = written(total, "totals")
    tables = F.lit(36) + width * F.col("folders")
    data_at = tables + F.col("blocks") + F.col("names")
    flags = F.lit(0x3 | PACKED * packs | EMBEDDED * embed)
    head = _segment(total, F.lit(0), F.concat(F.lit(b"BSA\0"), *(le(x.cast("long"), 4) for x in (F.lit(version), F.lit(36), flags, F.col("folders"), F.col("n"), F.col("folder_names"), F.col("names"), F.col("classes")))))
    placed = placement.place(e, "archive_id", "ord", "stored", ("codec", "raw_size"), share=share).withColumnRenamed("offset", "at")
    placed = written(placement.running_offset(placed, "archive_id", "ord", "name_bytes", "name_at").join(total, "archive_id").join(f.select("archive_id", "folder", "block_at", "folder_bytes", "first"), ["archive_id", "folder"]), "placed")
    f = f.join(total, "archive_id")
    stored_at = tables + F.col("block_at") + F.col("names")  # the format adds the length of the file names
    record = [le(F.col("folder_hash"), 8), le(F.col("files"), 4), *([le(F.lit(0), 4), le(stored_at, 8)] if version == 105 else [le(stored_at, 4)])]
    size = F.when((F.col("codec") != "none") != F.lit(packs), F.col("size").bitwiseOR(F.lit(TOGGLE).cast("long"))).otherwise(F.col("size"))
    parts = [
        _segment(f, F.lit(36) + width * F.col("k"), F.concat(*record)),
        _segment(f, tables + F.col("block_at"), F.concat(le(F.col("folder_bytes").cast("long"), 1), F.col("folder_name"))),
        _segment(placed, tables + F.col("block_at") + 1 + F.col("folder_bytes") + 16 * (F.col("ord") - F.col("first")), F.concat(le(F.col("hash"), 8), le(size, 4), le(data_at + F.col("at"), 4))),
        _segment(placed, tables + F.col("blocks") + F.col("name_at"), F.col("name")),
        _segment(placed.where("not shared and size > 0"), data_at + F.col("at"), F.col("stored")),
    ]
    for p in parts:
        head = head.unionByName(p)
    return head


def dx10_segments(chunks: DataFrame, target: str = "ba2-dx10-fo4", share: bool = True) -> DataFrame:
    """Texture archives from ``chunks(archive_id, path, nth, start_mip, end_mip, payload, width, height, mip_count,
    dxgi_format, is_cubemap)``; every chunk is compressed, equal chunks of equal facts are stored once."""
    _, version, codec = TARGETS[target]
    lead = {1: 24, 2: 32, 3: 36}[version]
    c = chunks.withColumn("canonical", paths.canonical(F.col("path"))).withColumn("raw_size", F.octet_length("payload").cast("long")).withColumn("stored", codecs.encoded(F.lit(codec), F.col("payload"))).drop("payload")
    c = written(c, "prepared")
    t = c.groupBy("archive_id", "canonical").agg(F.count("*").alias("chunks"), *(F.first(x).alias(x) for x in ("width", "height", "mip_count", "dxgi_format", "is_cubemap")))
    t = _ordered(t, F.col("canonical")).withColumn("bytes", 24 + 24 * F.col("chunks"))
    t = placement.running_offset(t, "archive_id", "ord", "bytes", "record_at")
    t = written(placement.running_offset(t, "archive_id", "ord", "chunks", "chunk_base"), "textures")
    total = t.groupBy("archive_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("tables"))
    c = c.join(t.select("archive_id", "canonical", "record_at", "chunk_base"), ["archive_id", "canonical"]).withColumn("chunk_ord", F.col("chunk_base") + F.col("nth"))
    placed = placement.place(c, "archive_id", "chunk_ord", "stored", ("raw_size",), share=share).join(total, "archive_id").withColumn("at", F.col("offset") + lead + F.col("tables"))
    placed = written(placed, "placed")
    ident = hashes.ba2_identity(F.col("canonical"))
    num = lambda x, w: le(F.col(x).cast("long"), w)
    record = F.concat(le(ident["name_hash"], 4), F.encode(ident["fourcc"], "ISO-8859-1"), le(ident["directory_hash"], 4), le(F.lit(0), 1), num("chunks", 1), le(F.lit(24), 2), num("height", 2), num("width", 2), num("mip_count", 1), num("dxgi_format", 1), le(F.when(F.col("is_cubemap"), textures.CUBE).otherwise(textures.FLAT).cast("long"), 2))
    chunk = F.concat(le(F.col("at"), 8), num("size", 4), num("raw_size", 4), num("start_mip", 2), num("end_mip", 2), le(F.lit(0xBAADF00D), 4))
    end = placement.stored_bytes(placed, "archive_id").join(total, "archive_id").withColumn("names_at", F.col("next_offset") + lead + F.col("tables"))
    names = t.select("archive_id", "ord", F.encode("canonical", "UTF-8").alias("name")).withColumn("bytes", F.octet_length("name") + 2)
    names = placement.running_offset(names, "archive_id", "ord", "bytes").join(end.select("archive_id", "names_at"), "archive_id")
    head = [F.lit(b"BTDX"), le(F.lit(version), 4), F.lit(b"DX10"), le(F.col("n"), 4), le(F.col("names_at"), 8)]
    head += [le(F.lit(1), 4), le(F.lit(0), 4)] if version > 1 else []
    head += [le(F.lit(3), 4)] if version == 3 else []
    out = _segment(end, F.lit(0), F.concat(*head))
    for part in (
        _segment(t, F.lit(lead) + F.col("record_at"), record),
        _segment(placed, F.lit(lead) + F.col("record_at") + 24 + 24 * F.col("nth"), chunk),
        _segment(placed.where("not shared"), "at", F.col("stored")),
        _segment(names, F.col("names_at") + F.col("offset"), F.concat(le(F.octet_length("name").cast("long"), 2), F.col("name"))),
    ):
        out = out.unionByName(part)
    return out


def segments(entries: DataFrame, target: str, share: bool = True, policy: str = "default", embed: bool = False) -> DataFrame:
    """Plan of one archive for each ``archive_id``; textures are given as chunks (``dds.chunks``) and always compressed."""
    family = TARGETS[target][0]
    if family == "tes3":
        return tes3_segments(entries)
    if family == "dx10":
        return dx10_segments(entries, target, share)
    return tes4_segments(entries, target, share, policy, embed) if family == "tes4" else gnrl_segments(entries, target, share, policy)


def write(plan: DataFrame, directory: str, suffix: str, overwrite: bool = False) -> DataFrame:
    """Streams each archive's segments in order to ``directory/archive_id + suffix`` on a mounted file system; one row
    an archive: path, bytes, failure. An existing file stays unless ``overwrite``; a failed write leaves nothing."""

    def run(batches):
        import pyarrow as pa

        done, current = [], None

        def close(state, failure=None):
            name, f, temp, size = state
            target = os.path.join(directory, name + suffix)
            f.close()
            try:
                if failure is None and overwrite:
                    os.replace(temp, target)
                elif failure is None:
                    os.link(temp, target)
            except FileExistsError:
                failure = "exists"
            except OSError:
                failure = "io_error"
            if os.path.exists(temp):
                os.unlink(temp)
            done.append({"archive_id": name, "path": target, "bytes": size, "failure": failure})

        try:
            for batch in batches:
                for name, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if current is None or current[0] != name:
                        if current:
                            close(current)
                        temp = os.path.join(directory, f".{name}.{uuid.uuid4().hex}")
                        current = [name, open(temp, "wb"), temp, 0]
                    if offset != current[3]:
                        raise ValueError(f"{name}: segment at {offset}, file at {current[3]}")
                    current[1].write(data)
                    current[3] += len(data)
            if current:
                close(current)
                current = None
        finally:
            if current:
                current[1].close()
                os.unlink(current[2])
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("failure", pa.string())]))

    os.makedirs(directory, exist_ok=True)
    in_order = plan.where(F.octet_length("data") > 0).select("archive_id", "offset", "data").repartition("archive_id").sortWithinPartitions("archive_id", "offset")
    return in_order.mapInArrow(run, "archive_id string, path string, bytes long, failure string")
