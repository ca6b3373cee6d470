"""Queries of the catalog operators over the driver's tables, each with SQL for the same rows.

The tables hold no archives, so other columns stand in: payloads are document texts, spans are line items, paths are
urls without their scheme, chunks are the lines of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes, numbers, paths
from ..operators import catalog, compare, placement, spans, textures, validation
from ..sources import writers


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _url_paths(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


_URL = "SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\\', 'abcdefghijklmnopqrstuvwxyz/')"
_BAD = "(len(list_filter(string_split(" + _LOW + ", '/'), lambda s: s IN ('', '.', '..'))) > 0 OR regexp_matches({0}, '^[A-Za-z]:'))"
_CANON = "CASE WHEN NOT " + _BAD + " THEN " + _LOW + " END"


# -- paths and names ----------------------------------------------------------------------------------------------
def path_normalize(spark, d):
    p = F.col("path")
    return _url_paths(spark, d).select("page_id", paths.canonical(p).alias("canonical"), paths.path_error(p).alias("error"))


PATH_NORMALIZE = f"SELECT page_id, {_CANON.format('path')} AS canonical, CASE WHEN {_BAD.format('path')} THEN 'invalid_argument' END AS error FROM ({_URL})"


def path_parts(spark, d):
    p = F.col("path")
    return _url_paths(spark, d).select("page_id", paths.folder_of(p).alias("folder"), paths.file_of(p).alias("file"), paths.extension(p).alias("extension"), paths.stem(p).alias("stem"), paths.display(p).alias("shown"))


PATH_PARTS = rf"""
SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '' END AS folder, string_split(path, '/')[-1] AS file,
       lower(regexp_extract(string_split(path, '/')[-1], '(\.[^.]*)$', 1)) AS extension, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS stem,
       replace(path, '/', '\') AS shown
FROM ({_URL})"""


def destination_safety(spark, d):
    p = F.col("path")
    return _url_paths(spark, d).select("page_id", paths.is_safe_destination(p).alias("safe"), paths.is_sound(p).alias("sound"))


DESTINATION_SAFETY = rf"""
SELECT page_id, len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..') OR contains(s, ':') OR ends_with(s, '.') OR ends_with(s, ' ')
         OR lower(rtrim(regexp_extract(s, '^([^.]*)', 1))) IN ({', '.join(repr(x) for x in paths.DEVICES)}) OR regexp_matches(s, '[\x00-\x1f<>"|?*]'))) = 0 AS safe,
       (starts_with(lower(path), 'sound/') OR regexp_matches(lower(path), '\.(wav|xwm|fuz)$')) AS sound
FROM ({_URL})"""


def name_hashes(spark, d):
    """Hash halves of part names; names and types stand in for stems, folders and extensions."""
    n = F.col("p_name")
    t4 = hashes.hash_tes4(n, F.lit(".nif"))
    t3 = hashes.hash_tes3(n)
    return _t(spark, d, "part").select("p_partkey", hashes.high32(t4).alias("t4_high"), hashes.low32(t4).alias("t4_low"), hashes.high32(t3).alias("t3_high"), hashes.low32(t3).alias("t3_low"), hashes.hash_fo4(n).alias("fo4"), hashes.extension_magic(F.lit(".dds")).alias("magic"))


_M = 4294967295
NAME_HASHES = f"""
WITH b AS (SELECT p_partkey, [ascii(x)::BIGINT FOR x IN string_split(lower(p_name), '')] AS s FROM part),
h AS (SELECT p_partkey, s, len(s) AS n, len(s) // 2 AS half FROM b),
f AS (SELECT p_partkey, s, n, half,
  list_reduce(list_prepend(0::BIGINT, s[2:n - 2]), lambda a, x: (a * 65599 + x) & {_M}) AS mid,
  list_reduce(list_prepend(0::BIGINT, [46, 110, 105, 102]), lambda a, x: (a * 65599 + x) & {_M}) AS ext,
  list_reduce(list_prepend(0::BIGINT, [(s[i] << (8 * ((i - 1) % 4))) & {_M} FOR i IN range(1, half + 1)]), lambda a, x: xor(a, x)) AS t3h,
  list_reduce(list_prepend(0::BIGINT, [(s[i] << (8 * ((i - 1 - half) % 4))) & {_M} FOR i IN range(half + 1, n + 1)]),
    lambda a, x: ((xor(a, x) >> (x & 31)) | ((xor(a, x)::HUGEINT << (32 - (x & 31))::INT) & {_M})::BIGINT)) AS t3l,
  list_reduce(list_prepend(0::BIGINT, [x FOR x IN s IF x <= 127]), lambda a, x: xor(a >> 8,
    list_reduce(list_prepend(xor(a, x) & 255, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, {0xEDB88320}) ELSE v >> 1 END))) AS fo4
FROM h)
SELECT p_partkey, ((mid + ext) & {_M})::BIGINT AS t4_high,
       (s[n] | CASE WHEN n > 2 THEN s[n - 1] << 8 ELSE 0 END | ((n << 16) & {_M}) | (s[1] << 24) | 32768)::BIGINT AS t4_low,
       t3h::BIGINT AS t3_high, t3l::BIGINT AS t3_low, fo4::BIGINT AS fo4, {0x7364642E}::BIGINT AS magic FROM f"""


def numbers_round_trip(spark, d):
    """Order keys as little-endian bytes and back, and checked sums."""
    k = F.col("o_orderkey")
    e = numbers.encode_little_endian(k, 4)
    return _t(spark, d, "orders").select("o_orderkey", F.hex(e).alias("bytes_hex"), numbers.little_endian(e, 0, 4).alias("decoded"), numbers.span_fits(k, F.col("o_custkey"), F.lit(10_000)).alias("fits"))


NUMBERS = """
SELECT o_orderkey, printf('%02X%02X%02X%02X', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 24) & 255) AS bytes_hex,
       o_orderkey AS decoded, (o_orderkey <= 10000 AND o_custkey <= 10000 - o_orderkey) AS fits FROM orders"""


# -- placement ----------------------------------------------------------------------------------------------------
def _placed(spark, d, **how):
    docs = _t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return placement.place(docs, "lang", "doc_id", "text", **how).select("lang", "doc_id", "size", "rep", "offset", "shared")


def placement_shared(spark, d):
    return _placed(spark, d)


def placement_unshared(spark, d):
    return _placed(spark, d, share=False, base=36)


def placement_constrained(spark, d):
    return _placed(spark, d, facts=("source",), base=24)


def _placement_sql(key: str, base: int) -> str:
    return f"""
WITH r AS (SELECT lang, doc_id, strlen(text)::BIGINT AS size, min(doc_id) OVER (PARTITION BY {key}) AS rep FROM documents),
s AS (SELECT lang, rep, ({base} + coalesce(sum(size) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM r WHERE rep = doc_id)
SELECT r.lang, doc_id, size, r.rep, s."offset", rep <> doc_id AS shared FROM r JOIN s USING (lang, rep)"""


def placement_next_offset(spark, d):
    return placement.stored_bytes(_placed(spark, d), "lang")


NEXT_OFFSET = "SELECT lang, sum(size)::BIGINT AS next_offset FROM (SELECT DISTINCT lang, text, strlen(text) AS size FROM documents) GROUP BY lang"


def folder_group(spark, d):
    docs = _t(spark, d, "documents").select("lang", "doc_id", "source", F.upper("source").alias("shown"))
    return placement.folders(docs, "lang", "doc_id", "source", "shown")


FOLDER_GROUP = "SELECT lang, source, count(*) AS files, upper(source) AS display_name, (strlen(source) + 1)::BIGINT AS name_bytes FROM documents GROUP BY lang, source"


def folder_block_offsets(spark, d):
    f = folder_group(spark, d).withColumn("ord", F.regexp_extract("source", r"(\d+)$", 1).cast("long")).withColumn("block", F.col("name_bytes") + 1 + 16 * F.col("files"))
    return placement.running_offset(f, "lang", "ord", "block", base=36).select("lang", "source", "block", "offset")


FOLDER_BLOCKS = rf"""
WITH f AS ({FOLDER_GROUP}), b AS (SELECT lang, source, regexp_extract(source, '(\d+)$', 1)::BIGINT AS ord, (name_bytes + 1 + 16 * files)::BIGINT AS block FROM f)
SELECT lang, source, block, (36 + coalesce(sum(block) OVER (PARTITION BY lang ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM b"""


# -- spans --------------------------------------------------------------------------------------------------------
def _line_spans(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("archive"), (F.col("l_partkey") * 7).alias("at"), F.col("l_quantity").cast("long").alias("size"))


def span_exclusivity(spark, d):
    return spans.exclusivity(_line_spans(spark, d), "archive", "at", "size")


def span_exclusivity_strict(spark, d):
    return spans.exclusivity(_line_spans(spark, d), "archive", "at", "size", allow_equal=False)


def _span_sql(distinct: str) -> str:
    return f"""
WITH a AS (SELECT l_suppkey AS archive, l_partkey * 7 AS start, l_quantity::BIGINT AS size FROM lineitem),
s AS (SELECT {distinct} archive, start, start + size AS stop FROM a WHERE size > 0),
o AS (SELECT archive, count(*) AS n FROM (SELECT archive, start, lag(stop) OVER (PARTITION BY archive ORDER BY start, stop) AS p FROM s) WHERE p > start GROUP BY archive),
c AS (SELECT archive, count(*) FILTER (size > 0) AS spans, count(DISTINCT (start, size)) FILTER (size > 0) AS distinct_spans FROM a GROUP BY archive)
SELECT c.archive, spans, distinct_spans, coalesce(n, 0) AS overlaps, coalesce(n, 0) = 0 AS exclusive FROM c LEFT JOIN o USING (archive)"""


def record_order_check(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 4).alias("archive"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 50000).cast("long").alias("hash"))
    return spans.record_order(o, "archive", "idx", "hash")


RECORD_ORDER = """
WITH r AS (SELECT o_custkey % 4 AS archive, o_orderkey AS idx, trunc(o_totalprice / 50000)::BIGINT AS hash FROM orders),
p AS (SELECT *, lag(hash) OVER (PARTITION BY archive ORDER BY idx) AS prev FROM r)
SELECT archive, idx, hash, prev, CASE WHEN prev > hash THEN 'unsorted' ELSE 'duplicate' END AS problem FROM p WHERE prev >= hash"""


def duplicate_paths(spark, d):
    p = _url_paths(spark, d).select(paths.canonical(F.regexp_replace("path", r"/[0-9].*$", "")).alias("path")).where("path is not null")
    return spans.duplicates(p, "path")


DUPLICATE_PATHS = f"SELECT path, count(*) AS times FROM (SELECT {_CANON.format('p')} AS path FROM (SELECT regexp_replace(path, '/[0-9].*$', '') AS p FROM ({_URL}))) WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1"


def span_bounds(spark, d):
    return spans.out_of_bounds(_line_spans(spark, d).withColumn("total", F.lit(10_000).cast("long")), "at", "size", "total")


SPAN_BOUNDS = 'SELECT l_suppkey AS archive, l_partkey * 7 AS "at", l_quantity::BIGINT AS size, 10000::BIGINT AS total FROM lineitem WHERE NOT (l_partkey * 7 <= 10000 AND l_quantity::BIGINT <= 10000 - l_partkey * 7)'


# -- textures -----------------------------------------------------------------------------------------------------
def chunk_rollup(spark, d):
    raw = F.col("l_extendedprice").cast("long")
    c = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 16).alias("offset"), raw.alias("raw"), F.when(F.col("l_discount") > 0.05, F.floor(raw / 2)).otherwise(0).cast("long").alias("packed"), (F.col("l_linenumber") - 1).alias("start_mip"), (F.col("l_orderkey") % 5 == 0).alias("is_cubemap"))
    return textures.rollup(c, "l_orderkey")


CHUNK_ROLLUP = """
WITH c AS (SELECT l_orderkey, l_partkey * 16 AS "offset", trunc(l_extendedprice)::BIGINT AS raw, CASE WHEN l_discount > 0.05 THEN trunc(l_extendedprice)::BIGINT // 2 ELSE 0 END AS packed, l_linenumber - 1 AS mip, l_orderkey % 5 = 0 AS cube FROM lineitem)
SELECT l_orderkey, (148 + sum(raw))::BIGINT AS raw_size, sum(CASE WHEN packed = 0 THEN raw ELSE packed END)::BIGINT AS stored_size, min("offset")::BIGINT AS payload_offset,
       bool_or(packed <> 0) AS any_packed, count(*) AS chunk_count,
       greatest(CASE WHEN bool_or(cube) THEN count(*) FILTER (mip = 0) // 6 ELSE count(*) FILTER (mip = 0) END, 1)::BIGINT AS array_size FROM c GROUP BY l_orderkey"""


def _sized_parts(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).cast("int").alias("width"), (F.col("p_size") * 25 + 3).cast("int").alias("height"), F.element_at(F.array(*(F.lit(f[0]) for f in textures.FORMATS)), (F.col("p_partkey") % len(textures.FORMATS) + 1).cast("int")).alias("dxgi_format"))
    return p.join(F.broadcast(textures.formats(spark)), "dxgi_format")  # a fixed table


_FORMATS_SQL = ", ".join(str(f) for f in textures.FORMATS)
_PARTS_SQL = f"""f(fmt, name, bb, bs) AS (VALUES {_FORMATS_SQL}),
p AS (SELECT p_partkey, p_size * 40 AS w, p_size * 25 + 3 AS h, fmt, name, bb, bs FROM part JOIN f ON fmt = [{', '.join(str(f[0]) for f in textures.FORMATS)}][p_partkey % {len(textures.FORMATS)} + 1])"""


def mip_sizes(spark, d):
    m = _sized_parts(spark, d).withColumn("mip", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return m.select("p_partkey", "format_name", "mip", textures.mip_dimension(F.col("width"), F.col("mip")).alias("mip_width"), textures.mip_bytes(F.col("width"), F.col("height"), F.col("mip"), F.col("block_bytes"), F.col("block_side")).alias("mip_bytes"))


MIP_SIZES = f"""
WITH {_PARTS_SQL}
SELECT p_partkey, name AS format_name, mip::INT AS mip, greatest(w::BIGINT >> mip, 1)::BIGINT AS mip_width,
       (ceil(greatest(w >> mip, 1) / bs) * ceil(greatest(h >> mip, 1) / bs) * bb)::BIGINT AS mip_bytes FROM p, (SELECT unnest(range(0, 7))::INT AS mip)"""


def mip_ranges(spark, d):
    r = textures.default_ranges(F.col("width").cast("long"), F.col("height").cast("long"), F.lit(9))
    p = _sized_parts(spark, d).withColumn("r", F.explode(r))
    return p.select("p_partkey", F.col("r.first").cast("long").alias("first_mip"), F.col("r.last").cast("long").alias("last_mip"), textures.mip_range_bytes(F.col("width"), F.col("height"), F.col("r.first"), F.col("r.last"), F.col("block_bytes"), F.col("block_side")).alias("range_bytes"))


MIP_RANGES = f"""
WITH {_PARTS_SQL},
a AS (SELECT *, len([m FOR m IN range(0, 3) IF greatest(w >> m::INT, 1) >= 512 AND greatest(h >> m::INT, 1) >= 512]) AS alone FROM p),
r AS (SELECT *, unnest(list_concat([{{'f': m, 'l': m}} FOR m IN range(0, alone)], [{{'f': alone, 'l': 8}}])) AS r FROM a)
SELECT p_partkey, r.f::BIGINT AS first_mip, r.l::BIGINT AS last_mip, list_sum([ceil(greatest(w >> m::INT, 1) / bs) * ceil(greatest(h >> m::INT, 1) / bs) * bb FOR m IN range(r.f, r.l + 1)])::BIGINT AS range_bytes FROM r"""


def mip_sequence_check(spark, d):
    """Lines of an order as the chunks of a 16 x 16 texture: two mips, a cube map if the key is even; null: sound."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey"), F.col("l_quantity").cast("int").alias("q")))).alias("lines"))

    def chunk(x, i):
        first = i % 2
        size = F.when(first == 0, 1024).otherwise(256) + F.when(x["q"] % 11 == 0, 4).otherwise(0)
        return F.struct(first.cast("int").alias("start_mip"), (first + F.when(x["q"] % 7 == 0, 1).otherwise(0)).cast("int").alias("end_mip"), size.cast("long").alias("raw_size"))

    c = lines.withColumn("chunks", F.transform("lines", chunk))
    error = textures.layout_error(F.col("chunks"), F.lit(16), F.lit(16), F.lit(2), F.col("l_orderkey") % 2 == 0, F.lit(4), F.lit(1))
    return c.select("l_orderkey", F.size("chunks").cast("long").alias("chunk_count"), error.alias("error"))


#: Sound chunks alternate between mips 0 and 1, so chunk n (from 1) belongs to face (n - 1) / 2. What differs first is
#: the error; a slice has six faces in a cube map, else one. Sizes never fit the tail of a cube map.
MIP_SEQUENCE = """
WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n, trunc(l_quantity)::INT AS q FROM lineitem),
c AS (SELECT *, (n - 1) % 2 AS s FROM r),
t AS (SELECT *, s + CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN s = 0 THEN 1024 ELSE 256 END + CASE WHEN q % 11 = 0 THEN 4 ELSE 0 END AS z, sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS tops, lag(CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS wide FROM c),
f AS (SELECT *, CASE WHEN k % 2 = 0 THEN greatest(tops // 6, 1) * 6 ELSE tops END AS faces FROM t),
x AS (SELECT *, CASE WHEN (n - 1) // 2 >= faces THEN 'surplus' WHEN e > 1 THEN 'range' WHEN s = 1 AND coalesce(wide, 0) = 1 THEN 'gap'
        WHEN z <> CASE WHEN s = 0 AND e = 0 THEN 1024 WHEN s = 0 THEN 1280 ELSE 256 END THEN 'size' END AS bad FROM f)
SELECT k AS l_orderkey, count(*) AS chunk_count, coalesce(arg_min(bad, n) FILTER (bad IS NOT NULL), CASE WHEN any_value(faces) * 2 <> count(*) THEN 'incomplete' END) AS error FROM x GROUP BY k"""


def range_join_chunks(spark, d):
    """Planned chunks meet the subresources of their mip range."""
    base = _t(spark, d, "part").select(F.col("p_partkey").alias("texture"), F.col("p_size").alias("n"))
    sub = base.withColumn("mip", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("texture", F.lit(0).alias("array_index"), F.lit(0).alias("face"), "mip", (F.col("n") * (6 - F.col("mip"))).alias("size"))
    plan = base.withColumn("c", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(5).alias("e"))))).select("texture", F.lit(0).alias("array_index"), F.lit(0).alias("face"), F.col("c.s").alias("start_mip"), F.col("c.e").alias("end_mip"))
    return textures.place_subresources(plan, sub).groupBy("texture", "start_mip").agg(F.count("*").alias("parts"), F.sum("size").cast("long").alias("bytes"))


RANGE_JOIN = """
WITH s AS (SELECT p_partkey AS texture, mip, p_size * (6 - mip) AS size FROM part, (SELECT unnest(range(0, 6)) AS mip)),
c AS (SELECT p_partkey AS texture, s, e FROM part, (VALUES (0, 1), (2, 5)) v(s, e))
SELECT c.texture, c.s AS start_mip, count(*) AS parts, sum(size)::BIGINT AS bytes FROM c JOIN s ON c.texture = s.texture AND mip BETWEEN c.s AND c.e GROUP BY c.texture, c.s"""


# -- catalog ------------------------------------------------------------------------------------------------------
def _catalog(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("lang").alias("archive_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("raw_size"), F.octet_length("text").cast("long").alias("stored_size"), F.when(F.col("n_chars") > 2000, "deflate").otherwise("none").alias("compression"))


_CATALOG = "SELECT lang AS archive_id, source || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS raw_size, strlen(text)::BIGINT AS stored_size, CASE WHEN n_chars > 2000 THEN 'deflate' ELSE 'none' END AS compression FROM documents"


def catalog_listing(spark, d):
    return catalog.listing(_catalog(spark, d), details=True)


def catalog_find(spark, d):
    return catalog.find(_catalog(spark, d), "SRC1\\1.TXT")


def catalog_contains(spark, d):
    wanted = _t(spark, d, "labels").select("doc_id", F.concat(F.lit("SRC"), F.col("doc_id") % 20, F.lit("\\"), F.col("doc_id"), F.lit(".txt")).alias("path"))
    return catalog.contains(_catalog(spark, d), wanted)


CATALOG_CONTAINS = f"SELECT doc_id, 'SRC' || (doc_id % 20) || '\\' || doc_id || '.txt' AS path, ('src' || (doc_id % 20) || '/' || doc_id || '.txt') IN (SELECT path FROM ({_CATALOG})) AS found FROM labels"


def _requests(spark, d):
    return _t(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.concat(F.lit("src"), F.col("doc_id") % 7, F.when(F.col("quality") == 0, "//").otherwise("/"), F.floor(F.col("doc_id") / 2), F.lit(".txt")).alias("path"))


def bulk_requests(spark, d):
    out = catalog.bulk(_requests(spark, d), _catalog(spark, d), most=4000)
    return out.select("ord", "path", "first_ord", "failure", "archive_id", "raw_size")


BULK_REQUESTS = f"""
WITH r AS (SELECT doc_id AS ord, 'src' || (doc_id % 7) || CASE WHEN quality = 0 THEN '//' ELSE '/' END || (doc_id // 2) || '.txt' AS path FROM labels),
f AS (SELECT path, min(ord) AS first_ord FROM r GROUP BY path)
SELECT r.ord, r.path, first_ord, CASE WHEN contains(r.path, '//') THEN 'invalid_argument' WHEN raw_size IS NULL THEN 'not_found' WHEN raw_size > 4000 THEN 'too_large' END AS failure, archive_id, raw_size
FROM r JOIN f USING (path) LEFT JOIN ({_CATALOG}) c ON c.path = r.path"""


def bulk_outcome(spark, d):
    return catalog.outcome(catalog.bulk(_requests(spark, d), _catalog(spark, d), most=4000))


BULK_OUTCOME = f"SELECT count(*) AS requested, count(*) FILTER (failure IS NULL) AS succeeded, count(*) FILTER (failure IS NOT NULL) AS failed FROM ({BULK_REQUESTS})"


def folder_failures(spark, d):
    planned = _catalog(spark, d).select("path", F.when(F.col("raw_size") > 8000, "too_large").alias("failure"))
    failed = catalog.parents(planned).where("parent like '%3'").select("parent", F.lit("io_error").alias("code"))
    return catalog.with_folder_failures(planned, failed)


FOLDER_FAILURES = f"""
SELECT regexp_extract(path, '^(.*)/', 1) AS parent, path, coalesce(CASE WHEN raw_size > 8000 THEN 'too_large' END, CASE WHEN regexp_extract(path, '^(.*)/', 1) LIKE '%3' THEN 'io_error' END) AS failure FROM ({_CATALOG})"""


def parent_folders(spark, d):
    return catalog.parents(_url_paths(spark, d))


PARENT_FOLDERS = f"SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '' END AS parent FROM ({_URL})"


# -- validation ---------------------------------------------------------------------------------------------------
def _archive_facts(spark, d):
    return _t(spark, d, "documents").groupBy(F.col("lang").alias("archive_id")).agg(F.min(F.when(F.col("lang") == "en", "ba2").otherwise("bsa")).alias("family"), (F.count("*") % 2 == 0).alias("has_embedded_names"), (F.max("doc_id") % 3 == 0).alias("file_name_table_has_trailing_bytes"), (F.min("doc_id") % 5 == 0).alias("folder_name_table_length_mismatch"))


def validation_warnings(spark, d):
    e = _t(spark, d, "documents").select(F.col("lang").alias("archive_id"), F.concat(F.when(F.col("doc_id") % 4 == 0, "sound/").otherwise("text/"), "doc_id").alias("path"), F.when(F.col("n_chars") > 2000, "deflate").otherwise("none").alias("compression"), (F.col("doc_id") % 10 == 3).alias("record_identity_mismatch"))
    return validation.warnings(_archive_facts(spark, d), e, "bsa")


VALIDATION_WARNINGS = """
WITH a AS (SELECT lang AS archive_id, count(*) % 2 = 0 AS emb, max(doc_id) % 3 = 0 AS tr, min(doc_id) % 5 = 0 AS mis FROM documents GROUP BY lang),
e AS (SELECT lang AS archive_id, CASE WHEN doc_id % 4 = 0 THEN 'sound/' ELSE 'text/' END || doc_id AS path, n_chars, doc_id FROM documents)
SELECT archive_id, 0 AS warn_ord, 'target_family_mismatch' AS code, 'risky' AS severity, NULL::VARCHAR AS path FROM a WHERE archive_id = 'en'
UNION ALL SELECT archive_id, 1, 'bsa_embedded_name_compatibility_risk', 'risky', NULL FROM a WHERE emb
UNION ALL SELECT archive_id, 2, 'bsa_file_name_table_trailing_bytes', 'advisory', NULL FROM a WHERE tr
UNION ALL SELECT archive_id, 3, 'bsa_folder_name_table_length_mismatch', 'advisory', NULL FROM a WHERE mis
UNION ALL SELECT archive_id, 4, 'ba2_record_identity_mismatch', 'risky', path FROM e WHERE doc_id % 10 = 3
UNION ALL SELECT archive_id, 5, 'compressed_sound_payload', 'advisory', path FROM e WHERE starts_with(path, 'sound/') AND n_chars > 2000"""


def _order_rules(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 50).alias("archive_id"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    rules = [("span_outside", "format_error", F.col("o_totalprice") > 400_000), ("bad_method", "unsupported", (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300_000)), ("bad_name", "invalid_argument", F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") < 5_000))]
    return validation.violations(o, ["archive_id"], "o_orderkey", rules)


_ORDER_RULES = """
SELECT o_custkey % 50 AS archive_id, o_orderkey AS record_index, r.* FROM orders, LATERAL (VALUES
  (0, 'format_error', 'span_outside', o_totalprice > 400000), (1, 'unsupported', 'bad_method', o_orderstatus = 'P' AND o_totalprice > 300000),
  (2, 'invalid_argument', 'bad_name', starts_with(o_orderpriority, '1') AND o_totalprice < 5000)) r(rule_rank, code, rule, broken) WHERE broken"""


def first_error_precedence(spark, d):
    return validation.first_error(_order_rules(spark, d), ["archive_id"])


FIRST_ERROR = f"""
SELECT archive_id, 0 AS phase, min(record_index) AS record_index, arg_min(code, record_index * 4 + rule_rank) AS code, arg_min(rule, record_index * 4 + rule_rank) AS rule, count(*) AS violations
FROM ({_ORDER_RULES}) GROUP BY archive_id"""


def first_error_by_family(spark, d):
    """Orders as records of archives of four families, each with the order of checks of its family."""
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 400).alias("archive_id"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    family = F.col("archive_id") % 4
    breaks = {"name": F.col("o_totalprice") < 2000, "hash": F.col("o_orderstatus") == "P", "span": F.col("o_totalprice") > 420_000, "overlap": F.col("o_orderkey") % 97 == 0}
    order = {0: (("hash", "name", "span"), ("overlap",)), 1: (("name", "hash", "span", "overlap"), ()), 2: (("name", "span", "overlap"), ()), 3: (("span", "overlap"), ("name", "hash"))}
    found = None
    for number, phases in order.items():
        for phase, names in enumerate(phases):
            if names:
                part = validation.violations(o.where(family == number), ["archive_id"], "o_orderkey", [(n, "format_error", breaks[n]) for n in names], phase=phase)
                found = part if found is None else found.unionByName(part)
    return validation.first_error(found, ["archive_id"])


FIRST_BY_FAMILY = """
WITH r AS (SELECT o_custkey % 400 AS archive_id, o_orderkey AS i, o_totalprice < 2000 AS b_name, o_orderstatus = 'P' AS b_hash, o_totalprice > 420000 AS b_span, o_orderkey % 97 = 0 AS b_overlap FROM orders),
v AS (SELECT archive_id, i, x.phase, x.rank, x.rule FROM r, LATERAL (VALUES
  (0, 0, 0, 'hash', b_hash), (0, 0, 1, 'name', b_name), (0, 0, 2, 'span', b_span), (0, 1, 0, 'overlap', b_overlap),
  (1, 0, 0, 'name', b_name), (1, 0, 1, 'hash', b_hash), (1, 0, 2, 'span', b_span), (1, 0, 3, 'overlap', b_overlap),
  (2, 0, 0, 'name', b_name), (2, 0, 1, 'span', b_span), (2, 0, 2, 'overlap', b_overlap),
  (3, 0, 0, 'span', b_span), (3, 0, 1, 'overlap', b_overlap), (3, 1, 0, 'name', b_name), (3, 1, 1, 'hash', b_hash)) x(family, phase, rank, rule, broken)
  WHERE family = archive_id % 4 AND broken),
n AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY phase, i, rank) AS k, count(*) OVER (PARTITION BY archive_id) AS c FROM v)
SELECT archive_id, phase, i AS record_index, 'format_error' AS code, rule, c AS violations FROM n WHERE k = 1"""


def span_clashes(spark, d):
    """The later record of spans that partly overlap, by supplier: line items as spans."""
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("archive"), (F.col("l_partkey") * 1000).alias("at"), (F.col("l_quantity") * 20).cast("long").alias("size"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record"))
    return spans.clashes(lines, "archive", "at", "size", "record")


SPAN_CLASHES = """
WITH s AS (SELECT l_suppkey AS archive, l_partkey * 1000 AS a, l_partkey * 1000 + (l_quantity * 20)::BIGINT AS b, min(l_orderkey * 8 + l_linenumber) AS r FROM lineitem WHERE (l_quantity * 20)::BIGINT > 0 GROUP BY ALL),
p AS (SELECT archive, a, r, max({'b': b, 'n': -r}) OVER (PARTITION BY archive ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT archive, greatest(r, -m.n)::BIGINT AS record FROM p WHERE m.b > a"""


def validation_report(spark, d):
    archives = _archive_facts(spark, d)
    errors = _t(spark, d, "documents").where("n_chars > 15000").select(F.col("lang").alias("archive_id"))
    return validation.report(archives, errors, validation_warnings(spark, d))


VALIDATION_REPORT = f"""
WITH w AS ({VALIDATION_WARNINGS}), a AS (SELECT DISTINCT lang AS archive_id FROM documents),
e AS (SELECT lang AS archive_id, count(*) AS errors FROM documents WHERE n_chars > 15000 GROUP BY lang),
g AS (SELECT archive_id, count(*) AS warnings, count(*) FILTER (severity = 'risky') AS risky FROM w GROUP BY archive_id)
SELECT archive_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(risky, 0) AS risky, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) = 0 AS clean
FROM a LEFT JOIN e USING (archive_id) LEFT JOIN g USING (archive_id)"""


def size_bound_filter(spark, d):
    return validation.too_large(_catalog(spark, d), 5000).select("archive_id", "path", "raw_size")


SIZE_BOUND = f"SELECT archive_id, path, raw_size FROM ({_CATALOG}) WHERE raw_size > 5000 OR stored_size > 5000"


# -- comparisons --------------------------------------------------------------------------------------------------
def catalog_compare(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    expected = docs.where("doc_id % 7 <> 0")
    actual = docs.where("doc_id % 5 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return compare.catalogs(expected, actual, ["doc_id"], ["lang", "n_chars"])


CATALOG_COMPARE = """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'extra' WHEN doc_id % 11 = 0 AND n_chars IS NOT NULL THEN 'different' ELSE 'same' END AS status
FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0"""


def baseline_verify(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    seen = docs.where("doc_id % 9 <> 0").withColumn("sha", F.when(F.col("doc_id") % 13 == 0, F.lit("-")).otherwise(F.col("sha")))
    return compare.baseline(docs, seen, "doc_id", "sha")


BASELINE_VERIFY = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'absent' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 13 = 0"


def payload_digest(spark, d):
    body = F.col("text").cast("binary")
    return _t(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("sha256"), F.sha2(F.substring(body, 149, 1 << 30), 256).alias("suffix_sha256"))


PAYLOAD_DIGEST = "SELECT doc_id, sha256(text) AS sha256, sha256(unhex(substr(hex(encode(text)), 297))) AS suffix_sha256 FROM documents"


def run_best(spark, d):
    e = _t(spark, d, "events").select("event_type", "user_id", "event_id", F.round("value", 2).alias("elapsed"))
    return compare.best_runs(e.where("value is not null"), ["event_type", "user_id"], "elapsed")


RUN_BEST = "SELECT event_type, user_id, min((round(value, 2), event_id))[1] AS elapsed, min((round(value, 2), event_id))[2] AS event_id, count(*) AS runs FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id"


def run_speedup(spark, d):
    e = _t(spark, d, "events").where("value is not null")
    return compare.speedups(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "value").select("user_id", "before", "after", F.round("speedup", 6).alias("speedup"))


RUN_SPEEDUP = """
WITH b AS (SELECT user_id, min(value) AS before FROM events WHERE event_id % 2 = 0 AND value IS NOT NULL GROUP BY user_id), a AS (SELECT user_id, min(value) AS after FROM events WHERE event_id % 2 = 1 AND value IS NOT NULL GROUP BY user_id)
SELECT user_id, before, after, round(CASE WHEN after > 0 THEN before / after END, 6) AS speedup FROM b FULL JOIN a USING (user_id)"""


def multiset_compare(spark, d):
    e = _t(spark, d, "events")
    return compare.multiset_difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


MULTISET = """
SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS left_count, count(*) FILTER (event_id % 2 = 1) AS right_count FROM events GROUP BY ALL
HAVING count(*) FILTER (event_id % 2 = 0) <> count(*) FILTER (event_id % 2 = 1)"""


def slowest_runs(spark, d):
    return compare.slowest(_t(spark, d, "events").where("value is not null").select("event_id", "value"), "value")


SLOWEST = "SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 15"

# -- whole archives -----------------------------------------------------------------------------------------------
def _plan(spark, d, target, embed=False):
    """Documents as one archive a language: what its segments sum to, and whether they follow each other without a gap."""
    docs = _t(spark, d, "documents").select(F.col("lang").alias("archive_id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("payload"))
    s = writers.segments(docs, target, policy="raw", embed=embed).select("archive_id", "offset", F.octet_length("data").cast("long").alias("bytes")).withColumn("stop", F.col("offset") + F.col("bytes")).where("bytes > 0")
    broken = spans.with_previous(s.select("archive_id", "offset", "stop"), "archive_id", ["offset"], "stop", F.floor(F.col("offset") / (1 << 20))).where("coalesce(prev, 0) <> offset").groupBy("archive_id").agg(F.count("*").alias("gaps"))
    total = s.groupBy("archive_id").agg(F.sum("bytes").cast("long").alias("total_bytes"), F.max("stop").alias("last_byte"))
    return total.join(broken, "archive_id", "left").na.fill(0, ["gaps"])


def archive_plan_gnrl(spark, d):
    return _plan(spark, d, "ba2-gnrl-fo4")


def archive_plan_tes3(spark, d):
    return _plan(spark, d, "bsa-tes3")


def archive_plan_tes4(spark, d):
    return _plan(spark, d, "bsa-fo3")


def archive_plan_embedded(spark, d):
    return _plan(spark, d, "bsa-sse", embed=True)


_ARCHIVE_FILES = "f AS (SELECT lang AS archive_id, source, doc_id, doc_id || '.txt' AS file, source || '/' || doc_id || '.txt' AS path, text, strlen(text) AS size FROM documents), d AS (SELECT archive_id, sum(size) AS data FROM (SELECT DISTINCT archive_id, text, size FROM f) GROUP BY archive_id)"
PLAN_GNRL = f"WITH {_ARCHIVE_FILES} SELECT archive_id, (24 + count(*) * 36 + any_value(data) + sum(strlen(path) + 2))::BIGINT AS total_bytes, (24 + count(*) * 36 + any_value(data) + sum(strlen(path) + 2))::BIGINT AS last_byte, 0::BIGINT AS gaps FROM f JOIN d USING (archive_id) GROUP BY archive_id"
PLAN_TES3 = f"WITH {_ARCHIVE_FILES} SELECT archive_id, (12 + count(*) * 20 + sum(size) + sum(strlen(path) + 1))::BIGINT AS total_bytes, (12 + count(*) * 20 + sum(size) + sum(strlen(path) + 1))::BIGINT AS last_byte, 0::BIGINT AS gaps FROM f GROUP BY archive_id"
PLAN_TES4 = f"""WITH {_ARCHIVE_FILES}, g AS (SELECT archive_id, sum(18 + strlen(source)) AS folders FROM (SELECT DISTINCT archive_id, source FROM f) GROUP BY archive_id),
t AS (SELECT archive_id, (36 + any_value(folders) + count(*) * 16 + sum(strlen(file) + 1) + any_value(data))::BIGINT AS n FROM f JOIN d USING (archive_id) JOIN g USING (archive_id) GROUP BY archive_id)
SELECT archive_id, n AS total_bytes, n AS last_byte, 0::BIGINT AS gaps FROM t"""
PLAN_EMBEDDED = f"""WITH {_ARCHIVE_FILES}, g AS (SELECT archive_id, sum(26 + strlen(source)) AS folders FROM (SELECT DISTINCT archive_id, source FROM f) GROUP BY archive_id),
t AS (SELECT archive_id, (36 + any_value(folders) + count(*) * 16 + sum(strlen(file) + 1) + sum(1 + strlen(path) + size))::BIGINT AS n FROM f JOIN g USING (archive_id) GROUP BY archive_id)
SELECT archive_id, n AS total_bytes, n AS last_byte, 0::BIGINT AS gaps FROM t"""

_PAIRS = (
    (path_normalize, PATH_NORMALIZE), (path_parts, PATH_PARTS), (destination_safety, DESTINATION_SAFETY), (name_hashes, NAME_HASHES), (numbers_round_trip, NUMBERS),
    (placement_shared, _placement_sql("lang, text", 0)), (placement_unshared, _placement_sql("doc_id", 36)), (placement_constrained, _placement_sql("lang, text, source", 24)), (placement_next_offset, NEXT_OFFSET),
    (folder_group, FOLDER_GROUP), (folder_block_offsets, FOLDER_BLOCKS), (span_exclusivity, _span_sql("DISTINCT")), (span_exclusivity_strict, _span_sql("")), (span_clashes, SPAN_CLASHES), (record_order_check, RECORD_ORDER),
    (duplicate_paths, DUPLICATE_PATHS), (span_bounds, SPAN_BOUNDS), (chunk_rollup, CHUNK_ROLLUP), (mip_sizes, MIP_SIZES), (mip_ranges, MIP_RANGES), (mip_sequence_check, MIP_SEQUENCE), (range_join_chunks, RANGE_JOIN),
    (catalog_listing, _CATALOG), (catalog_find, f"SELECT * FROM ({_CATALOG}) WHERE path = 'src1/1.txt'"), (catalog_contains, CATALOG_CONTAINS), (bulk_requests, BULK_REQUESTS), (bulk_outcome, BULK_OUTCOME),
    (folder_failures, FOLDER_FAILURES), (parent_folders, PARENT_FOLDERS), (validation_warnings, VALIDATION_WARNINGS), (first_error_precedence, FIRST_ERROR), (first_error_by_family, FIRST_BY_FAMILY), (validation_report, VALIDATION_REPORT), (size_bound_filter, SIZE_BOUND),
    (catalog_compare, CATALOG_COMPARE), (baseline_verify, BASELINE_VERIFY), (payload_digest, PAYLOAD_DIGEST), (run_best, RUN_BEST), (run_speedup, RUN_SPEEDUP), (multiset_compare, MULTISET), (slowest_runs, SLOWEST),
    (archive_plan_gnrl, PLAN_GNRL), (archive_plan_tes3, PLAN_TES3), (archive_plan_tes4, PLAN_TES4), (archive_plan_embedded, PLAN_EMBEDDED),
)
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLE_SQL = {f.__name__: sql for f, sql in _PAIRS}
