"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

Equal shingle sets form a class. Classes get a fast similarity sketch and one row for each band of it. Each class is
first verified against the bucket's least class that it shares most bands with; most copies fall into components so.
Classes of buckets that still hold several components are narrowed by their rarest shingles: two sets that overlap
enough share one of the few shingles in which they may differ, so classes that hang together by none of those can't be
linked. Only classes that buckets hold together, at least through others, count for that: those shingles are rare by
a count of bounded size, which a large corpus fills, and unrelated texts must not grow together by them. What still
hangs together is decided on full sets, in blocks of bounded size that leave out pairs within a cluster's main
component. Only links are emitted, never all pairs. Hot keys of every join are broadcast or salted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hot import HOT, met
from .common import Words, bitset, has_bits, mix, ngrams, slices, text_column, written


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, end to end; and their offsets by text.

    A text of fewer than ``k`` words has one shingle, all its words; a text without words has none."""
    words = Words(texts, lower=True)
    h = words.hashes()
    n = len(h)
    full = ngrams(h, k)
    last = np.repeat(words.first + words.counts, words.counts)
    valid = np.arange(n) + k <= last
    for i in np.flatnonzero((words.counts > 0) & (words.counts < k)):
        a, c = int(words.first[i]), int(words.counts[i])
        full[a] = ngrams(h[a : a + c], c, salt=0x5851F42D4C957F2D + 2 * c)[0]
        valid[a] = True
    value, doc = full[valid], words.doc[valid]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(words.rows + 1))


def sketch(value: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, (texts, t): in round i < t every element falls into a hashed bin with a hashed value;
    in round t + i every element falls into bin i. A bin keeps its least (round, value), so after all rounds every bin
    of a text with any element is full; a text stops at the end of the round in which its last bin filled."""
    rows = len(offsets) - 1
    out = np.full(rows * t, np.iinfo(np.uint64).max)
    counts = np.diff(offsets)
    open_rows = np.flatnonzero(counts)
    for i in range(2 * t):
        if not len(open_rows):
            break
        if len(open_rows) == rows:
            x, own = value, np.repeat(np.arange(rows), counts)
        else:
            c = counts[open_rows]
            own = np.repeat(open_rows, c)
            x = value[np.repeat(offsets[open_rows] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())]
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        slot = (h >> np.uint64(32)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        np.minimum.at(out, own * t + slot.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        full = (out.reshape(rows, t)[open_rows] != np.iinfo(np.uint64).max).all(1)
        open_rows = open_rows[~full]
    return out.reshape(rows, t)


SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def set_key(value: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that name each text's shingle set, whatever the order."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


#: Classes, and shingles in all, of one side of a block in which full sets are compared, on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Most bits that name a slot in which shingles are counted to order them by rarity: one byte each, whatever the corpus.
SLOT_BITS = 24
#: Shingles that a task sorts at once.
TOGETHER = 1 << 18
#: Classes whose doc_id another class bears as well are numbered from here on; doc_ids lie below.
SURROGATE = 1 << 62


def profiles(docs: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, n, key1, key2 (128 bits that name the shingle set), sketch (16 bits a coordinate)."""
    t = bands * per_band

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch)
            for a, b in slices(texts):
                value, offsets = shingles(texts[a:b], k)
                n = np.diff(offsets)
                keys = [set_key(value, offsets, salt) for salt in SALTS]
                s = mix(sketch(value, offsets, t)).astype("<u2")
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(n, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array([x.tobytes() for x in s], pa.binary())], ["doc_id", "n", "key1", "key2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key1 long, key2 long, sketch binary")


def band_keys(classes: DataFrame, bands: int, per_band: int) -> DataFrame:
    """node, band: one row for each band of a class, the band's number mixed into its hash."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0)
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(node), bands, per_band).astype(np.uint64)
            for j in range(bands):
                key = ngrams(np.ascontiguousarray(mix(s[:, j] + np.uint64((j + 1) << 20)).ravel()), per_band)[::per_band]
                yield pa.RecordBatch.from_arrays([node, pa.array(key.view(np.int64))], ["node", "band"])

    return classes.select("node", "sketch").mapInArrow(run, "node long, band long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n, shingles of the classes in ``wanted(node, doc_id, key1)``, from the documents that stand for them.

    A bit set of fixed size spares the other documents the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(bitset(wanted, "doc_id", bits=24))

    def run(batches):
        have = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            keep = has_bits(have, batch.column(0).to_numpy())
            batch = batch.filter(pa.array(keep))
            ids, texts = batch.column(0), text_column(batch)
            for a, b in slices(texts):
                value, offsets = shingles(texts[a:b], k)
                key = set_key(value, offsets, SALTS[0])
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(key), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))], ["doc_id", "key1", "shingles"])
            pa.default_memory_pool().release_unused()

    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key1 long, shingles array<long>")
    return found.join(wanted, ["doc_id", "key1"]).select("node", F.size("shingles").cast("long").alias("n"), "shingles").dropDuplicates(["node"])


def _flat(e: DataFrame) -> bool:
    """Whether edges (u, v), v the lesser, are stars: every u has one v, and no v is a u. Then all is decided."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below + above > 1").take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) of every node of an edge: alternating large and small stars.

    Neighbourhoods are only ever reduced to their least node, never collected."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _flat(e):
        total = 2 * e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = met(both, low, ["u"], "c", total).drop("c").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = met(large, low, ["u"], "c", total).drop("c").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _close(inter: Column, n1: Column, n2: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n1 + n2 - inter)


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of a cluster dealt to pairs of blocks (i, j) so that every two rows meet that aren't both on the main side.

    ``mains`` and ``others`` say how many blocks each side has. Main rows number most in an easy cluster; with few
    others, each travels once for each block of those."""
    h = F.xxhash64("node", F.lit(11))
    dealt = rows.withColumn("main", F.col("comp") == F.col("main_comp"))
    own = F.when(F.col("main"), F.col("others") + F.pmod(h, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    dealt = dealt.withColumn("own", own)
    partner = F.when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    return dealt.withColumn("other", F.explode(partner)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("mains", "others", "other")


def to_compare(cluster: DataFrame) -> DataFrame:
    """cluster, i, j, own, node, comp: where rows of ``cluster(cluster, node, comp, n)`` with several components meet.

    A cluster of one block is all on one side; of a larger one the component of most classes is the main side."""
    # by counts of components: one row each, not one a class
    comps = cluster.groupBy("cluster", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    sizes = comps.groupBy("cluster").agg(F.max(F.struct("c", "comp", "n")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("comps > 1")
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    one = blocks(F.col("c"), F.col("n")) == 1
    others = F.when(one, 1).otherwise(blocks(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")))
    sizes = sizes.select("cluster", "c", F.when(~one, F.col("m.comp")).alias("main_comp"), F.when(one, 0).otherwise(blocks(F.col("m.c"), F.col("m.n"))).alias("mains"), others.alias("others"))
    return _blocked(met(cluster, sizes, ["cluster"], "c", cluster.count())).select("cluster", "i", "j", "own", "node", "comp")


def _forest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Least member reachable of each of n rows by the given pairs."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, first, root[second])
        np.minimum.at(low, second, root[first])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _meeting(own: np.ndarray, i: int, j: int):
    """Row numbers of the two sides of a block pair."""
    return (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(own)), np.arange(len(own)))


def _linking(percent: int):
    def run(key, table):
        """Links by full shingle sets between rows of different components; of those that hang together a spanning star."""
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        left, right = _meeting(table.column("own").to_numpy(), key[1].as_py(), key[2].as_py())
        sets = table.column("shingles").combine_chunks()
        value = sets.flatten().to_numpy()
        row = np.repeat(np.arange(len(node)), pa.compute.list_value_length(sets).to_numpy())
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        both = times[column] > 1
        _, column = np.unique(column[both], return_inverse=True)
        row = row[both]
        inter = np.zeros((len(left), len(right)), np.float32)
        where = [np.full(len(node), -1), np.full(len(node), -1)]
        where[0][left], where[1][right] = np.arange(len(left)), np.arange(len(right))
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        width = max(1, min(8192, (8 << 20) // max(len(node), 1)))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # shared shingles, some columns at a time
            p, q = np.searchsorted(column, (low, low + width))
            sides = []
            for side, size in zip(where, (len(left), len(right)), strict=True):
                m = np.zeros((size, width), np.float32)
                at = side[row[p:q]]
                m[at[at >= 0], column[p:q][at >= 0] - low] = 1
                sides.append(m)
            inter += sides[0] @ sides[1].T
        inter = inter.astype(np.int64)
        close = 100 * inter >= percent * (n[left][:, None] + n[right][None, :] - inter)
        close &= comp[left][:, None] != comp[right][None, :]
        x, y = np.nonzero(close)
        root = _forest(len(node), left[x], right[y])
        some = np.flatnonzero(root != np.arange(len(node)))
        pa.default_memory_pool().release_unused()
        return pa.table({"a": node[some], "b": node[root[some]]})

    return run


def _in_parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch whose lists hold about ``TOGETHER`` values; a longer list is alone."""
    n = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(n, (n[start - 1] if start else 0) + TOGETHER, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def slot_sizes(sets: DataFrame) -> np.ndarray:
    """How often shingles of ``sets(n, shingles)`` fall into each of a power of two slots, at most ``2**SLOT_BITS`` and
    about two a shingle, as a byte that grows with the logarithm.

    Counts are summed in Spark; one byte a slot reaches the driver, whatever the number of shingles."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = min(max(int(total).bit_length() + 1, 16), SLOT_BITS)
    sections, width = 64, 1 << bits - 6

    def count(batches):
        for batch in batches:
            for part in _in_parts(batch, 0):
                slot, times = np.unique(part.column(0).flatten().to_numpy() & np.int64((1 << bits) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(times, pa.int64())], ["slot", "c"])

    def pack(key, table):
        part = np.zeros(width, np.uint8)
        c = table.column("c").to_numpy()
        part[table.column("slot").to_numpy() - key[0].as_py() * width] = np.minimum(np.where(c < 16, c, 16 + 4 * np.log2(c / 16)), 255).astype(np.uint8)
        return pa.table({"section": pa.array(key[:1], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    counts = sets.select("shingles").mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    parts = counts.withColumn("section", F.floor(F.col("slot") / width).cast("int")).groupBy("section").applyInArrow(pack, "section int, part binary").collect()
    out = np.zeros(sections * width, np.uint8)
    for p in parts:
        out[p.section * width : (p.section + 1) * width] = np.frombuffer(p.part, np.uint8)
    return out


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """node, shingle, small: the shingles of each set one of which two sets with enough in common share.

    Shingles are put in one order for all sets, the rarest first. Of two linked sets the larger has a common shingle
    among its first ``n - ceil(p n) + 1``, the smaller that same one among its first ``n - ceil(2 p n / (1 + p)) + 1``
    (``small``), as what comes after would not be enough. The order decides only how few others share them."""
    sizes = sets.sparkSession.sparkContext.broadcast(slot_sizes(sets).tobytes())

    def run(batches):
        have = np.frombuffer(sizes.value, np.uint8)
        for batch in (part for whole in batches for part in _in_parts(whole, 1)):
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            value = lists.flatten().to_numpy()
            n = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            common = have[value & np.int64(len(have) - 1)]
            order = np.lexsort((value, common, own))
            place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
            least = lambda top, bottom: (n - -(-top * n // bottom) + 1)[own]
            keep = place < least(percent, 100)
            few = place < least(2 * percent, 100 + percent)
            keep &= common[order] > 1  # alone in its slot: no other set has it
            yield pa.RecordBatch.from_arrays([pa.array(node[own[keep]]), pa.array(value[order][keep]), pa.array(few[keep])], ["node", "shingle", "small"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, shingle long, small boolean")


def groups(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = 30, per_band: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Documents whose sets of ``k``-word shingles have at least
    ``percent`` % in common (of their union) are linked; component_id is the least doc_id reachable. Banding misses a
    pair at exactly 80 % with probability (1 - 0.8^5)^30 = 7e-6, a closer one less; every candidate is decided on full
    sets. Null and empty texts and texts without words have no shingles and are linked with nothing. A row without
    doc_id is linked with nothing, has no component_id and is kept. Rows that share a doc_id are one document: what any
    of their texts is linked with, all are (those without words stay alone). doc_ids lie under 2^62."""
    docs = docs.select("doc_id", "text")
    own = written(profiles(docs, k, bands, per_band), "profiles")
    key = ["key1", "key2", "n"]
    # equal sets first: one class, whatever its number of copies
    known = own.where("n > 0 and doc_id is not null")
    sets = known.groupBy(*key).agg(F.min(F.struct("doc_id", "sketch")).alias("low")).select(*key, F.col("low.doc_id").alias("doc_id"), F.col("low.sketch").alias("sketch"))
    # the class with the least key is named by its doc_id, any other of that doc_id by a number of its own
    first = sets.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("first"))
    other = F.lit(SURROGATE) + F.xxhash64(*key).bitwiseAND(F.lit(SURROGATE - 1))
    classes = written(sets.join(first, "doc_id").withColumn("node", F.when(F.struct(*key) == F.col("first"), F.col("doc_id")).otherwise(other)).drop("first"), "classes")
    links = _links(docs, classes, k, percent, bands, per_band)
    # texts of one doc_id belong together
    several = known.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b")
    texts = known.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", *key).distinct().join(classes.select(*key, "node"), key)
    least = texts.groupBy("doc_id").agg(F.min("node").alias("a"))
    comp = components(links.union(texts.join(least, "doc_id").select("a", F.col("node").alias("b"))))
    by_key = classes.select(*key, "node").join(comp, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    out = own.drop("sketch").join(by_key, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int, bands: int, per_band: int) -> DataFrame:
    """Links (a, b) between classes that join every two classes joined by a chain of close pairs."""
    banded = band_keys(classes, bands, per_band)
    full = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    member = written(banded.join(full, "band").select("band", "node", "pivot"), "buckets")
    facts = classes.select("node", "doc_id", "key1")
    active = facts.join(member.select("node").distinct(), "node", "left_semi")
    sets = written(shingle_sets(docs, active, k), "sets")
    # first every class against the pivot it shares most bands with; a pivot that many have is dealt to many keys
    tried = member.where("node <> pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max(F.struct("count", -F.col("pivot"))).alias("best")).select("node", (-F.col("best.col2")).alias("pivot"))
    tried = written(tried, "tried")
    shares = tried.groupBy("pivot").agg(F.count("*").alias("c")).where(F.col("c") >= max(HOT, tried.count() // 1000)).select("pivot", F.ceil(F.col("c") / HOT).cast("int").alias("shares"))
    dealt = tried.join(F.broadcast(shares), "pivot", "left").withColumn("share", F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    pivots = sets.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("shingles").alias("s2")).join(F.broadcast(shares), "pivot", "left")
    pivots = pivots.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    pair = dealt.join(sets, "node").join(pivots, ["pivot", "share"])
    first = pair.where(_close(F.size(F.array_intersect("shingles", "s2")), F.col("n"), F.col("n2"), percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    first = written(first, "links")
    comp = components(first)
    # then what is left: buckets that still hold several components
    comp = written(active.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "components")
    spread = member.join(comp, "node").select("band", "comp").distinct()
    mixed = written(spread.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y"), "mixed")
    # components that buckets hold together, at least through others: links lie within these bundles
    bundle = components(spread.join(mixed, "band").select("comp", "x"), "comp", "x").select(F.col("node").alias("comp"), F.col("component").alias("bundle"))
    left = written(member.join(mixed, "band", "left_semi").select("node").distinct().join(comp, "node").join(bundle, "comp"), "left")
    open_sets = sets.join(left, "node")
    # classes of a bundle that share one of their rarest shingles, at least one of them as the smaller set, hang together
    rare = written(rarest(open_sets, percent).join(left, "node"), "rarest")
    shared = rare.groupBy("bundle", "shingle").agg(F.min(F.when(F.col("small"), F.col("node"))).alias("hub"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x < y and hub is not null")
    hung = met(rare.select("bundle", "shingle", "node"), shared.select("bundle", "shingle", "hub", "c"), ["bundle", "shingle"], "c", rare.count()).select("node", "hub").where("node <> hub").distinct()
    cluster = components(hung, "node", "hub").withColumnRenamed("component", "cluster")
    cluster = written(cluster.join(left, "node").join(sets.select("node", "n"), "node").select("cluster", "node", "comp", "n"), "clusters")
    second = to_compare(cluster).join(sets, "node").groupBy("cluster", "i", "j").applyInArrow(_linking(percent), "a long, b long")
    return first.union(second)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group, that of the least doc_id; columns unchanged.

    Of rows that share a doc_id and are kept, one of the least text stays; rows without a doc_id stay."""
    kept = groups(docs, k, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("r"))
    return left.select("r.*").unionByName(docs.where("doc_id is null"))
