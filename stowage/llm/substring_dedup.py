"""Exact substring dedup over a De Bruijn graph of words.

Nodes are runs of 12 words, edges the windows of 13. Where a node is an anchor (its hash says so, one of 16) a text is
cut, so that equal passages are cut alike; the edges between two cuts are a path, which is an edge from its first node
to its last. Four steps:

1. Paths are grouped; those that several documents hold are the repeated ones. Nodes at which just one of them ends and
   one begins don't branch: paths compact there to chains, through joins that double each pointer.
2. Occurrences of repeated paths outside the least document that holds them meet the chains. Those that follow each
   other in a text and in a chain are one span, which is removed; length and 96 hash bits over the source words of every
   path verify it against the least document's.
3. What is left (paths of one document, and the least document's copy of the others) is compared edge by edge. A window
   is named by the least hash of the 5-word runs in it (its minimizer), which equal windows share; minimizers of one
   document can't be part of a repeated edge, a bit set of fixed size holds the others. Edges meet by 64 bits of hash and
   are verified by 31 of an independent one.
4. Spans and marked edges come back to their documents, where the words that they cover are removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot import met
from .common import _BASE, Words, _power, bitset, has_bits, mix, ngrams, slices, text_column, written

WINDOW, SEED = 13, 5
#: One node of so many is an anchor.
ANCHOR = 16
#: Text bytes whose edges or documents share a bucket.
BUCKET_BYTES = 8 << 20


class Paths:
    """Edges of texts and the paths they form: by edge its first word and document, by path first edge and length."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = words = Words(texts)
        self.hashes = h = words.hashes()
        last = np.repeat(words.first + words.counts, words.counts)
        self.at = at = np.flatnonzero(np.arange(len(h)) + window <= last)
        self.doc = words.doc[at]
        node = ngrams(h, window - 1)
        cut = (node[at] & np.uint64(ANCHOR - 1)) == 0
        cut[:1] = True
        cut[1:] |= self.doc[1:] != self.doc[:-1]
        first = np.flatnonzero(cut)
        self.length = np.diff(np.append(first, len(at)))
        self.start, self.owner = at[first], self.doc[first]
        self.head, self.tail = node[self.start], node[self.start + self.length] if len(first) else node[:0]
        stop = self.start + self.length + window - 1
        self.key = self._named(h, stop)
        self.check = (self._named(mix(h ^ np.uint64(0x6A09E667F3BCC909)), stop) & np.uint64(0x7FFFFFFF)).astype(np.int32)

    def _named(self, h: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words from each path's first to its last."""
        n = len(h)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(_BASE, n), out=sums[1:])
        back = _power(pow(_BASE, -1, 1 << 64), n)
        return mix((sums[stop] - sums[self.start]) * back[self.start] + (stop - self.start).astype(np.uint64)) if len(stop) else h[:0]


def _mark(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a path in a document."""
    return mix(mix(key.view(np.uint64) ^ check.astype(np.uint64)) + doc.astype(np.int64).view(np.uint64) * np.uint64(_BASE)).view(np.int64)


def graph(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each path: mark (of the path in its least document), and for paths of several documents key, check,
    low, head, tail (nodes), length (edges), c (how often it occurs)."""

    def run(batches):
        names = ["key", "check", "low", "high", "head", "tail", "length", "c"]
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), text_column(batch)
            for a, b in slices(texts):
                p = Paths(texts[a:b], window)
                doc = ids[a:b][p.owner]
                order = np.lexsort((doc, p.check, p.key))
                k, c = p.key[order], p.check[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(k)) - 1
                one = order[first]
                cols = [p.key[one].view(np.int64), p.check[one], doc[one], doc[order[last]] if len(one) else doc[:0], p.head[one].view(np.int64), p.tail[one].view(np.int64), p.length[one].astype(np.int32), (last - first + 1).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

    def named(batches):
        for batch in batches:
            key, check, low, high = (batch.column(i).to_numpy() for i in range(4))
            alone = pa.array(low == high)
            null = lambda col: pa.compute.if_else(alone, pa.scalar(None, col.type), col)
            yield pa.RecordBatch.from_arrays([pa.array(_mark(key, check, low)), *(null(batch.column(i)) for i in (0, 1, 2, 4, 5, 6, 7))], ["mark", "key", "check", "low", "head", "tail", "length", "c"])

    seen = docs.select("doc_id", "text").mapInArrow(run, "key long, check int, low long, high long, head long, tail long, length int, c long")
    one = seen.groupBy("key", "check").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("head").alias("head"), F.min("tail").alias("tail"), F.min("length").alias("length"), F.sum("c").alias("c"))
    return one.mapInArrow(named, "mark long, key long, check int, low long, head long, tail long, length int, c long")


def chains(paths: DataFrame) -> DataFrame:
    """key, chain: repeated paths compacted where a node has one path in and one out; a chain is named by its last path.

    Pointers to the next path double with each join; rows that reached their chain's end rest, so no two rows of a chain
    ever ask for the same path. What runs in a circle is left apart after as many rounds as its length could need."""
    after = paths.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("out"), F.min("key").alias("next")).where("out = 1")
    before = paths.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("into"), F.min("key").alias("key")).where("into = 1")
    links = before.join(after, "node").where("key <> next").select("key", "next")
    state = written(paths.select("key").distinct().join(links, "key", "left").select("key", F.coalesce("next", "key").alias("chain"), F.col("next").isNull().alias("done")), "pointers")
    rounds = max(state.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if not state.where("not done").take(1):
            break
        there = state.select(F.col("key").alias("chain"), F.col("chain").alias("further"), F.col("done").alias("ends"))
        moved = state.where("not done").join(there, "chain").select("key", F.col("further").alias("chain"), F.col("ends").alias("done"))
        state = written(state.where("done").unionByName(moved), "pointers")
    return state.select("key", "chain")


def spans(docs: DataFrame, paths: DataFrame, bits, window: int = WINDOW) -> DataFrame:
    """doc_id, row, start, stop, chain, source (least document): maximal runs of words that a chain covers, from
    occurrences outside the least document. An occurrence whose mark isn't in ``bits`` is one for sure."""

    def run(batches):
        have = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            ids, rows, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_column(batch)
            for a, b in slices(texts):
                p = Paths(texts[a:b], window)
                doc = ids[a:b][p.owner]
                later = ~has_bits(have, _mark(p.key, p.check, doc))
                own = p.owner[later]
                cols = [p.key[later].view(np.int64), p.check[later], doc[later], rows[a:b][own], (p.start[later] - p.words.first[own]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["key", "check", "doc_id", "row", "start"])

    held = paths.join(chains(paths), "key").select("key", "check", "low", "length", "chain", "c")
    held = written(held, "chains")
    total = held.agg(F.sum("c")).first()[0] or 0
    found = docs.select("doc_id", "row", "text").mapInArrow(run, "key long, check int, doc_id long, row long, start int")
    found = met(found, held, ["key", "check"], "c", total)
    order = Window.partitionBy("doc_id", "row").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("length")).over(order) == F.col("start")) & (F.lag("chain").over(order) == F.col("chain")) & (F.lag("low").over(order) == F.col("low"))
    cut = found.withColumn("fresh", F.when(follows, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.max(F.col("start") + F.col("length") + window - 1)
    return cut.groupBy("doc_id", "row", "island").agg(F.min("start").alias("start"), ends.alias("stop"), F.min("chain").alias("chain"), F.min("low").alias("source")).drop("island")


def _edges(texts: pa.Array, ids: np.ndarray, have: np.ndarray, window: int, seed: int):
    """Paths of texts, which of their edges lie on paths whose mark is in the bit set, and the minimizer of each of these."""
    p = Paths(texts, window)
    mine = np.repeat(has_bits(have, _mark(p.key, p.check, ids[p.owner])), p.length)
    least = ngrams(p.hashes, seed, salt=0x51ED270B)
    runs = least.copy()
    for j in range(1, window - seed + 1):
        runs[:-j] = np.minimum(runs[:-j], least[j:])
    at = p.at[mine]
    return p, at, p.doc[mine], runs[at]


def shared_minimizers(docs: DataFrame, marks, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Minimizers that windows of two documents or more have, on paths whose mark is in the bit set."""

    def run(batches):
        have = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), text_column(batch)
            for a, b in slices(texts):
                _, at, doc, name = _edges(texts[a:b], ids[a:b], have, window, seed)
                new = np.ones(len(at), bool)
                new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(ids[a:b][doc[new]])], ["name", "doc_id"])

    seen = docs.select("doc_id", "text").mapInArrow(run, "name long, doc_id long")
    return seen.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name")


def _later(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by edge and document, and in that order whether the edge has a smaller document."""
    order = np.lexsort((doc, check, key))
    k, c, d = key[order], check[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    return order, d > np.repeat(d[first], np.diff(np.append(first, len(k))))


_EDGES = "bucket int, key array<long>, check array<int>, place array<int>, doc array<long>, row array<long>, run array<int>"
_MARKS = "bucket int, place array<int>, doc array<long>, row array<long>, run array<int>"


def _dealt(bucket: np.ndarray, values: list[np.ndarray], doc: np.ndarray, row: np.ndarray) -> list[pa.Array]:
    """Rows gathered to one row a bucket; document and row are given once for each run of equal ones."""
    order = np.lexsort((row, doc, bucket))
    bucket, doc, row = bucket[order], doc[order], row[order]
    names, first = np.unique(bucket, return_index=True)
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    runs = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(bucket)), pa.int32())
    by_run = pa.array(np.append(np.searchsorted(runs, first), len(runs)), pa.int32())
    lengths = np.diff(np.append(runs, len(bucket))).astype(np.int32)
    return [pa.array(names, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in values), *(pa.ListArray.from_arrays(by_run, pa.array(v)) for v in (doc[runs], row[runs], lengths))]


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _empty_lists(n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], kind))


def _flat(table, name: str) -> np.ndarray:
    return pa.compute.list_flatten(table.column(name)).to_numpy()


def repeated_places(docs: DataFrame, marks, buckets: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Marked edges by document bucket: (bucket, place, doc, row, run), packed in arrays."""
    bits = docs.sparkSession.sparkContext.broadcast(bitset(shared_minimizers(docs, marks, window, seed), "name"))
    names = [c.split()[0] for c in _EDGES.split(", ")]

    def ship(batches):
        have, path_marks = np.frombuffer(bits.value, np.uint8), np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            ids, rows, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), text_column(batch)
            parts = []
            for a, b in slices(texts):
                p, at, owner, name = _edges(texts[a:b], ids[a:b], path_marks, window, seed)
                words, h, known = p.words, p.hashes, has_bits(have, name)
                at, owner = at[known], owner[known]
                parts.append((ngrams(h, window)[at].view(np.int64), (ngrams(h, window, salt=0x6A09E667F3BCC909)[at] & np.uint64(0x7FFFFFFF)).astype(np.int32), (at - words.first[owner]).astype(np.int32), ids[a:b][owner], rows[a:b][owner]))
            key, check, place, doc, row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([],) * 5
            if not len(key):
                continue
            order, later = _later(key, check, doc)
            sent, marked = order[~later], order[later]  # of equal edges here, the smallest document's travel
            yield pa.RecordBatch.from_arrays(_dealt(_bucket(key[sent], buckets), [key[sent], check[sent], place[sent]], doc[sent], row[sent]), names)
            if len(marked):
                cols = _dealt(_bucket(row[marked], buckets), [place[marked]], doc[marked], row[marked])
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([cols[0], _empty_lists(n, pa.int64()), _empty_lists(n, pa.int32()), *cols[1:]], names)

    def meet(table: pa.Table) -> pa.Table:
        lengths = [pa.compute.list_value_length(table.column(c)).to_numpy() for c in ("key", "place")]
        is_edge = np.repeat(lengths[0] > 0, lengths[1])
        run = _flat(table, "run")
        doc, row, place = np.repeat(_flat(table, "doc"), run), np.repeat(_flat(table, "row"), run), _flat(table, "place")
        order, later = _later(_flat(table, "key"), _flat(table, "check"), doc[is_edge])
        keep = np.concatenate((np.flatnonzero(is_edge)[order[later]], np.flatnonzero(~is_edge)))
        return pa.table(_dealt(_bucket(row[keep], buckets), [place[keep]], doc[keep], row[keep]), ["bucket", "place", "doc", "row", "run"])

    edges = docs.select("doc_id", "row", "text").mapInArrow(ship, _EDGES)
    return edges.groupBy("bucket").applyInArrow(meet, _MARKS)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _strip(ids, rows, packed: list[bytes], marks: dict, full: bool):
    unpack = zstandard.ZstdDecompressor().decompress
    out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    for i, (doc, row) in enumerate(zip(ids, rows, strict=True)):
        words = unpack(packed[i]).split()  # white space of bytes: 0x20, 0x09-0x0D
        covered = marks.get((doc, row))
        kept = words
        if covered is not None:  # spans and marked edges, merged where they overlap
            turn = np.zeros(len(words) + 1, np.int32)
            np.add.at(turn, covered[0], 1)
            np.add.at(turn, covered[1], -1)
            kept = list(compress(words, (np.cumsum(turn)[: len(words)] == 0).tolist()))
        text = b" ".join(kept)
        out["doc_id"].append(doc)
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(kept))
        out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
        out["kept"].append(text.decode() if full else None)
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.string()} if full else {})
    return pa.table({k: pa.array(out[k], t) for k, t in types.items()})


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with ``full`` also the kept text): one row per document.

    A word is removed if a window of ``window`` words covers it that also starts in a document with a smaller doc_id.
    Null texts have no words. Documents without a doc_id are kept whole and count for no other. Rows that share a
    doc_id are no smaller than each other, so neither removes words of the other. Other columns are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    known = docs.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(total // BUCKET_BYTES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    paths = written(graph(known, window), "paths")
    bits = spark.sparkContext.broadcast(bitset(paths.select("mark"), "mark"))
    long = spans(known, paths.where("key is not null"), bits, window)
    single = repeated_places(known, bits, buckets, window, seed).withColumn("stop", F.transform("place", lambda x: x + window))

    def deal(batches):
        for batch in batches:
            doc, row, start, stop = (batch.column(i).to_numpy() for i in range(4))
            if len(doc):
                yield pa.RecordBatch.from_arrays(_dealt(_bucket(row, buckets), [start, stop], doc, row), ["bucket", "place", "stop", "doc", "row", "run"])

    dealt = long.select("doc_id", "row", "start", "stop").mapInArrow(deal, "bucket int, place array<int>, stop array<int>, doc array<long>, row array<long>, run array<int>")
    marks = single.unionByName(dealt)

    def number(batches):
        pack = zstandard.ZstdCompressor(level=3).compress  # texts travel packed: half of what the shuffle would make of them
        for batch in batches:
            ids = batch.column(0)
            packed = pa.array([pack(t) for t in text_column(batch).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, packed, batch.column(2), pa.array(_bucket(batch.column(2).to_numpy(), buckets), pa.int32())], ["doc_id", "packed", "row", "bucket"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict = {}
        if len(right):
            run = _flat(right, "run")
            doc, row, place, stop = np.repeat(_flat(right, "doc"), run), np.repeat(_flat(right, "row"), run), _flat(right, "place"), _flat(right, "stop")
            order = np.lexsort((row, doc))
            doc, row, place, stop = doc[order], row[order], place[order], stop[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            by = {(d, r): p for d, r, *p in zip(doc[first].tolist(), row[first].tolist(), np.split(place, first[1:]), np.split(stop, first[1:]), strict=True)}
        return _strip(left.column("doc_id").to_pylist(), left.column("row").to_pylist(), left.column("packed").to_pylist(), by, full)

    def whole(batches):  # rows without doc_id meet nothing: they stay where they are
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [pack(t) for t in text_column(batch).cast(pa.binary()).to_pylist()]
            yield from _strip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), packed, {}, full).to_batches()

    schema = RESULT + (", kept string" if full else "")
    numbered = known.mapInArrow(number, "doc_id long, packed binary, row long, bucket int")
    out = numbered.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(finish, schema)
    return out.unionByName(docs.where("doc_id is null").mapInArrow(whole, schema))
