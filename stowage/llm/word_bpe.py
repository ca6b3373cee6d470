"""Encoding and decoding with a word-end BPE tokenizer through a table of distinct words.

Words are split in tasks and counted per distinct word; every distinct word is encoded once; ids come back to their
positions by looking the words up. The most frequent words, up to ``table_words`` of them, form a table of bounded
size that is broadcast; documents with rarer words get those through a shuffled join on the word, so nothing depends
on the vocabulary being small. Decoding looks every id up in the fixed id-to-piece table.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE_VALUES, _power, mix, raw, slices, text_column, written
from .token_count import byte_alphabet, merge

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Vocabulary:
    """The tokenizer's merges, its special strings and its pieces by id."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.byte, self.last = [vocab[c] for c in alphabet], [vocab[c + end] for c in alphabet]
        self.pairs: dict = {}
        for rank, (a, b) in enumerate(p if isinstance(p, list) else p.split(" ") for p in model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: p for p, i in (vocab | self.special).items()}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = tuple(self.special)

    def words(self, text: str) -> list[str]:
        """Normalised words; a special string in the text is a word of its own."""
        if any(m in text for m in self.marks):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else _plain(part))]
        return _plain(text)

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        data = word.encode()
        return merge([*(self.byte[b] for b in data[:-1]), self.last[data[-1]]], self.pairs)


def _plain(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower case goes character by character: no final sigma
        text = text.replace("Σ", "σ")
    return WORD.findall(text.lower())


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = raw(words)
    n = len(data)
    if not n:
        return np.zeros(len(words), np.uint64)
    sums = np.add.reduceat(_BYTE_VALUES[data] * _power(_BASE, n), offsets[:-1])  # no word is empty
    return mix(sums * _power(pow(_BASE, -1, 1 << 64), n)[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def distinct_words(docs: DataFrame, path: str, flush: int = 250_000) -> DataFrame:
    """word, n: pre-aggregated in each task, so that only distinct words of a task are shuffled."""

    def run(batches):
        v, seen = vocabulary(path), Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for t in text_column(batch):
                seen.update(v.words(t.as_py()))
                if len(seen) > flush:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word, n, hash, ids (packed little-endian uint32): every distinct word is encoded here and nowhere else."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            col = batch.column(0)
            ids = [np.array(v.encode(w), "<u4").tobytes() for w in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([col, batch.column(1), pa.array(word_hashes(col).view(np.int64), pa.int64()), pa.array(ids, pa.binary())], ["word", "n", "hash", "ids"])

    return words.mapInArrow(run, "word string, n long, hash long, ids binary")


class Table:
    """Broadcast form of the frequent words: sorted hashes, and where the ids of each lie."""

    def __init__(self, found: pa.Table):
        hashes = found.column("hash").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(hashes)
        ids = found.column("ids").combine_chunks().take(pa.array(order))
        data, offsets = raw(ids.cast(pa.large_binary()).view(pa.large_string()))
        self.hashes, self.first = hashes[order], (offsets // 4).astype(np.int32 if len(data) < 1 << 32 else np.int64)
        flat = data.view("<u4")
        self.ids = flat.astype(np.uint16) if not len(flat) or flat.max() < 1 << 16 else flat
        if len(hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words share a 64-bit hash; give word_hashes another base")


def _least_count(words: DataFrame, most: int) -> int:
    """Smallest count whose words number at most ``most``; from a histogram of counts, not a global sort."""
    total, least = 0, None
    for r in sorted(words.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        total += r["count"]
        if total > most:
            break
        least = r["n"]
    return least if least is not None else np.iinfo(np.int64).max


def _encode(texts: pa.Array, v: Vocabulary, table: Table, rare: list | None = None):
    """ids of all texts end to end, offsets by text; and the (text, position, word) that the table lacks."""
    lists = [v.words(t) for t in texts.to_pylist()]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    h = word_hashes(coded.dictionary)
    at = np.minimum(np.searchsorted(table.hashes, h), max(len(table.hashes) - 1, 0))
    known = table.hashes[at] == h if len(table.hashes) else np.zeros(len(h), bool)
    first = np.where(known, table.first[at], 0).astype(np.int64)
    size = np.where(known, table.first[at + 1] - table.first[at], 0).astype(np.int64) if len(table.hashes) else np.zeros(len(h), np.int64)
    first, size, ids = first[index], size[index], table.ids
    missing = np.flatnonzero(~known[index])
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, missing, side="right")
    place = missing - (ends - counts)[doc]
    if rare is not None and len(missing):  # ids of rarer words, joined by position
        extra = [np.frombuffer(rare[d][int(p)], "<u4") for d, p in zip(doc, place, strict=True)]
        size[missing] = [len(x) for x in extra]
        first[missing] = len(ids) + np.cumsum([0, *map(len, extra)])[:-1]
        ids = np.concatenate([ids, *extra])
    total = np.concatenate(([0], np.cumsum(size)))
    flat = ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])].astype("<u4") if total[-1] else np.zeros(0, "<u4")
    return flat, total[np.concatenate(([0], ends))], [(int(d), int(p), lists[d][p]) for d, p in zip(doc, place, strict=True)] if rare is None else []


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, table_words: int = 6_000_000, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with ``full`` also ids and decoded: one row per document.

    Null and empty texts have no ids and decode to an empty text. doc_id may be null or repeated; rows are kept
    apart. Only ``doc_id`` and ``text`` are read. ``table_words`` bounds what is broadcast (about 20 bytes a word)."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    words = written(encode_words(distinct_words(docs, path), path), "words")
    least = _least_count(words, table_words)
    table = spark.sparkContext.broadcast(Table(words.where(F.col("n") >= least).select("hash", "ids").toArrow()))
    rest = words.where(F.col("n") < least)

    def finish(ids, flat, offsets):
        v = vocabulary(path)
        pieces = pa.array(v.pieces, pa.string()).take(pa.array(flat, pa.uint32()))
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), " ").to_pylist()
        parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        cols = [ids, pa.array([len(x) for x in parts], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in parts], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
        if full:
            cols += [pa.array([x.tolist() for x in parts], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        return cols

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]
    schema = DIGEST + (", ids array<int>, decoded string" if full else "")

    def in_place(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = text_column(batch)
            for a, b in slices(texts, 1 << 20):
                flat, offsets, _ = _encode(texts[a:b], v, table.value, [{}] * (b - a))
                yield pa.RecordBatch.from_arrays(finish(batch.column(0)[a:b], flat, offsets), names)

    if not rest.take(1):
        return docs.mapInArrow(in_place, schema)

    def with_rare(batches):  # each document with its rarer words by position
        v = vocabulary(path)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.string())]))
        for batch in batches:
            texts = text_column(batch)
            for a, b in slices(texts, 1 << 20):
                rare = [[] for _ in range(b - a)]
                for d, p, w in _encode(texts[a:b], v, table.value)[2]:
                    rare[d].append({"pos": p, "word": w})
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], texts[a:b], pa.array(rare, kind)], ["doc_id", "text", "rare"])

    def joined(batches):
        v = vocabulary(path)
        for batch in batches:
            texts, rare = text_column(batch), batch.column(2)
            for a, b in slices(texts, 1 << 20):
                by = [{x["pos"]: x["ids"] for x in (r.as_py() or ())} for r in rare[a:b]]
                flat, offsets, _ = _encode(texts[a:b], v, table.value, by)
                yield pa.RecordBatch.from_arrays(finish(batch.column(0)[a:b], flat, offsets), names)

    found = docs.mapInArrow(with_rare, "doc_id long, text string, rare array<struct<pos:int,word:string>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "rare")
    positions = found.select("row", F.explode("rare").alias("r")).select("row", "r.pos", "r.word")
    looked_up = positions.join(rest.select("word", "ids"), "word").groupBy("row").agg(F.collect_list(F.struct("pos", "ids")).alias("rare"))
    return found.select("row", "doc_id", "text").join(looked_up, "row", "left").select("doc_id", "text", "rare").mapInArrow(joined, schema)
