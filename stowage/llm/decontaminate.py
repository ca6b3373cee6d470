"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into windows of two lengths whose starts lie no further apart than the edits allowed, so every
quote of ``QUOTE`` bytes or more is within those edits of some window. A region of a document within ``e`` edits of a
window of ``n`` bytes shares at least ``n - q + 1 - q * e`` q-grams with it, all within ``e`` neighbouring diagonals.
Shared q-grams are counted in overlapping diagonal bands of the whole item; windows that reach the bound inside a band
are verified by alignment inside the band. Items too short for that are matched exactly, as whole words.
Texts are compared with A-Z in lower case and runs of white space as one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, raw, slices, text_column

Q = 8
#: Shortest part of an item that is always found, in normalised bytes.
QUOTE = 64
#: Lengths of windows and bytes between their starts; more edits in one place pass the longer ones.
KINDS = ((QUOTE, 4), (96, 8))
#: Edits allowed: one for each so many bytes of a window.
BYTES_PER_EDIT = 12
#: Items of fewer normalised bytes are matched exactly and as whole words: an edit would make them other phrases.
LEAST = 32
_MULT, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and the place of each byte in the raw bytes."""
    data, offsets = raw(texts)
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.flatnonzero(keep)
    out = _LOWER[data[places]]
    out[space[places]] = 0x20
    return out, np.searchsorted(places, offsets), places


def grams(data: np.ndarray) -> np.ndarray:
    """Every 8 bytes as one number, without a copy."""
    data = np.ascontiguousarray(data)
    return np.ndarray(max(len(data) - Q + 1, 0), "<u8", buffer=data.data if len(data) else b"\0" * 8, strides=(1,)) if len(data) >= Q else np.zeros(0, "<u8")


class Parts:
    """Texts of windows, cut from the items when asked for."""

    def __init__(self, data: bytes, begin: np.ndarray, size: np.ndarray):
        self.data, self.begin, self.size = data, begin, size

    def __len__(self) -> int:
        return len(self.begin)

    def __getitem__(self, x: int) -> bytes:
        return self.data[self.begin[x] : self.begin[x] + self.size[x]]


@dataclass
class Windows:
    """Windows of a block of items, an index of the items' q-grams, and the items that are too short for windows."""

    item: np.ndarray
    text: Parts
    edits: np.ndarray
    least: np.ndarray
    #: By kind: first window, number of windows, their size and the last one's start, for each long item.
    tracks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    start: np.ndarray
    longest: int
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    #: By length: hashes of short items, and the numbers of the items of each text.
    short: dict[int, tuple[np.ndarray, dict[bytes, list[int]]]]

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Windows:
        ids, whole, brief = [], [], {}
        for i, t in items:
            data, _, _ = normalised(pa.array([t], pa.string()))
            text = data.tobytes().strip()
            if len(text) >= LEAST:
                ids.append(i)
                whole.append(text)
            elif text:
                brief.setdefault(len(text), {}).setdefault(text, []).append(i)
        sizes = np.array([len(t) for t in whole], np.int64)
        ids, starts = np.array(ids, np.int64), np.concatenate(([0], np.cumsum(sizes)))
        item, begin, own, size, tracks, n = [], [], [], [], [], 0
        for k, (length, stride) in enumerate(KINDS):
            fit = np.minimum(sizes, length)
            last = sizes - fit
            count = -(-last // stride) + 1
            if k:
                count[sizes <= KINDS[k - 1][0]] = 0  # the same window again
            base = n + np.concatenate(([0], np.cumsum(count)))[:-1].astype(np.int64)
            who = np.repeat(np.arange(len(sizes)), count)
            at = np.minimum((np.arange(len(who)) + n - base[who]) * stride, last[who])
            item.append(ids[who])
            own.append(at)
            begin.append(starts[who] + at)
            size.append(fit[who])
            tracks.append((base, count, fit, last))
            n += len(who)
        size = np.concatenate(size)
        edits = size // BYTES_PER_EDIT
        data = b"".join(whole)
        flat = grams(np.frombuffer(data, np.uint8))
        owner = np.repeat(np.arange(len(sizes)), sizes)[: len(flat)]
        place = np.arange(len(flat)) - starts[owner]
        inside = place <= sizes[owner] - Q
        flat, owner, place = flat[inside], owner[inside], place[inside]
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        slots = np.zeros(1 << _SLOTS, bool)
        slots[((keys * _MULT) >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        short = {m: (np.unique([_spots(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), m)[0] for t in texts]), texts) for m, texts in brief.items()}
        return Windows(
            np.concatenate(item), Parts(data, np.concatenate(begin), size), edits, np.maximum(size - Q + 1 - Q * edits, 1), tracks, np.concatenate(own), int(sizes.max(initial=0)),
            keys, np.append(first, len(flat)), owner[order], place[order], slots, short,
        )


def align(w: Windows, x: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window against any part of its region of the data, and where the first such part ends.

    Myers' bit vectors, one step a byte of the regions, in two words: windows have at most 128 bytes."""
    one, carry = np.uint64(1), np.uint64(63)
    text = np.frombuffer(w.text.data, np.uint8)
    own, who = np.unique(x, return_inverse=True)
    size = w.text.size[own]
    masks = np.zeros((2, len(own), 256), np.uint64)
    for j in range(int(size.max())):
        u = np.flatnonzero(size > j)
        masks[j >> 6, u, text[w.text.begin[own[u]] + j]] |= one << np.uint64(j & 63)
    size = size[who]
    upper, bit = size > 64, (size - 1 & 63).astype(np.uint64)
    up0 = up1 = np.full(len(x), ~np.uint64(0))
    down0 = down1 = np.zeros(len(x), np.uint64)
    score, length = size.copy(), high - low
    best, end = score.copy(), np.zeros(len(x), np.int64)
    for j in range(int(length.max(initial=0))):
        c = data[np.minimum(low + j, len(data) - 1)]
        eq0, eq1 = masks[0, who, c], masks[1, who, c]
        xv0, xv1 = eq0 | down0, eq1 | down1
        sum0 = (eq0 & up0) + up0
        sum1 = (eq1 & up1) + up1 + (sum0 < up0)
        xh0, xh1 = (sum0 ^ up0) | eq0, (sum1 ^ up1) | eq1
        ph0, ph1 = down0 | ~(xh0 | up0), down1 | ~(xh1 | up1)
        mh0, mh1 = up0 & xh0, up1 & xh1
        score = score + ((np.where(upper, ph1, ph0) >> bit) & one).astype(np.int64) - ((np.where(upper, mh1, mh0) >> bit) & one).astype(np.int64)
        better = (score < best) & (j < length)
        best[better], end[better] = score[better], j + 1
        ph0, ph1 = ph0 << one, ph1 << one | ph0 >> carry
        mh0, mh1 = mh0 << one, mh1 << one | mh0 >> carry
        up0, up1 = mh0 | ~(xv0 | ph0), mh1 | ~(xv1 | ph1)
        down0, down1 = ph0 & xv0, ph1 & xv1
    return best, end


def _spots(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = (out ^ data[at + j].astype(np.uint64)) * _MULT
        out ^= out >> np.uint64(29)
    return out


_ASCII_WORD = np.array([chr(c).isalnum() and c < 128 or c == 95 for c in range(256)])
#: Scripts that don't put spaces between words: Thai to Lao, Burmese, Khmer, kana, Han.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _in_word(c: str) -> bool:
    return (c.isalnum() or c == "_") and not any(a <= ord(c) <= b for a, b in _UNSPACED)


def _parted(left: bytes, right: bytes) -> bool:
    """Whether a word ends between two pieces of text."""
    before, after = left.decode("utf-8", "ignore"), right.decode("utf-8", "ignore")
    return not (before and after and _in_word(before[-1]) and _in_word(after[0]))


def short_matches(data: np.ndarray, offsets: np.ndarray, w: Windows):
    """(row, item, start, stop) of short items that stand as whole words in normalised texts."""
    if not w.short or not len(data):
        return
    word = _ASCII_WORD[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~(word[1:] & word[:-1])
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1])
    ends = offsets[np.searchsorted(offsets, starts, side="right")]
    for size, (hashes, texts) in w.short.items():
        fits = starts + size <= ends
        at = starts[fits]
        at = at[edge[at + size]]
        at = at[np.isin(_spots(data, at, size), hashes)]
        for p in at.tolist():
            found = texts.get(data[p : p + size].tobytes())
            if not found:
                continue
            r = int(np.searchsorted(offsets, p, side="right")) - 1
            own = data[p : p + size].tobytes()
            if _parted(data[max(p - 4, offsets[r]) : p].tobytes(), own) and _parted(own, data[p + size : min(p + size + 4, offsets[r + 1])].tobytes()):
                for i in found:
                    yield r, i, p, p + size


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from ``low`` to ``high``, both included, with the place of its range."""
    count = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(low)), count)
    return of, low[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]


def matches(texts: pa.Array, w: Windows):
    """(row, item, window, edits, start byte, stop byte) of verified regions, bytes in the raw text of the row; window -1
    is a short item."""
    data, offsets, places = normalised(texts)
    for r, i, start, stop in short_matches(data, offsets, w):
        yield r, i, -1, 0, int(places[start]), int(places[stop - 1]) + 1
    n = len(data) - Q + 1
    if not len(w.keys) or n < 1:
        return
    keys = grams(data)
    hit = w.slots[((keys * _MULT) >> np.uint64(64 - _SLOTS)).astype(np.int64)]
    over = (offsets[1:, None] - np.arange(1, Q)).ravel()
    hit[over[(over >= 0) & (over < n)]] = False  # no q-gram over the end of a text
    reach, step = KINDS[-1][0] + int(w.edits.max()), max(int(w.edits.max()), 1)
    total = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    stop = np.minimum(np.arange(n) + reach, n)
    fewest = int(w.least.min())
    dense = np.flatnonzero((total[stop] - total[:n] >= fewest) & hit)
    if not len(dense):
        return
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, dense, 1)
    np.add.at(cover, stop[dense], -1)
    at = np.flatnonzero(hit & (np.cumsum(cover)[:n] > 0))
    k = np.searchsorted(w.keys, keys[at])
    k[k == len(w.keys)] = 0
    same = w.keys[k] == keys[at]
    at, k = at[same], k[same]
    of, entry = _spread(w.first[k], w.first[k + 1] - 1)
    place, owner, own = at[of], w.owner[entry], w.place[entry]
    band = (place - own + w.longest) // step + 1  # band b + 1 holds the diagonals from b * step on, 2 * step of them
    row = np.searchsorted(offsets, place, side="right") - 1
    both = np.concatenate(((owner << 32) | band, (owner << 32) | (band - 1)))
    rows, own = np.concatenate((row, row)), np.concatenate((own, own))
    order = np.lexsort((own, both, rows))
    both, rows, own = both[order], rows[order], own[order]
    if not len(both):
        return
    fresh = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]) | (rows[1:] != rows[:-1]))))
    size = np.diff(np.append(fresh, len(both)))
    fresh, size = fresh[size >= fewest], size[size >= fewest]
    if not len(fresh):
        return
    # places in the item, group by group, as one rising sequence
    of, members = _spread(fresh, fresh + size - 1)
    wide = w.longest + 1
    rising = of * wide + own[members]
    owner, band = both[fresh] >> 32, (both[fresh] & 0xFFFFFFFF) - 1
    low, high = own[fresh], own[fresh + size - 1]
    checks = []
    for (_, stride), (base, count, fit, last) in zip(KINDS, w.tracks, strict=True):
        first = -(-np.maximum(low + Q - fit[owner], 0) // stride)
        final = np.where(high >= last[owner], count[owner] - 1, np.minimum(high // stride, count[owner] - 1))
        g, j = _spread(np.where(count[owner] > 0, first, 1), np.where(count[owner] > 0, final, 0))
        x = base[owner[g]] + j
        shared = np.searchsorted(rising, g * wide + w.start[x] + w.text.size[x] - Q, side="right") - np.searchsorted(rising, g * wide + w.start[x], side="left")
        enough = shared >= w.least[x]
        checks.append((g[enough], x[enough]))
    g, x = (np.concatenate(c) for c in zip(*checks, strict=True))
    for a in range(0, len(g), BATCH):
        gs, xs = g[a : a + BATCH], x[a : a + BATCH]
        rs, edits, length = rows[fresh[gs]], w.edits[xs], w.text.size[xs]
        diagonal = band[gs] * step - w.longest + w.start[xs]
        low = np.maximum(diagonal - edits, offsets[rs])
        high = np.maximum(np.minimum(diagonal + 2 * step + length + edits, offsets[rs + 1]), low)
        best, end = align(w, xs, data, low, high)
        for k in np.flatnonzero(best <= edits).tolist():
            stop = int(low[k] + end[k])
            yield int(rs[k]), int(w.item[xs[k]]), int(xs[k]), int(best[k]), int(places[max(stop - int(length[k]), int(low[k]))]), int(places[stop - 1]) + 1


#: Windows verified at once.
BATCH = 4096
#: Bytes of item texts in one block: bounds what is broadcast and indexed at once.
BLOCK_BYTES = 16 << 20


def item_blocks(items: DataFrame, bytes_each: int = BLOCK_BYTES):
    """Lists of (item_id, text) of at most about ``bytes_each``; the driver never holds more than one."""
    block, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= bytes_each:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = "doc_id long, item_id long, start int, stop int, windows int, edits int"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Benchmark passages in documents: one row for each document and item it holds a passage of, with the passage's
    code points (end exclusive, from the first to the last region), its number of matched windows and least edits.

    Documents without a match have no row. Null and empty texts match nothing; a null doc_id stays null; equal rows
    give equal results. Null and empty items match nothing. Items beyond one block's size are
    compared block by block, each with a pass over the documents."""
    out = None
    for block in item_blocks(items):
        part = _find_block(docs, block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def _find_block(docs: DataFrame, block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        w = Windows.of(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_column(batch)
            rows = []
            for a, b in slices(texts):
                best: dict = {}
                for r, item, x, edits, start, stop in matches(texts[a:b], w):
                    best.setdefault((r, item), []).append((edits, start, stop, x))
                if not best:
                    continue
                data, offsets = raw(texts[a:b])
                for (r, item), found in sorted(best.items()):
                    own = data[offsets[r] : offsets[r + 1]]
                    start, stop = min(f[1] for f in found) - offsets[r], max(f[2] for f in found) - offsets[r]
                    lead = (own & 0xC0) != 0x80
                    rows.append({"doc_id": ids[a + r], "item_id": item, "start": int(lead[:start].sum()), "stop": int(lead[:stop].sum()), "windows": len({f[3] for f in found}), "edits": min(f[0] for f in found)})
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, FOUND)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("windows", pa.int32()), ("edits", pa.int32())])


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item, columns unchanged."""
    for block in item_blocks(items):
        docs = _drop_block(docs, block)
    return docs


def _drop_block(docs: DataFrame, block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        w = Windows.of(shared.value)
        for batch in batches:
            texts = text_column(batch)
            clean = np.ones(len(texts), bool)
            for a, b in slices(texts):
                for r, *_ in matches(texts[a:b], w):
                    clean[a + r] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
