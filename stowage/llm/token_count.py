"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers run one after the other. The splitting pattern of a byte-level BPE tokenizer is compiled
over character classes: each transition says whether a word ends before the current or the previous character. Inside a
word, a second one reads bytes: each transition is annotated with the tokens it adds to the count (fewer than none where
a longer token takes the place of several), see ``Counter``.

Texts are cut into chunks. Inside a task, small blocks of characters become state maps, which a parallel prefix scan
composes, so that every block knows the state it starts in. For a chunk that does not start its text that state is
unknown, so it gives one entry per possible state: where it ends, the tokens of the words that lie inside it, and its
open ends. Entries of a text's chunks compose in order.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
BLOCK = 64
# character classes
SPACE, WHITE, QUOTE, LETTER, SHORT, R, V, E, L, NUMBER, OTHER = range(11)
# states: after a closed word; in letters, numbers, others; after an opening quote and its r, v, l; in white space of
# one or of more characters whose last is a space or another one
CLOSED, IN_L, IN_N, IN_O, Q, QR, QV, QL, W1S, W2S, W1N, W2N = range(12)
STATES, CLASSES = 12, 11
HERE, BACK = 1, 2  # a word starts at the current, at the previous character


def _step(state: int, c: int) -> tuple[int, int]:
    letter = LETTER <= c <= L
    fresh = {SPACE: W1S, WHITE: W1N, QUOTE: Q, NUMBER: IN_N, OTHER: IN_O}.get(c, IN_L)
    if state in (W1S, W2S, W1N, W2N):
        if c in (SPACE, WHITE):
            return (W2S if c == SPACE else W2N), 0
        if state in (W1S, W2S):  # a last space goes with what follows
            return (IN_L if letter else IN_N if c == NUMBER else IN_O), BACK * (state == W2S)
        return fresh, HERE | BACK * (state == W2N)
    if state == IN_L and letter or state == IN_N and c == NUMBER:
        return state, 0
    if state in (IN_O, Q) and c in (OTHER, QUOTE):
        return IN_O, 0
    if state == Q and c == SHORT:
        return CLOSED, 0
    if state == Q and c in (R, V, L):
        return {R: QR, V: QV, L: QL}[c], 0
    if state in (QR, QV) and c == E or state == QL and c == L:
        return CLOSED, 0
    if state in (QR, QV, QL):  # no contraction: the quote stands alone
        return (IN_L, BACK) if letter else (fresh, BACK | HERE)
    return fresh, HERE


@lru_cache(1)
def _tables():
    """Next state and emission, flat by state and symbol. Symbols: class; class + 11 * (s + 1) for the first character
    of a piece that starts in state s; the last symbol leaves the state as it is."""
    symbols = CLASSES * (STATES + 1) + 1
    go, out = np.zeros((STATES, symbols), np.uint8), np.zeros((STATES, symbols), np.uint8)
    for s in range(STATES):
        for x in range(symbols - 1):
            go[s, x], out[s, x] = _step(s if x < CLASSES else x // CLASSES - 1, x % CLASSES)
        go[s, -1] = s
    return go.ravel(), out.ravel(), symbols


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        table[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), np.uint32)] = c
    table[0x20] = SPACE
    for chars, c in (("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[[ord(x) for x in chars]] = c
    return table


def word_starts(text: str, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces laid end to end in ``text``, beginning at ``first`` in states ``state``: a flag for each character
    that starts a word (bit 1) or, for a piece's first, says that its predecessor does (bit 2); the state after each."""
    go, out, symbols = _tables()
    n = len(text)
    x = _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    x[first] += (CLASSES * (state + 1)).astype(np.uint8)
    m = -(-n // BLOCK)
    grid = np.full(m * BLOCK, symbols - 1, np.uint8)
    grid[:n] = x
    grid = np.ascontiguousarray(grid.reshape(m, BLOCK).T).astype(np.int32)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.int32) * symbols, (m, STATES))
    scaled = go.astype(np.int32) * symbols
    for j in range(BLOCK):
        maps = scaled[maps + grid[j][:, None]]
    maps = maps // symbols
    step = 1
    while step < m:  # prefix scan: maps[i] becomes the map of blocks 0..i
        later = maps.copy()
        later[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        maps, step = later, step * 2
    s = np.zeros(m, np.int32)
    s[1:] = maps[:-1, 0] * symbols
    said, after = np.zeros((BLOCK, m), np.uint8), np.zeros((BLOCK, m), np.int32)
    for j in range(BLOCK):
        k = s + grid[j]
        said[j] = out[k]
        s = after[j] = scaled[k]
    said, after = said.T.ravel()[:n], (after // symbols).T.ravel()[:n]
    flags = said & HERE
    back = np.flatnonzero(said & BACK)
    opening = np.zeros(n, bool)
    opening[first] = True
    flags[back[~opening[back]] - 1] |= HERE
    flags[back[opening[back]]] |= BACK
    return flags, after


class Counter:
    """Transducer of the bytes of a word whose transitions say how many tokens each byte adds.

    A piece of byte-pair merging ends a word's encoding exactly if it meets the piece before it in an encoding of the
    two (neighbours decide: merges never cross the ends of final pieces). So a state is the set of tokens that may be
    under way: for each, its place in the trie of tokens, the token before it, and the count there less the present
    one. Such states are far too many to list beforehand, and the ones that texts reach are few: transitions are
    compiled when first met, kept in a hash table, and dropped together beyond ``limit``."""

    SHIFT, ZERO = 10, 512  # a value holds the next state and, in the low bits, what the byte adds plus 512
    FEW = 24  # words that go on longer than all but these go byte by byte

    def __init__(self, path: str, limit: int = 1 << 20):
        spec = json.load(open(path, encoding="utf-8"))["model"]
        vocab, self.limit = spec["vocab"], limit
        alphabet = byte_alphabet()
        self.byte = [vocab[c] for c in alphabet]
        self.pairs, self.parts, self.never = {}, {}, len(spec["merges"])
        self.proper, known = True, set(self.byte)  # proper: each token comes of one pair, after both parts
        for rank, pair in enumerate(spec["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            if (a, b) not in self.pairs:
                self.proper &= new not in known and a in known and b in known
                self.pairs[a, b], self.parts[new] = (rank, new), (rank, a, b)
                known.add(new)
        of = {c: b for b, c in enumerate(alphabet)}
        self.text = {i: bytes(of[c] for c in t) for t, i in vocab.items() if i in self.parts or t in of}
        self.child, self.token = [{}], [-1]
        for i, t in self.text.items():
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self._spines = {}
        self._clear()

    def _clear(self):
        start = array("i", (0, -1, 0)).tobytes()  # triples: trie node, token before, relative count
        self.states, self.number, self.fits, self.used = [start], {start: 0}, {}, 0
        self.keys, self.values = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at the left (1) or right (2) end of a token as it is merged; the rank that ends each."""
        if (token, side) not in self._spines:
            out, end, t = [], self.never, token
            while True:
                out.append((t, end))
                if t not in self.parts:
                    break
                end, t = self.parts[t][0], self.parts[t][side]
            self._spines[token, side] = out
        return self._spines[token, side]

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` after ``before`` (-1: at a word's start) is how their bytes are encoded."""
        key = (before + 1) << 32 | token
        if key not in self.fits:
            if before >= 0 and self.proper:  # no piece at the end of one meets a piece of the other in a merge
                met = ((self.pairs.get((a, b)), x, y) for a, x in self._spine(before, 2) for b, y in self._spine(token, 1))
                self.fits[key] = self._fits(-1, token) and not any(p and p[0] < x and p[0] <= y for p, x, y in met)
            else:
                both = [before, token] if before >= 0 else [token]
                self.fits[key] = merge([self.byte[x] for t in both for x in self.text[t]], self.pairs) == both
        return self.fits[key]

    def _compile(self, key: int) -> int:
        s, b = key >> 8, key & 255
        kept, token, more = [], None, 0
        state = iter(array("i", self.states[s]))
        for node, before, n in zip(state, state, state, strict=True):
            node = self.child[node].get(b)
            if node is None:
                continue
            if token is None and self.token[node] >= 0 and self._fits(before, self.token[node]):
                token, more = self.token[node], n + 1
            if self.child[node]:
                kept.append((node, before, n))
        state = array("i", [x for node, before, n in kept for x in (node, before, n - more)] + [0, token, 0]).tobytes()
        to = self.number.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        value = to << self.SHIFT | more + self.ZERO
        self.used += 1
        if 3 * self.used > len(self.keys):
            held = self.keys >= 0
            keys, values = self.keys[held], self.values[held]
            self.keys, self.values = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int64)
            for k, v in zip(keys.tolist(), values.tolist(), strict=True):
                self._put(k, v)
        self._put(key, value)
        return value

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 15) & len(self.keys) - 1

    def _put(self, key: int, value: int):
        at = self._slot(key)
        while self.keys[at] >= 0:
            at = at + 1 & len(self.keys) - 1
        self.keys[at], self.values[at] = key, value

    def _one(self, key: int) -> int:
        at = self._slot(key)
        while (k := self.keys[at]) != key:
            if k < 0:
                return self._compile(key)
            at = at + 1 & len(self.keys) - 1
        return int(self.values[at])

    def _many(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        value, new = self.values[at], []
        rest = np.flatnonzero(self.keys[at] != key)
        while len(rest):
            empty = self.keys[at[rest]] < 0
            new.append(rest[empty])
            rest = rest[~empty]
            at[rest] = at[rest] + 1 & len(self.keys) - 1
            value[rest] = self.values[at[rest]]
            rest = rest[self.keys[at[rest]] != key[rest]]
        if new and len(new := np.concatenate(new)):
            some, back = np.unique(key[new], return_inverse=True)
            value[new] = np.array([self._one(k) for k in some.tolist()], np.int64)[back]
        return value

    def _tail(self, data: bytes, state: int) -> int:
        n = 0
        for b in data:
            value = self._one(state << 8 | b)
            n, state = n + (value & 2 * self.ZERO - 1) - self.ZERO, value >> self.SHIFT
        return n

    def count(self, word: str) -> int:
        return self._tail(word.encode(), 0)

    def counts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens of the words ``data[start:stop]``, all of them a byte further at each step."""
        if self.used >= self.limit:
            self._clear()
        order = np.argsort(start - stop, kind="stable")
        at, long = start[order], (stop - start)[order]
        going = len(at) - np.cumsum(np.bincount(long)) if len(at) else [0]  # words of more than k bytes
        state, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(int(long[0]) if len(at) else 0):
            m = int(going[k])
            if m <= self.FEW:
                for i in range(m):
                    n[i] += self._tail(data[at[i] + k : at[i] + long[i]].tobytes(), int(state[i]))
                break
            value = self._many(state[:m] << 8 | data[at[:m] + k])
            n[:m] += (value & 2 * self.ZERO - 1) - self.ZERO
            state = value >> self.SHIFT
        out = np.empty(len(at), np.int64)
        out[order] = n
        return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge(ids: list[int], pairs: dict) -> list[int]:
    """Byte-pair merges: always the pair of least rank, leftmost first. Long words use a heap."""
    if len(ids) > 50:
        return _merge_long(ids, pairs)
    while len(ids) > 1:
        best = min(((pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs), default=None)
        if best is None:
            break
        (_, new), i = best
        ids[i : i + 2] = [new]
    return ids


def _merge_long(ids: list[int], pairs: dict) -> list[int]:
    n = len(ids)
    left, right, ids = list(range(-1, n - 1)), [*range(1, n), -1], list(ids)
    heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapify(heap)
    while heap:
        _, i, p = heappop(heap)
        j = right[i] if ids[i] >= 0 else -1
        if j < 0 or (ids[i], ids[j]) != p:
            continue
        ids[i], ids[j] = pairs[p][1], -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (q := (ids[a], ids[b])) in pairs:
                heappush(heap, (pairs[q][0], a, q))
    return [x for x in ids if x >= 0]


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def added_tokens(path: str) -> tuple[str, ...]:
    """The strings that the tokenizer in ``path`` takes as a token each wherever they occur, longest first."""
    return tuple(sorted((t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens") or ()), key=len, reverse=True))


ENTRY = "array<struct<stop:int,back:boolean,cut:boolean,inner:long,head:string,tail:string>>"
ENTRY_TYPE = pa.list_(pa.struct([("stop", pa.int32()), ("back", pa.bool_()), ("cut", pa.bool_()), ("inner", pa.int64()), ("head", pa.string()), ("tail", pa.string())]))


def _count_pieces(pieces: list[str], whole: list[bool], first: list[bool], counter: Counter):
    """Token count of each whole piece, else the entries of a piece for the states it may start in."""
    counts, entries = [0] * len(pieces), [None] * len(pieces)
    runs = [(k, s) for k, p in enumerate(pieces) if p for s in ((CLOSED,) if first[k] else range(STATES))]
    if not runs:
        return counts, entries
    sizes = np.array([len(pieces[k]) for k, _ in runs])
    at = np.concatenate(([0], np.cumsum(sizes)))
    text = "".join(pieces[k] for k, _ in runs)
    flags, after = word_starts(text, at[:-1], np.array([s for _, s in runs]))
    last, closing = after[at[1:] - 1], np.array([whole[k] for k, _ in runs])
    flags[at[1:][closing & (last >= QR) & (last <= QL)] - 1] |= HERE  # the text ends in a quote and a letter
    begin = np.flatnonzero(flags & HERE)
    bounds = np.searchsorted(begin, at)
    limits = np.append(begin[1:], len(text))
    limits = np.minimum(limits, at[np.searchsorted(at, begin, side="right")])
    data = np.frombuffer(text.encode(), np.uint8)
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character starts
    tokens = counter.counts(data, byte[begin], byte[limits])
    total = np.concatenate(([0], np.cumsum(tokens)))
    for i, (k, _) in enumerate(runs):
        lo, hi = bounds[i], bounds[i + 1]
        if whole[k]:
            counts[k] = int(total[hi] - total[lo])
            continue
        cut = hi > lo
        head = text[at[i] : begin[lo]] if cut else text[at[i] : at[i + 1]]
        entry = {"stop": int(last[i]), "back": bool(flags[at[i]] & BACK), "cut": bool(cut), "inner": int(total[hi - 1] - total[lo]) if cut else 0, "head": head, "tail": text[begin[hi - 1] : at[i + 1]] if cut else ""}
        entries[k] = [*(entries[k] or ()), entry]
    return counts, entries


def compose(entries, counter: Counter) -> int:
    """Tokens of a text from the entries of its chunks, in order."""
    state, open_word, n = CLOSED, "", 0
    for entry in entries:
        if not len(entry):
            continue
        e = entry[state if len(entry) > 1 else 0]
        if e["back"]:
            n, open_word = n + counter.count(open_word[:-1]), open_word[-1:]
        open_word += e["head"]
        if e["cut"]:
            n += counter.count(open_word) + e["inner"]
            open_word = e["tail"]
        state = e["stop"]
    if state in (QR, QV, QL):
        n, open_word = n + counter.count(open_word[:-1]), open_word[-1:]
    return n + counter.count(open_word)


def count_tokens(docs: DataFrame, path: str, special: tuple[str, ...] | None = None, chunk: int = CHUNK, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per document, of the byte-level BPE tokenizer in ``path``.

    Strings of ``special`` (None: those that the tokenizer's file adds) in a text are a token each. Null and empty texts have no tokens. A null doc_id stays null
    and repeated rows are counted each on its own, as a row number, not doc_id, holds chunks together. Only the
    chunks' counts and open ends are shuffled, never texts (a word longer than a chunk travels in pieces)."""
    special = added_tokens(path) if special is None else special
    stop = "|".join("\\Q" + s + "\\E" for s in special) or "(?!)"
    parts = F.split(F.coalesce("text", F.lit("")), stop, -1)
    row = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), parts.alias("parts"))
    cuts = F.flatten(F.transform("parts", lambda p, s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / chunk).cast("int") - 1, F.lit(0))), lambda i: F.struct(s.alias("part"), i.alias("chunk"), (F.length(p) <= chunk).alias("whole"), F.substring(p, i * chunk + 1, F.lit(chunk)).alias("piece")))))
    chunks = row.select("row", "doc_id", "n_bytes", (F.size("parts") - 1).alias("marks"), F.explode(cuts).alias("c")).select("row", "doc_id", "n_bytes", "marks", "c.*")

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            pieces, whole, nth = get("piece"), get("whole"), get("chunk")
            counts, entries, k = [], [], 0
            while k < len(pieces):
                size, stop_at = 0, k
                while stop_at < len(pieces) and (stop_at == k or size < 1 << 20):
                    size += len(pieces[stop_at]) * (1 if nth[stop_at] == 0 else STATES)
                    stop_at += 1
                c, e = _count_pieces(pieces[k:stop_at], whole[k:stop_at], [x == 0 for x in nth[k:stop_at]], counter)
                counts, entries, k = counts + c, entries + e, stop_at
            names = ["row", "doc_id", "n_bytes", "marks", "part", "chunk"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(counts, pa.int64()), pa.array(entries, ENTRY_TYPE)], [*names, "n", "entries"])

    counted = chunks.mapInArrow(run, f"row long, doc_id long, n_bytes long, marks int, part int, chunk int, n long, entries {ENTRY}")

    def join_chunks(parts: pd.Series) -> pd.Series:
        counter = _counter(path)
        out = []
        for chunks in parts:
            n, seen = 0, {}
            for c in chunks:
                seen.setdefault(c["part"], []).append(c)
            for own in seen.values():
                n += compose([c["entries"] for c in sorted(own, key=lambda c: c["chunk"])], counter)
            out.append(n)
        return pd.Series(out, dtype="int64")

    joined = F.pandas_udf(join_chunks, "long")
    split = F.when(F.col("entries").isNotNull(), F.struct("part", "chunk", "entries"))
    per_row = counted.groupBy("row", "doc_id", "n_bytes", "marks").agg(F.sum("n").alias("n"), F.collect_list(split).alias("open"))
    n = F.col("n") + F.col("marks") + F.when(F.size("open") > 0, joined(F.col("open"))).otherwise(F.lit(0))
    return per_row.select("doc_id", "n_bytes", n.cast("long").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
