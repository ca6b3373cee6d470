"""Secret scan: Aho-Corasick finds keywords, anchored patterns run only at its hits, checksums confirm token formats."""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_column

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that end in a checksum of their own: prefix, 30 random characters, 6 characters of base-62 CRC-32.
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 3}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_automata: list = []


def _automaton():
    if not _automata:
        a = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of the random part of a token."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(6, "0")


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; ``kind`` indexes KINDS."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: offsets stay
    hits = sorted((end - length + 1, kind) for end, (length, kind) in _automaton().iter(lowered))
    spans, after = [], [0, 0, 0, 0]
    for start, kind in hits:
        if start < after[kind]:
            continue
        m = (ASSIGN, ACCESS, None, TOKEN)[kind].match(text, start)
        if not m:
            continue
        if kind == 3 and checksum(m[1]) != m[2]:
            continue
        after[kind] = m.end()
        if kind == 0 and m.end(2) - m.start(2) < 12 or kind == 1 and m.end() - start < 18:
            continue
        spans.append((start, kind, m.end()))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, spans array<struct<start:int,stop:int,kind:string>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans_text string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its spans (code points, end exclusive), counts of the base kinds and a digest of the base spans.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows give repeated results.
    Only ``doc_id`` and ``text`` are read."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch)
            spans = [find_spans(t.as_py()) for t in texts]
            base = [[x for x in s if x[1] < 3] for s in spans]
            cols = [ids, pa.array([[{"start": s, "stop": e, "kind": KINDS[k]} for s, k, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])))]
            cols += [pa.array([sum(x[1] == k for x in s) for s in base], pa.int64()) for k in range(3)]
            cols += [pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in base], pa.string()), pa.array(map(listed, spans), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans_text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark. Columns stay as they are.

    ``n_chars``, where there is one, follows the new text. A null text stays null."""
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, sizes, changed = [], [], False
            for t in batch.column(at):
                t = t.as_py()
                if t is not None and (spans := find_spans(t)):
                    out, done = [], 0
                    for s, _, e in spans:
                        if s >= done:
                            out += [t[done:s], mark]
                        done = max(done, e)
                    t, changed = "".join([*out, t[done:]]), True
                    sizes.append(len(t))
                else:
                    sizes.append(None)
                texts.append(t)
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if "n_chars" in names:
                    k = batch.schema.get_field_index("n_chars")
                    new = pa.array(sizes, pa.int64()).cast(batch.schema.field(k).type)
                    batch = batch.set_column(k, batch.schema.field(k), pa.compute.coalesce(new, batch.column(k)))
            yield batch

    return docs.mapInArrow(run, schema)
