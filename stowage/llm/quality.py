"""Quality classifier by compression: one zstandard dictionary from good and one from bad labelled text.

A text is cut into pieces; each is compressed with both dictionaries. The difference of the two sizes over their sum,
calibrated together with the compressed share of the text by a logistic fit on labelled rows that neither dictionary
has seen, gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # per feature, then the constant
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def scorer(self):
        if not self.good:
            flat = 1 / (1 + np.exp(-self.weights[-1]))
            return lambda text: float(flat)
        pair = _compressors(self.good, self.bad)
        w, c, s = map(np.array, (self.weights, self.center, self.scale))
        return lambda text: float(1 / (1 + np.exp(-np.clip((features(text, pair) - c) / s @ w[:-1] + w[-1], -30, 30))))


def _compressors(good: bytes, bad: bytes):
    out = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def _pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def features(text: str, pair) -> np.ndarray:
    """(difference over sum, good-compressed share, bad-compressed share), all over the whole text."""
    good, bad = pair
    g = b = n = 0
    for p in _pieces(text):
        g += len(good.compress(p))
        b += len(bad.compress(p))
        n += len(p)
    return np.array([(b - g) / (b + g), min(g / max(n, 1), 2.0), min(b / max(n, 1), 2.0)])


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(samples)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray):
    center, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - center) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w), tuple(center), tuple(scale)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, longest: int = 50_000) -> Model:
    """Fitted on at most ``rows`` labelled documents of each label, none over ``longest`` characters.

    These bounds are what reaches the driver, whatever the corpus holds; the rows of least hash are taken, and of texts
    that share a doc_id the one of least hash. Rows whose crc32(doc_id as text) mod 5 is 0 are never used. With under 4
    rows of a label, the score is the share of label 1."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: 2 * rows ids
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # a row for each id
    found = sorted((r.doc_id, r.text, r.quality) for r in one.select("doc_id", "t.text", "quality").collect())
    by = {q: [t for _, t, x in found if x == q] for q in (0, 1)}
    if min(map(len, by.values())) < 4:
        share = (len(by[1]) + 1) / (len(found) + 2)
        return Model(b"", b"", (float(np.log(share / (1 - share))),), (), ())
    good, bad = (_dictionary(by[q][::2]) for q in (1, 0))
    pair = _compressors(good, bad)
    rest = [(t, q) for q in (0, 1) for t in by[q][1::2]]
    # an equal bound for each label thins the common one: the constant is set back to the labels' own shares
    share = known.groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in share}
    weights, center, scale = _logistic(np.array([features(t, pair) for t, _ in rest]), np.array([q for _, q in rest], float))
    shift = np.log(counts[1] / counts[0]) - np.log(len(by[1]) / len(by[0]))
    return Model(good, bad, (*map(float, weights[:-1]), float(weights[-1] + shift)), tuple(map(float, center)), tuple(map(float, scale)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, over its whole text.

    A null text counts as empty; a null doc_id is not held out; other columns are never read."""

    def run(batches):
        f = model.scorer()
        for batch in batches:
            values = [f(t.as_py()) for t in text_column(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, columns unchanged."""

    def run(batches):
        f = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([f(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
