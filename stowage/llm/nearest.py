"""Approximate nearest neighbours by cross-polytope hashing.

A few fast Hadamard transforms with random signs rotate a unit vector; its hash is the signed axis nearest to it.
Every table has its own rotations. Candidates lie in one bucket of each table, queries probe the buckets of their
best axes; candidates of a bucket are split into blocks of bounded size, and each block reranks exactly and keeps the
best. Equal vectors are one candidate that carries its smallest ids. Queries that found too few get an exact pass.
Vectors of different lengths have no cosine; each length is searched among its own.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096
#: Queries whose scores against a block are held at once.
ASKED = 256
#: Vectors that a bucket should hold at most on average; from there on a table's hash takes one more rotation.
BUCKET = 2048


def hadamard(a: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = a.shape
    h = 1
    while h < d:
        pair = a.reshape(n, d // (2 * h), 2, h)
        a = np.concatenate((pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return a / np.sqrt(d)


def rotated(unit: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """Scores of the 2 * D signed axes under the pseudo-rotation of one table and part."""
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    a = np.zeros((len(unit), size))
    a[:, : unit.shape[1]] = unit
    for signs in np.random.default_rng((seed, table, part)).choice([-1.0, 1.0], (3, size)):
        a = hadamard(a * signs)
    return np.concatenate((a, -a), axis=1)


def buckets(unit: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, probes) bucket numbers, best first: combinations of the best axes of each part by total score."""
    axes, scores = [], []
    for part in range(hashes):
        s = rotated(unit, table, part, seed)
        best = np.argsort(-s, axis=1, kind="stable")[:, : max(probes, 1)]
        axes.append(best)
        scores.append(np.take_along_axis(s, best, 1))
    if hashes == 1:
        return axes[0].astype(np.int64)
    width = 2 * (1 << max(1, (unit.shape[1] - 1).bit_length()))
    combos = np.array([c for c in product(range(axes[0].shape[1]), repeat=hashes) if np.prod(np.array(c) + 1) <= probes])
    total = sum(scores[p][:, combos[:, p]] for p in range(hashes))
    code = sum(axes[p][:, combos[:, p]].astype(np.int64) * width**p for p in range(hashes))
    return np.take_along_axis(code, np.argsort(-total, axis=1, kind="stable")[:, :probes], 1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _best(queries, vectors, k: int):
    """Top ``k`` candidates of each query by cosine in double precision, ties to the smaller id; some queries at once."""
    q, c = _matrix(queries.column("embedding")), _matrix(vectors.column("embedding"))
    ids, low = vectors.column("class_id").to_numpy(), vectors.column("low").to_numpy()
    order = np.lexsort((ids, low))
    c, ids, low = c[order], ids[order], low[order]
    length, parts = np.linalg.norm(c, axis=1)[None, :], []
    for start in range(0, len(q), ASKED):
        some = q[start : start + ASKED]
        score = (some @ c.T) / (np.linalg.norm(some, axis=1)[:, None] * length)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        parts.append((top, np.take_along_axis(score, top, 1)))
    top, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"query_class": np.repeat(queries.column("class_id").to_numpy(), top.shape[1]), "class_id": ids[top].ravel(), "low": low[top].ravel(), "score": score.ravel()})


_FOUND = "query_class long, class_id long, low long, score double"


def parts_for(vectors: int, axes: int) -> int:
    """Rotations whose axes make up one hash, so that a bucket holds about ``BUCKET`` vectors however many there are."""
    parts = 1
    while vectors > BUCKET * axes**parts:
        parts += 1
    return parts


def search(vectors: DataFrame, queries, k: int = 5, tables: int = 16, probes: int = 8, hashes: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``vectors(vec_id, embedding)`` that the
    condition ``queries`` picks, among all other rows of the same length, nearest first, ties to the smaller vec_id.

    Rows whose vector is null, empty, zero, or holds null or non-finite components take no part, nor do null ids. A
    repeated vec_id counts once for each distinct vector. Other columns are not read. ``hashes`` rotations make a hash
    (by default as many as the number of vectors asks for); each beyond the first multiplies the probes by 8."""
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(valid)
    # equal vectors become one class with its k + 1 smallest ids; more can't be among anyone's k nearest
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a vec_id may stand for several vectors, so a class is named by a number of its own
    classes = written(classes.select(F.monotonically_increasing_id().alias("class_id"), F.col("ids")[0].alias("low"), "ids", F.size("embedding").alias("dim"), "embedding"), "vectors")
    lengths = classes.groupBy("dim").agg(F.count("*").alias("total"))
    asked = rows.where(queries).select("embedding").distinct()
    asked_class = written(asked.join(classes, "embedding").select("class_id", "low", "dim", "embedding"), "asked")  # one row a distinct query vector
    if hashes is None:
        most = lengths.agg(F.max(F.struct("total", "dim")).alias("m")).first().m
        hashes = parts_for(most.total, 2 << max(1, (most.dim - 1).bit_length())) if most else 1

    def hashed(number):
        def run(batches):
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    unit = _matrix(part.column(2))
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    for t in range(tables):
                        b = buckets(unit, t, hashes, number, seed)
                        for j in range(b.shape[1]):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t), pa.int32()), pa.array(b[:, j], pa.int64()), part.column(1), part.column(0), part.column(3), part.column(2)], ["tab", "bucket", "dim", "class_id", "low", "embedding"])

        return run

    kind = dict(classes.dtypes)["embedding"]
    schema = f"tab int, bucket long, dim int, class_id long, low long, embedding {kind}"
    stored = classes.select("class_id", "dim", "embedding", "low").mapInArrow(hashed(1), schema)
    probed = asked_class.select("class_id", "dim", "embedding", "low").mapInArrow(hashed(probes * 8 ** (hashes - 1)), schema)
    # a large bucket is split into blocks: its candidates are dealt to them, its queries visit each. Only large buckets
    # (at most a row for BLOCK rows of a table) are looked up, and it is they that are broadcast: Spark takes the rows of
    # ``probed`` for as few as the queries and would send those, vectors and all, through the driver
    place = ["tab", "bucket", "dim"]
    large = stored.groupBy(*place).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select(*place, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    large, blocks = F.broadcast(written(large, "large")), F.coalesce("blocks", F.lit(1))
    stored = stored.join(large, place, "left").withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
    probed = probed.join(large, place, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = [*place, "block"]
    empty = pa.table({"query_class": pa.array([], pa.int64()), "class_id": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def rerank(asking: pa.Table, there: pa.Table) -> pa.Table:
        return _best(asking, there, k + 1) if len(asking) and len(there) else empty

    found = probed.select(*key, "class_id", "embedding").groupBy(*key).cogroup(stored.select(*key, "class_id", "low", "embedding").groupBy(*key)).applyInArrow(rerank, _FOUND)
    found = _top(found, k + 1)
    found = written(found, "found")
    # an exact pass over all blocks for queries that collected fewer than there are
    counts = found.groupBy("query_class").count().withColumnRenamed("query_class", "class_id")
    short = asked_class.join(lengths, "dim").join(counts, "class_id", "left").where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k + 1), "total"))
    if short.take(1):
        n = F.ceil(F.col("total") / BLOCK).cast("int")
        everywhere = short.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).select("class_id", "embedding", "dim", "block")
        dealt = classes.join(lengths, "dim").select("class_id", "low", "embedding", "dim", F.pmod(F.xxhash64("class_id"), n).cast("int").alias("block"))
        exact = everywhere.groupBy("dim", "block").cogroup(dealt.groupBy("dim", "block")).applyInArrow(rerank, _FOUND)
        found = _top(found.union(exact), k + 1)
    listed = found.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    every = rows.where(queries).select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(asked_class.select(F.col("class_id").alias("query_class"), "embedding"), "embedding").select("query_id", "query_class")
    pairs = every.join(listed, "query_class").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_class").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_class", "class_id", "low").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "low", "class_id"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")
