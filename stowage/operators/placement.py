"""Payload placement and running offsets.

Offsets are running sums by archive. So that one archive with a third of all rows is not one task, a running sum goes
in two levels: rows are summed by blocks of their ordinal, blocks get their base from a window over few block rows,
and only within a block does a window see the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import hot

#: Ordinals whose rows share a task when running sums are taken.
ORDINALS = 4096


def running_offset(rows: DataFrame, archive: str, ord_: str, size: str, name: str = "offset", base: int = 0, block: int = ORDINALS) -> DataFrame:
    """Adds the sum of ``size`` over the rows of the archive with a smaller ordinal, plus ``base``.

    Ordinals are unique in an archive; null sizes count as 0."""
    b = F.floor(F.col(ord_) / block).cast("long")
    sized = rows.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_block", b)
    sums = sized.groupBy(archive, "_block").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(archive).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(archive, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(archive, "_block").orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(bases, [archive, "_block"]).withColumn(name, (F.lit(base) + F.col("_base") + F.coalesce(F.sum("_size").over(inner), F.lit(0))).cast("long"))
    return out.select(*rows.columns, name)


#: Entries of one payload that are compared with its first in one task.
TOGETHER = 256


def place(entries: DataFrame, archive: str, ord_: str, payload: str, facts: tuple[str, ...] = (), share: bool = True, base: int = 0) -> DataFrame:
    """``entries`` with size, rep (ordinal of the entry whose payload is stored), offset and shared.

    Entries of an archive whose payloads are equal, and whose ``facts`` are, are stored once, where the first stands.
    Length and hash narrow the search, the bytes decide: only payloads of which another entry has length and hash are
    shuffled, a payload that many have in parts of ``TOGETHER`` entries. Empty payloads take the cursor and do not move
    it. Null payloads count as empty. With ``share`` off every entry is stored. Ordinals are unique in an archive; rows
    without archive or ordinal have no place and are left out."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    facts_key = {f"_f{i}": F.coalesce(F.col(f).cast("string"), F.lit("")) for i, f in enumerate(facts)}
    keyed = entries.select(F.col(archive).alias("_a"), F.col(ord_).cast("long").alias("_o"), F.octet_length(body).cast("long").alias("size"), F.xxhash64(body, *facts_key.values()).alias("_hash"), *(c.alias(n) for n, c in facts_key.items()), body.alias("_p")).where("_a is not null and _o is not null")
    slim = written(keyed.drop("_p"), "sizes")
    placed = _reps(keyed, slim, ["_a", "size", "_hash", *facts_key]) if share else slim.select("_a", "_o", "size", F.col("_o").alias("rep"))
    placed = written(placed, "reps")
    stored = running_offset(placed.where("rep = _o").select("_a", "_o", "size"), "_a", "_o", "size", base=base)
    one = stored.select("_a", "_o", F.col("_o").alias("rep"), "offset", "size")
    # what shares a payload learns its offset from the first entry, in parts if many do
    copies = placed.where("rep <> _o").withColumn("_part", F.pmod(F.xxhash64("_o"), F.lit(PARTS)))
    firsts = stored.select("_a", F.col("_o").alias("rep"), "offset").join(copies.select("_a", "rep", "_part").distinct(), ["_a", "rep"])
    rest = copies.join(firsts, ["_a", "rep", "_part"]).select("_a", "_o", "rep", "offset", "size")
    offsets = one.unionByName(rest).withColumnsRenamed({"_a": archive, "_o": ord_})
    taken = [c for c in entries.columns if c not in ("size", "rep", "offset", "shared")]
    out = entries.select(*taken).withColumn(ord_, F.col(ord_).cast("long")).join(offsets, [archive, ord_]).withColumn("shared", F.col("rep") != F.col(ord_))
    return out.select(*taken, "size", "rep", "offset", "shared")


#: Entries that share length and hash with others whose keys are broadcast to pick their payloads; beyond, a bit set of
#: fixed size picks them.
FEW = 200_000
#: Parts into which the copies of a payload are dealt when they look up where it is stored.
PARTS = 64


def _reps(keyed: DataFrame, slim: DataFrame, key: list[str]) -> DataFrame:
    """_a, _o, size, rep: the first entry with the same bytes and facts."""
    groups = slim.groupBy(*key).agg(F.min("_o").alias("rep"), F.count("*").alias("_n"))
    several = groups.where("_n > 1")
    seen = hot.met(slim, several, key, "_n", slim.count())
    sure = groups.where("_n = 1").select("_a", F.col("rep").alias("_o"), "size", "rep")
    empty = seen.where("size = 0").select("_a", "_o", "size", "rep")
    twins = written(seen.where("size > 0"), "twins")
    if twins.count() <= FEW:
        bodies = keyed.select("_a", "_o", "_p").join(F.broadcast(twins), ["_a", "_o"])
    else:
        bodies = keyed.where(hot.membership(twins, "_hash")(F.col("_hash"))).select("_a", "_o", "_p").join(twins, ["_a", "_o"])
    bodies = bodies.withColumn("_parts", F.ceil(F.col("_n") / TOGETHER).cast("int"))
    first = bodies.where("_o = rep").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("_a", "rep", *key[3:], "_part", F.col("_p").alias("_q"))
    met = bodies.withColumn("_part", F.pmod(F.xxhash64("_o"), F.col("_parts")).cast("int")).join(first, ["_a", "rep", *key[3:], "_part"])
    agreed = met.where("_p = _q").select("_a", "_o", "size", "rep")
    # another payload of equal length and hash: the few that are left group on their bytes
    other = met.where("_p <> _q").withColumn("rep", F.min("_o").over(Window.partitionBy(*key, "_p"))).select("_a", "_o", "size", "rep")
    return sure.unionByName(empty).unionByName(agreed).unionByName(other)


def stored_bytes(placed: DataFrame, archive: str, base: int = 0) -> DataFrame:
    """Next free offset of each archive."""
    return placed.groupBy(archive).agg((F.lit(base) + F.sum(F.when(~F.col("shared"), F.col("size")).otherwise(0))).cast("long").alias("next_offset"))


def folders(entries: DataFrame, archive: str, ord_: str, folder: str, display: str) -> DataFrame:
    """One row a folder: its entries, the spelling seen first, and the bytes its name table takes."""
    g = entries.groupBy(archive, folder).agg(F.count("*").alias("files"), F.min(F.struct(ord_, display)).alias("first"))
    return g.select(archive, folder, "files", F.col(f"first.{display}").alias("display_name"), (F.octet_length(folder) + 1).cast("long").alias("name_bytes"))
