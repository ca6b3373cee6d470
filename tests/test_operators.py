from pyspark.sql import functions as F

from stowage.operators import catalog, compare, placement, spans, textures, validation


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_place_shares_equal_bytes(spark):
    e = spark.createDataFrame([("a", 0, b"xx"), ("a", 1, b""), ("a", 2, b"xx"), ("a", 3, b"yyy"), ("b", 0, b"xx"), ("a", 4, None)], "archive string, ord long, payload binary")
    got = rows(placement.place(e, "archive", "ord", "payload", base=10).select("archive", "ord", "size", "offset", "shared"))
    assert got == [("a", 0, 2, 10, False), ("a", 1, 0, 12, False), ("a", 2, 2, 10, True), ("a", 3, 3, 12, False), ("a", 4, 0, 12, True), ("b", 0, 2, 10, False)]
    alone = placement.place(e, "archive", "ord", "payload", share=False)
    assert rows(alone.where("archive = 'a'").select("ord", "offset", "shared")) == [(0, 0, False), (1, 2, False), (2, 2, False), (3, 4, False), (4, 7, False)]


def test_place_many_and_hot(spark, monkeypatch):
    """A payload that most entries have, payloads of two entries, and single ones; keys broadcast or picked by bits."""
    rows = [("a", i, b"hot" if i % 3 else b"%d" % (i // 6)) for i in range(3000)] + [("b", 0, b"hot"), (None, 1, b"x"), ("b", None, b"y")]
    e = spark.createDataFrame(rows, "archive string, ord long, payload binary")
    want, at, seen = [], 0, {}
    for a, o, p in rows[:3000]:
        first = seen.setdefault(p, (o, at))
        want.append((a, o, len(p), first[0], first[1]))
        at += len(p) if first[0] == o else 0
    for few in (placement.FEW, 0):
        monkeypatch.setattr(placement, "FEW", few)
        got = placement.place(e, "archive", "ord", "payload").select("archive", "ord", "size", "rep", "offset")
        assert rows_of(got) == sorted([*want, ("b", 0, 3, 0, 0)], key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clashes(spark):
    s = spark.createDataFrame([("x", 0, 5, 7), ("x", 4, 4, 2), ("x", 4, 4, 9), ("x", 20, 0, 1), ("y", 0, 300_000, 5), ("y", 200_000, 1, 3), ("y", 250_000, 1, 8), ("z", 0, 5, 0), ("z", 0, 5, 1), ("z", 5, 5, 2)], "a string, at long, n long, i long")
    assert rows_of(spans.clashes(s, "a", "at", "n", "i")) == [("x", 7), ("y", 5), ("y", 8)]


def test_place_by_facts(spark):
    e = spark.createDataFrame([("a", 0, "x", "p"), ("a", 1, "x", "q"), ("a", 2, "x", "p")], "archive string, ord long, payload string, fact string")
    assert rows(placement.place(e, "archive", "ord", "payload", ("fact",)).select("ord", "rep", "offset")) == [(0, 0, 0), (1, 1, 1), (2, 0, 0)]


def test_running_offset_over_blocks(spark):
    r = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("s"))
    got = dict(placement.running_offset(r, "k", "o", "s", block=8).select("o", "offset").collect())
    total, want = 0, {}
    for i in range(100):
        want[i] = total
        total += i % 7
    assert got == want


def test_spans(spark):
    s = spark.createDataFrame([("ok", 0, 5), ("ok", 5, 5), ("ok", 5, 5), ("ok", 7, 0), ("bad", 0, 5), ("bad", 4, 1), ("far", 0, 200_000), ("far", 150_000, 1), ("empty", 3, 0)], "a string, at long, n long")
    assert {r.a: r.exclusive for r in spans.exclusivity(s, "a", "at", "n").collect()} == {"ok": True, "bad": False, "far": False, "empty": True}
    assert {r.a: r.exclusive for r in spans.exclusivity(s, "a", "at", "n", allow_equal=False).collect()}["ok"] is False


def test_record_order(spark):
    r = spark.createDataFrame([("a", 0, 1), ("a", 1, 3), ("a", 2, 3), ("a", 3, 2), ("b", 0, 9)], "a string, i long, h long")
    assert rows(spans.record_order(r, "a", "i", "h", block=2).select("i", "problem")) == [(2, "duplicate"), (3, "unsorted")]


def test_sequences(spark):
    def err(chunks, mips):
        c = F.array(*(F.struct(F.lit(a).alias("start_mip"), F.lit(b).alias("end_mip")) for a, b in chunks))
        return spark.range(1).select(textures.sequence_error(c, F.lit(mips)).alias("e")).first().e

    assert err([(0, 0), (1, 3)], 4) is None
    assert err([(0, 3), (0, 3)], 4) is None
    assert err([(0, 0), (2, 3)], 4) == "gap"
    assert err([(0, 1), (1, 3)], 4) == "overlap"
    assert err([(0, 1)], 4) == "incomplete"
    assert err([(1, 0)], 4) == "backwards"


def test_layouts(spark):
    bc1 = lambda first, last: sum(max((16 >> m) // 4, 1) ** 2 * 8 for m in range(first, last + 1))
    face = [(0, 0, bc1(0, 0)), (1, 4, bc1(1, 4))]
    tail = bc1(1, 4) + 5 * bc1(0, 4)
    cases = [
        (face, False, None), (face * 3, False, None), (face * 6, True, None), (face * 12, True, None),
        (face * 5, True, "incomplete"), (face * 7, True, "surplus"), (face[:1], False, "incomplete"), (face * 6 + face[:1], True, "surplus"),
        ([(0, 0, bc1(0, 0) - 1), face[1]], False, "size"), ([face[0], (1, 4, bc1(1, 4) + 8)], False, "size"),
        ([(0, 9, bc1(0, 4)), (0, 4, bc1(0, 4))], False, "range"), ([(1, 0, 8)], False, "range"),
        ([face[0], (2, 4, bc1(2, 4))], False, "gap"), ([face[0], (0, 4, bc1(0, 4))], False, "overlap"),
        ([face[0], (1, 4, tail)], True, None), ([(0, 4, 6 * bc1(0, 4))], True, None), ([face[0], (1, 4, tail)], False, "size"), ([face[0], (1, 4, tail - 8)], True, "size"),
        ([(0, 1, bc1(0, 1)), (2, 4, bc1(2, 4) + 5 * bc1(0, 4))], True, "size"), ([*face, face[0], (1, 4, tail)], True, "size"), ([face[0], (1, 4, tail), face[0]], True, "size"),
    ]
    rows = spark.createDataFrame([(i, c, cube) for i, (c, cube, _) in enumerate(cases)], "i int, chunks array<struct<start_mip:int,end_mip:int,raw_size:long>>, cube boolean")
    error = textures.layout_error(F.col("chunks"), F.lit(16), F.lit(16), F.lit(5), F.col("cube"), F.lit(8), F.lit(4))
    assert dict(rows.select("i", error).collect()) == {i: want for i, (_, _, want) in enumerate(cases)}


def test_capped_ranges(spark):
    got = spark.range(1).select(textures.capped_ranges(F.array(*map(F.lit, (50, 30, 20, 10, 5))), 60).alias("r")).first().r
    assert [tuple(x) for x in got.ranges] == [(0, 0), (1, 3), (4, 4)] and not got.error
    assert spark.range(1).select(textures.capped_ranges(F.array(F.lit(70)), 60).alias("r")).first().r.error


def test_bulk(spark):
    entries = spark.createDataFrame([("a/b", 5), ("c", 900)], "path string, raw_size long")
    asked = spark.createDataFrame([(0, "A\\B"), (1, "c"), (2, "A\\B"), (3, "x"), (4, "../x")], "ord long, path string")
    got = rows(catalog.bulk(asked, entries, most=100).select("ord", "first_ord", "failure"))
    assert got == [(0, 0, None), (1, 1, "too_large"), (2, 0, None), (3, 3, "not_found"), (4, 4, "invalid_argument")]


def test_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, None), (3, "q"), (4, "n")], "k int, v string")
    assert rows(compare.catalogs(a, b, ["k"], ["v"])) == [(1, "missing"), (2, "same"), (3, "different"), (4, "extra")]
    assert rows(compare.baseline(a, b, "k", "v")) == [(1, "absent"), (3, "changed")]


def test_first_error(spark):
    r = spark.createDataFrame([("a", 2, 1), ("a", 1, 3), ("b", 0, 0)], "a string, i long, x int")
    found = validation.violations(r, ["a"], "i", [("one", "unsupported", F.col("x") == 1), ("big", "format_error", F.col("x") > 2), ("any", "io_error", F.col("x") > 0)])
    assert rows(validation.first_error(found, ["a"]).select("a", "record_index", "code", "violations")) == [("a", 1, "format_error", 4)]


def test_expanded_mips_are_not_broadcast(spark, capsys):
    """However small the tables look before their mips are expanded."""
    texture = spark.range(50).select(F.col("id").alias("texture"), F.lit(0).alias("array_index"), F.lit(0).alias("face"))
    parts = texture.withColumn("mip", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("size", F.col("mip") + 1)
    chunks = texture.withColumn("start_mip", F.explode(F.array(F.lit(0), F.lit(2)))).withColumn("end_mip", F.when(F.col("start_mip") == 0, 1).otherwise(5))
    placed = textures.place_subresources(chunks, parts)
    placed.explain()
    assert "Broadcast" not in capsys.readouterr().out
    got = placed.groupBy("texture", "start_mip").agg(F.sum("size").alias("s")).collect()
    assert sorted(map(tuple, got)) == [(t, *x) for t in range(50) for x in ((0, 3), (2, 18))]
