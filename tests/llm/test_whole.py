"""Every numbered query and the pipeline over the whole tables of the smallest folder, against other code."""

import hashlib
import math
import os
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import zstandard

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from stowage.llm import decontaminate, html_text, quality, queries  # noqa: E402
from test_exact import brute_groups, brute_nearest, brute_spans  # noqa: E402
from test_fitted import article, levenshtein_in  # noqa: E402

SF = os.environ.get("TEST_SMALL_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "labels", "benchmark", "pages", "embeddings")}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text.translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_url_filter"])
def test_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def test_secrets(spark, tables):
    texts = {r.doc_id: r.text or "" for r in tables["documents"]}
    got = run(spark, "op2_secret_scan")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert not spans or set(listed(spans).split(",")) <= set(r.spans.split(","))


def plain_score(text, model):
    """The score in plain Python from the model's dictionaries and weights."""
    data, sizes = (text or "").encode(), []
    pieces = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]
    for d in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(p)) for p in pieces))
    g, b = sizes
    x = ((b - g) / (b + g), min(g / max(len(data), 1), 2.0), min(b / max(len(data), 1), 2.0))
    z = model.weights[-1] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.center, model.scale, strict=False))
    return 1 / (1 + math.exp(-max(min(z, 30), -30)))


def test_quality(spark, tables):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in tables["documents"]}
    got = run(spark, "op3_quality")
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - plain_score(texts[r.doc_id], model)) < 1e-9 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_of_repeated_and_long_rows(spark):
    docs = [(i, f"good words number {i} " * 9) for i in range(20)] + [(100 + i, f"bad junk {i} !! " * 9) for i in range(20)]
    docs += [(7, f"copy {i}") for i in range(50)] + [(300, "x" * 60_000), (None, "x")]
    labels = [(d, int(d < 100)) for d, _ in docs if d is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels + [(7, 1), (None, 0)], "doc_id long, quality int"))
    again = quality.fit(frame.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model == again
    got = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert len(quality.score(frame, model).collect()) == len(docs) and min(got[i] for i in range(20) if i != 7) > max(got[100 + i] for i in range(20))


def test_articles(spark, tables):
    got = {r.page_id: r for r in run(spark, "op4_html_extraction")}
    assert len(got) == len(tables["pages"]) and all(got[p.page_id].text == article(p.html) and got[p.page_id].url == p.url for p in tables["pages"])


def test_nearest(spark, tables):
    want = brute_nearest([(r.vec_id, r.embedding) for r in tables["embeddings"]], 50)
    got = {(r.query_id, r["rank"]): r.vec_id for r in run(spark, "op5_nearest")}
    assert got.keys() == want.keys() and sum(got[x] == want[x] for x in want) >= 0.9 * len(want)


def test_tokens(spark, tables):
    byte, word = (tokenizers.Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for t in (byte, word):
        t.no_truncation()
        t.no_padding()
    counts = {r.doc_id: r for r in run(spark, "op6_token_counts")}
    trips = {r.doc_id: r for r in run(spark, "op9_bpe_round_trip")}
    for r in tables["documents"]:
        text = r.text or ""
        n = len(byte.encode(text, add_special_tokens=False).ids)
        got = counts[r.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(text.encode()), n, n > 1024)
        ids = word.encode(text, add_special_tokens=False).ids
        got = trips[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def quoted(docs, items):
    """(doc, item) pairs of documents that hold 64 bytes or more of an item word for word."""
    out = set()
    for d, t in docs.items():
        low = squeeze(t or "").encode()
        for i, x in items.items():
            x = squeeze(x).strip().encode()
            if any(x[a : a + 64] in low for a in range(max(len(x) - 64, 0) + 1)):
                out.add((d, i))
    return out


def test_decontamination(spark, tables):
    docs, items = {r.doc_id: r.text for r in tables["documents"]}, {r.item_id: r.text for r in tables["benchmark"]}
    found = run(spark, "op7_decontamination")
    got = {(r.doc_id, r.item_id) for r in found}
    want = quoted(docs, items)
    assert want <= got
    w = decontaminate.Windows.of(sorted(items.items()))
    for r in found:
        if (r.doc_id, r.item_id) not in want:  # no word-for-word quote: some window is within its edits of the region
            region = squeeze(docs[r.doc_id])[max(r.start - 20, 0) : r.stop + 20].encode()
            assert any(levenshtein_in(w.text[x], region) <= w.edits[x] for x in range(len(w.text)) if w.item[x] == r.item_id)


def test_near_dedup(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables["documents"]]
    assert sorted(map(tuple, run(spark, "op10_near_dedup")), key=repr) == brute_groups(rows, 4, 80)


def redacted(text):
    spans = sorted((s, e) for s, _, e in brute_spans(text))
    out, done = [], 0
    for s, e in spans:
        if s >= done:
            out += [text[done:s], "[SECRET]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def brute_pipeline(docs, items, model, word):
    """doc_id -> (text, ids) of what all stages leave, in plain Python."""
    left = {d: t for d, t in docs if plain_score(t, model) >= 0.3}
    kept = {r[0] for r in brute_groups(sorted(left.items()), 5, 80) if r[3]}
    leaks = {d for d, _ in quoted({d: left[d] for d in kept}, items)}
    texts = {d: redacted(left[d] or "") for d in kept - leaks}
    return {d: word.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def test_pipeline(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    word = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.no_truncation()
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    items = {r.item_id: r.text for r in tables["benchmark"]}
    want = brute_pipeline([(r.doc_id, r.text) for r in tables["documents"]], items, quality.fit(docs, labels), word)
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    close = {r.doc_id for r in run(spark, "op7_decontamination") if r.edits}  # quotes with edits go as well
    assert set(got) <= set(want) and set(want) - set(got) <= close and len(got) > 20
    for d, r in got.items():
        assert r.ids == want[d] and r.decoded == word.decode(want[d], skip_special_tokens=False)


def test_pipeline_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    good = [t.text for t in tables_of(spark)][:30]
    rows = [(i, t) for i, t in enumerate(good)] + [(3, good[3]), (3, "another text of the same document " * 4), (None, good[5]), (40, None), (41, ""), (42, "word " * 30_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    for name, frame in (("documents", spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], schema)), ("labels", labels), ("benchmark", spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    known = [d for d in got if d is not None]
    assert len(known) == len(set(known)) and got.count(None) == 1 and {42} <= set(known) <= set(range(43))
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def tables_of(spark):
    return [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and 200 < len(r.text) < 5000]


def test_small_and_empty_tables(spark):
    from stowage.llm import secret_scan, token_count, url_filter

    none = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan(none).count() == 0 and token_count.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good int")
    assert url_filter.judge(pages, labels).count() == 0
    hosts = {1: "http://a.co.uk/x", 2: "http://b.co.uk:8080/", 3: "http://10.0.0.1/", 4: "http://u@x.example.com/", 5: "http://co.uk/"}
    got = spark.createDataFrame(list(hosts.items()), "page_id int, url string").select("page_id", *url_filter.levels(url_filter.host_of("url"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {1: ("a.co.uk", "co.uk"), 2: ("b.co.uk", "co.uk"), 3: ("10.0.0.1", "10.0.0.1"), 4: ("example.com", "com"), 5: ("co.uk", "co.uk")}
    assert html_text.extract("", html_text.PRIORS) == ""
