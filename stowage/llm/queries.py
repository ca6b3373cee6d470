"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, near_dedup, nearest, quality, secret_scan, substring_dedup, token_count, url_filter, word_bpe


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_REGISTRY_SQL = ", ".join(f"'{x}'" for x in url_filter.REGISTRY)
OP8_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_RULES_SQL}),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS fixed
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
known AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare,
         regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') OR starts_with(bare, '[') AS address, string_split(bare, '.') AS labels,
         CASE WHEN len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ({_REGISTRY_SQL}) THEN 2 ELSE 1 END AS k,
         CASE WHEN address THEN bare ELSE array_to_string(labels[-k:], '.') END AS suffix,
         CASE WHEN address THEN bare ELSE array_to_string(labels[-(k + 1):], '.') END AS domain
  FROM parts LEFT JOIN known USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
levels AS (SELECT 'h' AS lvl, good, n FROM hosts UNION ALL SELECT 'd', good, n FROM domains UNION ALL SELECT 's', good, n FROM suffixes),
sums AS (SELECT lvl, sum(good) AS g, sum(n) AS n, sum(good * good / n) AS s2, sum(n * n) AS n2, count(*) AS k FROM levels WHERE n > 0 GROUP BY lvl),
fits AS (SELECT *, (g + 1) / (n + 2) AS m, m * (1 - m) AS var, var * (n - n2 / n - (k - 1)) AS free,
         CASE WHEN free > 0 THEN (s2 - 2 * m * g + m * m * n - var * (k - 1)) / free ELSE 0 END AS rho,
         CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000.0) ELSE 1000.0 END AS strength FROM sums),
ks AS (SELECT coalesce(max(CASE WHEN lvl = 's' THEN m END), 0.5) AS m, coalesce(max(CASE WHEN lvl = 's' THEN strength END), 1) AS k_s,
       coalesce(max(CASE WHEN lvl = 'd' THEN strength END), 1) AS k_d, coalesce(max(CASE WHEN lvl = 'h' THEN strength END), 1) AS k_h FROM fits),
s2 AS (SELECT suffix, (good + k_s * m) / (n + k_s) AS mean FROM suffixes, ks),
d2 AS (SELECT domain, (good + k_d * mean) / (n + k_d) AS mean FROM domains JOIN s2 USING (suffix), ks),
h2 AS (SELECT host, good + k_h * mean AS a, n - good + k_h * (1 - mean) AS b FROM hosts JOIN d2 USING (domain), ks),
rated AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h2)
SELECT parts.page_id, host, path, rule, coalesce(fixed, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fit USING (page_id) LEFT JOIN rated USING (host)
"""

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_quality, op4_html_extraction, op5_nearest, op6_token_counts, op7_decontamination, op8_url_filter, op9_bpe_round_trip, op10_near_dedup)}
OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
low AS (SELECT g, min(doc_id) AS m FROM grams GROUP BY g),
marked AS (SELECT doc_id, list(DISTINCT i) AS starts FROM grams JOIN low USING (g) WHERE m < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(a, a + 13)) AS p FROM (SELECT doc_id, unnest(starts) AS a FROM marked)) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n, list_filter(words, lambda x, k: NOT list_contains(coalesce(places, []), k)) AS rest FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(rest))::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op8_url_filter": OP8_SQL}
