"""URL filter: listed rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages are counted by host. A host's posterior is a beta distribution whose prior comes from its
registered domain, whose prior comes from its suffix, whose prior comes from all pages; how strongly each level
shrinks is fitted from the spread of its groups (method of moments). A host is blocked when even the upper bound of
its posterior share of good pages lies under a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hot import met
from .common import written

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Second labels under which countries register domains: ``x.co.uk`` is one (names that registries use). A host's
#: suffix is its last label, with such a label before it where the last has two letters.
REGISTRY = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
#: Bounds of the fitted prior strength, in pages.
STRENGTH = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def levels(host: Column, registry=REGISTRY) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port. An address is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    second = F.when((n > 1) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*registry), 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    return F.when(address, bare).otherwise(last(second + 1)), F.when(address, bare).otherwise(last(second))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. Of equally long rules the one listed first counts."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def strength(groups: DataFrame) -> tuple[float, float]:
    """Mean and prior strength of a beta-binomial over ``groups(good, n)``: three sums, so one row reaches the driver."""
    r = groups.where("n > 0").agg(F.sum("good").alias("g"), F.sum("n").alias("n"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("s2"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k")).first()
    if not r.n:
        return 0.5, STRENGTH[0]
    mean = (r.g + 1) / (r.n + 2)
    var = mean * (1 - mean)
    spread = r.s2 - 2 * mean * r.g + mean * mean * r.n
    free = var * (r.n - r.n2 / r.n - (r.k - 1))
    rho = (spread - var * (r.k - 1)) / free if free > 0 else 0.0
    return mean, min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def reputations(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``outcomes(host, good)`` for labelled pages and null ``good`` for others -> one row per host with its posterior
    and its number of rows.

    Groups are pre-aggregated to one row a host, which is written once, before any level joins another."""
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.count("good").cast("double").alias("n"), F.count("*").alias("pages"))
    domain, suffix = levels(F.col("host"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("d_good"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_good").alias("s_good"), F.sum("d_n").alias("s_n"))
    mean, k_suffix = strength(suffixes.select(F.col("s_good").alias("good"), F.col("s_n").alias("n")))
    _, k_domain = strength(domains.select(F.col("d_good").alias("good"), F.col("d_n").alias("n")))
    _, k_host = strength(hosts.select("good", "n"))
    suffixes = suffixes.withColumn("s_mean", (F.col("s_good") + k_suffix * mean) / (F.col("s_n") + k_suffix))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("d_good") + k_domain * F.col("s_mean")) / (F.col("d_n") + k_domain)).alias("d_mean"))
    a = F.col("good") + k_host * F.col("d_mean")
    b = F.col("n") - F.col("good") + k_host * (1 - F.col("d_mean"))
    total = F.col("a") + F.col("b")
    posterior = hosts.join(domains, "domain").select("host", "pages", "good", "n", a.alias("a"), b.alias("b"))
    spread = z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return posterior.select("host", "pages", "good", "n", (F.col("a") / total).alias("mean"), (F.col("a") / total - spread).alias("lower"), (F.col("a") / total + spread).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, least_good: float = 0.5) -> DataFrame:
    """``pages(page_id, url)`` and labelled outcomes ``labels(page_id, good)`` -> host, path, rule, verdict of every page.

    Null or odd urls have an empty host, which is a host of its own; a label of an unknown page counts nowhere; of
    several labels of a page the least counts; a null label is none. Repeated pages are judged once a row."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("good is not null and page_id is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    rated = reputations(parts.select("page_id", "host").join(known, "page_id", "left").select("host", "good"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rated = written(rated, "rated")
    total = rated.agg(F.sum("pages")).first()[0] or 0
    judged = met(parts, rated.select("host", F.col("mean").alias("reputation"), "upper", "pages"), ["host"], "pages", total)  # every host is rated
    verdict = F.coalesce(fixed, F.when(F.col("upper") < least_good, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "reputation")
