"""URL verdicts: explicit rules first, else empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's bad
rate is shrunk towards its parent's posterior mean by a beta-binomial prior whose strength the
method of moments finds from the spread between siblings. A page is blocked when the lower
posterior bound of its host's bad rate, a quantile of its beta posterior, exceeds the
bad rate of all outcomes by a factor of their odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, sized

#: Host, path, action. A rule fits its host and all subdomains where the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Multiple of the odds of a bad outcome among all that a host must exceed, and the share of its posterior
#: that may lie below that (a lower bound of 95 %).
WORSE, TAIL = 1.5, 0.05
#: Limits of the prior's strength in pseudo-counts, and the strength where siblings can't tell.
WEAKEST, STRONGEST, DEFAULT = 1.0, 1000.0, 20.0
#: Labels that form a public suffix together with a country's two letters (co.uk, com.au).
SECOND_LEVEL = (
    "ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "govt", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web",
)
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """The host that a reputation belongs to: without user, port and the root's dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(?::[0-9]*)?$", "")


def _two_labels(host: Column) -> Column:
    return host.rlike(rf"(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")


def _address(host: Column) -> Column:
    return host.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*)$")


def suffix_of(host: Column) -> Column:
    """Public suffix of a key; numeric addresses have none."""
    name = F.when(_two_labels(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    return F.when(_address(host), "").otherwise(name)


def domain_of(host: Column) -> Column:
    """The suffix and one more label; a numeric address is its own domain."""
    name = F.when(_two_labels(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(_address(host), host).otherwise(name)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest fitting rule and its action, null if none fits. Rules are a fixed list, not data."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return rule, action


def strength(spread: float | None, expected: float | None, excess: float | None) -> float:
    """Pseudo-counts of a prior: pooled squared deviations against their binomial expectation.

    A rate of n trials has variance m (1 - m) (1 + (n - 1) / (s + 1)) / n under a beta-binomial of
    mean m and strength s; summed over siblings and solved for s.
    """
    if not excess or excess <= 0:
        return DEFAULT
    rho = (spread - expected) / excess
    return STRONGEST if rho <= 0 else max(WEAKEST, min(STRONGEST, 1 / rho - 1))


def _shrunk(level: DataFrame, key: str, parent: DataFrame | None, parent_key: str | None) -> DataFrame:
    """Posterior mean and strength of each ``key`` from its ``n``, ``bad`` and the parent's mean."""
    if parent is None:
        bad, n = level.agg(F.sum("bad"), F.sum("n")).first()
        level = level.withColumn("m", F.lit(((bad or 0) + 1) / ((n or 0) + 2)))
    else:
        level = level.join(parent.select(F.col(parent_key), F.col("mean").alias("m")), parent_key)
    n, m = F.col("n"), F.col("m")
    d, v, x = level.where("n > 1").agg(
        F.sum(n * (F.col("bad") / n - m) * (F.col("bad") / n - m)), F.sum(m * (1 - m)), F.sum(m * (1 - m) * (n - 1))
    ).first()
    level = level.withColumn("s", F.lit(strength(d, v, x)))
    return level.withColumn("mean", (F.col("bad") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))).withColumn(
        "strength", F.col("n") + F.col("s")
    )


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    x, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(z), 1 / keep(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 2000):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        before = f
        for term in (even, odd):
            d, c = 1 / keep(1 + term * d), keep(1 + term / c)
            f = f * d * c
        if np.all(np.abs(f - before) <= 1e-14 * np.abs(f)):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    part = np.where(z <= 0, 0.0, np.nan_to_num(front) * f)
    return np.clip(np.where(flip, 1 - part, part), 0, 1)


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_quantile(tail: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The value that a share ``tail`` of each beta distribution lies below, by bisection."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < tail
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        mean, strength = (b.column(n).to_numpy(zero_copy_only=False) for n in ("mean", "strength"))
        bound = beta_quantile(TAIL, mean * strength, (1 - mean) * strength) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound)], [*b.schema.names, "bound"])


def _bounded(rows: DataFrame) -> DataFrame:
    sized(rows.sparkSession)
    kept = rows.select("host", F.col("n").cast("long"), F.col("bad").cast("long"), F.col("mean").cast("double"), F.col("strength").cast("double"))
    return kept.mapInArrow(_bound, "host string, n long, bad long, mean double, strength double, bound double")


def reputation(outcomes: DataFrame, scratch: Scratch, seen: DataFrame | None = None) -> DataFrame:
    """``outcomes(host, n, bad)`` with one row a host -> host, n, bad, mean, strength, bound.

    Distinct hosts of ``seen(host)`` without outcomes follow with n = 0: the posterior mean of their
    registered domain, else of their suffix, else of the root. Their variance sums the priors of all
    levels without outcomes, as hosts vary in a domain, domains in a suffix and suffixes at the root.
    Without any outcome there is no posterior to take.
    """
    o = scratch.write(outcomes.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = scratch.write(o.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = scratch.write(_shrunk(suffixes, "suffix", None, None))
    mid = scratch.write(_shrunk(domains, "domain", top, "suffix"))
    low = _shrunk(o.drop("suffix"), "host", mid, "domain")
    known = _bounded(low)
    root = top.select("m").first()
    if seen is None or root is None:
        return known
    hosts, in_suffix, at_root = (1 / (level.select("s").first()["s"] + 1) for level in (low, mid, top))
    bare = seen.select("host").distinct().join(o.select("host"), "host", "left_anti")
    bare = bare.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    bare = bare.join(mid.select("domain", F.col("mean").alias("by_domain")), "domain", "left").join(top.select("suffix", F.col("mean").alias("by_suffix")), "suffix", "left")
    mean = F.coalesce("by_domain", "by_suffix", F.lit(root["m"]))
    unsure = F.lit(hosts) + F.when(F.col("by_domain").isNull(), in_suffix).otherwise(0.0) + F.when(F.coalesce("by_domain", "by_suffix").isNull(), at_root).otherwise(0.0)
    none = F.lit(0).cast("long")
    return known.unionByName(_bounded(bare.select("host", none.alias("n"), none.alias("bad"), mean.alias("mean"), (1 / unsure - 1).alias("strength"))))


def filter_urls(pages: DataFrame, outcomes: DataFrame, worse: float = WORSE, rules=RULES) -> DataFrame:
    """Judge ``pages(page_id, url)`` by ``outcomes(url, bad)``, where ``bad`` is 0, 1 or null.

    Returns page_id, host, path, rule, verdict, bad_rate, bound. A null url, or one without
    ``://``, has an empty host and path, which no rule fits and whose outcomes count as a host of
    that name. Reputations belong to hosts without user, port and final dot. A host without outcomes is
    judged by its registered domain, else its suffix, else all outcomes; it has no bound and is allowed
    only if there is no outcome at all. A bound above the rate whose odds are ``worse`` times those of all
    outcomes blocks. Repeated rows are judged each; null outcomes and other columns are ignored; empty tables
    give none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    counted = (
        outcomes.where("bad is not null").groupBy(key_of(host_of(F.col("url"))).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    )
    seen = pages.select(key_of(host_of(F.col("url"))).alias("host"))
    found = scratch.write(reputation(counted, scratch, seen).select(F.col("host").alias("_host"), "n", "bad", "mean", "bound"))
    row = found.agg(F.count("*").alias("hosts"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    odds = worse * ((row["bad"] or 0) + 1) / ((row["n"] or 0) - (row["bad"] or 0) + 1)
    limit = odds / (1 + odds)
    hosts = found.select("_host", "mean", "bound")
    if row["hosts"] <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bound") > F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hosts, key_of(F.col("host")) == F.col("_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, judged).alias("verdict"),
        F.col("mean").alias("bad_rate"), "bound",
    )
