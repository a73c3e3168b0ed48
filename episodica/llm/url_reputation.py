"""URL filters: listed rules first, then an empirical-Bayes reputation of the host.

The share of bad pages of a host is estimated from labelled pages.  Hosts have few
labels, so shares shrink level by level: a public suffix towards all pages, a
registered domain towards its suffix, a host towards its domain.  At each level
the prior is a beta distribution around the parent's mean; its strength comes from
the data, by the moments of the beta-binomial distribution (how much more the
children's shares scatter than chance allows).  A host is blocked if the lower
bound of its posterior exceeds a limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from episodica.llm.common import AZ
from episodica.plans.small import keep

#: second labels that belong to the suffix below a two-letter country code
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

#: strength of a prior, in labelled pages
WEAKEST, STRONGEST = 1.0, 1000.0


def url_host(url: Column) -> Column:
    """What stands between the first '://' and '/', '?', '#' or the end; A-Z lower-cased; '' without '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), AZ, AZ.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; a port is no part of them."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(labels)
    two = (n >= 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    size = F.when(two, 2).otherwise(1)
    tail = lambda k: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(4)))
    return tail(size + 1), tail(size)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is ('allow' or 'block', 'host/path'); it fits its host and all
    subdomains if the path starts with its path.  Of two equally long ones the one
    listed first wins.
    """
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def _shrunk(children: DataFrame, parent_mean: str) -> DataFrame:
    """Adds ``strength`` of the prior and posterior ``mean``; children have n, k and the parent's mean."""
    p = F.col(parent_mean)
    scatter = F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p))
    seen = F.col("n") > 0
    rho = (F.sum(F.when(seen, scatter)) - F.count(F.when(seen, 1))) / F.sum(F.when(F.col("n") > 1, F.col("n") - 1))
    strength = children.agg(
        F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-6)) - 1)).alias("strength")
    )
    # one row of one number
    d = children.crossJoin(F.broadcast(strength))
    return d.withColumn("mean", (F.col("strength") * p + F.col("k")) / (F.col("strength") + F.col("n")))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Chance of a share up to ``x`` under a beta distribution, by the continued fraction of the incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    c, d, h = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1)), 1.0 / (1.0 - (a + b) * x / (a + 1))
    for i in range(1, 10_000):
        for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            c, d = 1.0 + term / c, 1.0 / (1.0 + term * d)
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * h / a


def beta_quantile(q: float, a: float, b: float) -> float:
    """The share below which a beta distribution lies with chance ``q``, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return lo


def _bounds(tail: float):
    @F.arrow_udf("struct<lower:double,upper:double>")
    def bounds(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = list(zip(a.to_pylist(), b.to_pylist()))
        seen = {p: (beta_quantile(tail, *p), beta_quantile(1 - tail, *p)) for p in dict.fromkeys(pairs)}
        both = [seen[p] for p in pairs]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in both], pa.float64()) for i in (0, 1)], ["lower", "upper"])

    return bounds


def host_reputation(pages: DataFrame, url_col: str = "url", bad_col: str = "bad", tail: float = 0.05) -> DataFrame:
    """Posterior share of bad pages of every host: host, domain, suffix, n, k, mean, lower, upper.

    ``bad`` is 1, 0 or null (not labelled).  Only counts per host leave the map
    side, so a host with a third of all pages costs no more than another.
    Pages without a host share the host ''.  Without any label every host has
    the mean 1/2.  ``lower`` and ``upper`` leave out ``tail`` of the posterior beta
    distribution at either end.
    """
    host = url_host(F.col(url_col))
    hosts = pages.groupBy(host.alias("host")).agg(
        F.count(bad_col).alias("n"), F.coalesce(F.sum(F.col(bad_col).cast("long")), F.lit(0)).alias("k")
    )
    domain, suffix = host_parts(F.col("host"))
    hosts = keep(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    count = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    root = hosts.agg(*count).select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("m0"))
    # each level is worked out once and written: one row per suffix, domain and host
    suffixes = keep(hosts.groupBy("suffix").agg(*count).crossJoin(F.broadcast(root)), "suffixes")
    suffixes = _shrunk(suffixes, "m0").select("suffix", F.col("mean").alias("m1"))
    domains = keep(hosts.groupBy("domain", "suffix").agg(*count).join(suffixes, "suffix"), "domains")
    domains = _shrunk(domains, "m1").select("domain", F.col("mean").alias("m2"))
    d = _shrunk(keep(hosts.join(domains, "domain"), "host-priors"), "m2")
    a = F.col("strength") * F.col("m2") + F.col("k")
    b = F.col("strength") * (1 - F.col("m2")) + F.col("n") - F.col("k")
    d = d.withColumn("bounds", _bounds(tail)(a, b))
    return keep(d.select("host", "domain", "suffix", "n", "k", "mean", "bounds.lower", "bounds.upper"), "reputation")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = (), limit: float = 0.5, url_col: str = "url", bad_col: str = "bad"
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's ``bad_share`` and ``lower`` added.

    The verdict is that of the longest rule that fits; else 'block' if the lower
    bound of the host's bad share exceeds ``limit``, and 'allow' if not.  Null urls
    and urls without '://' have an empty host and path, which no rule fits.
    Columns of the added names are replaced.
    """
    known = host_reputation(pages, url_col, bad_col).select(F.col("host").alias("__h"), F.col("mean").alias("bad_share"), "lower")
    added = ["host", "path", "rule", "verdict", "bad_share", "lower"]
    url = F.col(url_col)
    d = pages.select(F.struct(*[c for c in pages.columns if c not in added]).alias("p"), url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > F.lit(limit), "block").otherwise("allow")
    # one row per host on the right; a hot host on the left is split by adaptive execution
    d = d.join(known, d["host"] == known["__h"], "left")
    return d.select("p.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_share", "lower")
