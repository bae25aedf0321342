"""URL rules, and an empirical-Bayes reputation of hosts where no rule fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Block where the bad share of a host is above MOST_BAD with a posterior probability of more than 1 - DOUBT.
MOST_BAD, DOUBT = 0.5, 0.05
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Second labels that, before a two-letter country label, belong to the public suffix.
SECOND_LABELS = "ac co com edu gob gouv gov go mil ne net nom or org sch".split()
SUFFIX = rf"(?:(?:{'|'.join(SECOND_LABELS)})\.[a-z][a-z]|[^.]+)"
#: Hosts that are an address have no domain above them.
ADDRESS = r"^\[|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    folded = F.when(host.rlike("[A-Z]"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(host)
    return F.coalesce(folded, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits, as host and path together, and its action; nulls without one."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # longer ones are tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def name_of(host: Column) -> Column:
    """The host without user, port and closing dot; its reputation is that of its name."""
    return F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(name: Column) -> Column:
    """The public suffix: the last label, or the last two where SECOND_LABELS says so; an address whole."""
    return F.when(name.rlike(ADDRESS), name).otherwise(F.regexp_extract(name, rf"(?:^|\.)({SUFFIX})$", 1))


def domain_of(name: Column) -> Column:
    """The registered domain: the public suffix and the label before it; an address whole."""
    return F.when(name.rlike(ADDRESS), name).otherwise(F.regexp_extract(name, rf"(?:^|\.)((?:[^.]+\.)?{SUFFIX})$", 1))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for a, b > 0 and 0 < x < 1, by Lentz's continued fraction."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a) - gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    floor = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / floor(1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / floor(1 + even * d), floor(1 + even / c)
        out = out * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / floor(1 + odd * d), floor(1 + odd / c)
        out = out * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(swap, 1 - front * out, front * out)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-quantile of beta distributions by bisection; 0 where a is 0, 1 where b is 0, NaN where either is missing."""
    out = np.where(np.isnan(a) | np.isnan(b), np.nan, np.where(a <= 0, 0.0, 1.0))
    at = np.flatnonzero((a > 0) & (b > 0))
    if len(at):
        (a, b), inverse = np.unique(np.stack([a[at], b[at]]), axis=1, return_inverse=True)
        low, high = np.zeros(len(a)), np.ones(len(a))
        for _ in range(45):
            mid = (low + high) / 2
            below = beta_cdf(mid, a, b) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        out[at] = ((low + high) / 2)[inverse.ravel()]
    return out


def lower_bound(a: Column, b: Column, doubt: float = DOUBT) -> Column:
    def quantile(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(doubt, x.to_numpy(float), y.to_numpy(float)))

    return F.pandas_udf(quantile, "double")(a, b)


def strength(counts: DataFrame, level: str) -> DataFrame:
    """One row with the beta prior's strength over the n and bad of counts, by the method of moments."""
    total = counts.agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"), F.count("*").alias("m"), F.sum(F.lit(1.0) / F.col("n")).alias("inv"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("sq"))
    p = F.col("tb") / F.col("tn")
    spread = (F.col("sq") - F.col("tn") * p * p) * F.col("m") / ((F.col("m") - 1) * F.col("tn"))
    noise = p * (1 - p)
    raw = (noise - spread) / (spread - noise * F.col("inv") / F.col("m"))
    usable = (F.col("m") > 1) & (spread - noise * F.col("inv") / F.col("m") > 1e-9)
    return total.select(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.when(usable, raw).otherwise(F.lit(STRONGEST)))).alias(f"m_{level}"), F.coalesce(p, F.lit(0.0)).alias(f"p_{level}"), F.coalesce("tn", F.lit(0)).alias(f"n_{level}"), F.coalesce("tb", F.lit(0.0)).alias(f"bad_{level}"))


def reputation(outcomes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """name, n, bad, mean, low: each host name's posterior bad share and its lower DOUBT-quantile, exact for the beta posterior.

    outcomes has name and bad (0 or 1). Priors run from all pages to suffixes, domains and hosts: a level's mean is shrunk
    toward the one above it with a strength that fits how much its members differ. No page counts twice: a host's prior is
    of the domain's other hosts, that of the suffix's other domains, that of all pages of other suffixes (of all pages if
    there are none). Names of others that have no outcome get n = 0 and the bound of their prior.
    """
    levels = lambda df: df.withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name")))
    hosts = levels(outcomes.groupBy("name").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    priors = [strength(d, k) for d, k in ((suffixes, "suffix"), (domains, "domain"), (hosts, "host"))]
    prior = {k: v for row in (p.first() for p in priors) for k, v in row.asDict().items()}  # three rows of four numbers
    if others is not None:
        new = others.select("name").distinct().join(hosts, "name", "left_anti")
        hosts = hosts.unionByName(levels(new.select("name", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("bad"))))
    named = lambda df, k: df.select(k, F.col("n").alias(f"{k}_n"), F.col("bad").alias(f"{k}_bad"))
    h = hosts.join(named(domains, "domain"), "domain", "left").join(named(suffixes, "suffix"), "suffix", "left").na.fill(0, ["domain_n", "domain_bad", "suffix_n", "suffix_bad"])
    rest_n, rest_bad = F.lit(prior["n_suffix"]) - F.col("suffix_n"), F.lit(prior["bad_suffix"]) - F.col("suffix_bad")
    shrunk = lambda level, mean, n, bad: (F.lit(prior[f"m_{level}"]) * mean + bad) / (F.lit(prior[f"m_{level}"]) + n)
    h = h.withColumn("mean", F.when(rest_n > 0, rest_bad / rest_n).otherwise(F.lit(prior["p_suffix"])))
    h = h.withColumn("mean", shrunk("suffix", F.col("mean"), F.col("suffix_n") - F.col("domain_n"), F.col("suffix_bad") - F.col("domain_bad")))
    h = h.withColumn("mean", shrunk("domain", F.col("mean"), F.col("domain_n") - F.col("n"), F.col("domain_bad") - F.col("bad")))
    a = F.lit(prior["m_host"]) * F.col("mean") + F.col("bad")
    b = F.lit(prior["m_host"]) * (1 - F.col("mean")) + F.col("n") - F.col("bad")
    posterior = h.select("name", "n", "bad", a.alias("a"), b.alias("b"))
    return posterior.select("name", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), lower_bound(F.col("a"), F.col("b")).alias("low"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", most_bad: float = MOST_BAD) -> DataFrame:
    """pages with host, path, rule, verdict and low, the lower bound of the host's bad share.

    verdict is the action of the longest rule that fits, else block where low is above most_bad, else allow. Hosts
    that differ only in user, port or a closing dot share a reputation. Those without labelled pages are judged by their
    domain, suffix or all pages; null urls and urls without :// are allowed. outcomes has url and bad (0 or 1; nulls
    are left out, and repeated rows count as often as they stand there). urls of any length are read whole.
    Repeated rows repeat; an empty table gives an empty result, and without outcomes every host is allowed that no
    rule blocks; columns of pages that are called like a new one are replaced.
    """
    pages = pages.drop(*[c for c in pages.columns if c in ("host", "path", "rule", "verdict", "low")])
    labelled = outcomes.select(name_of(host_and_path(F.col("url"))[0]).alias("name"), F.col("bad").cast("double").alias("bad")).where("bad IS NOT NULL AND name <> ''")
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_all"), host.alias("host"), path.alias("path"), name_of(host).alias("name"))
    known = reputation(labelled, parsed.select("name").where("name <> ''")).select("name", "low")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    out = parsed.join(known, "name", "left").select("_all", "host", "path", rule.alias("rule"), action.alias("_action"), "low")
    return out.select("_all.*", "host", "path", "rule", F.coalesce("_action", F.when(F.col("low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "low")


def outcomes_by_path(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """url and bad of the pages whose path ends in the number of a labelled document: bad if of low quality or toxic."""
    number = F.regexp_extract(host_and_path(F.col(f"`{url}`"))[1], r"/([0-9]{1,18})(?:\.html?)?/?$", 1)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select(F.col(f"`{url}`").alias("url"), F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").join(marks, "doc_id").select("url", "bad")


