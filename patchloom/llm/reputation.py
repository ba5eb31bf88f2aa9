"""Url rules, and host reputation by empirical Bayes for the urls that no rule decides.

Pages with a known outcome are counted per host. A host's bad share is shrunk towards that of
its registered domain, the domain's towards its suffix, the suffix's towards all pages. How
strongly is estimated from the data: the spread of children within their parents, beyond what
binomial chance explains, gives the prior's weight (moment estimate of a beta-binomial). A host
is blocked when the lower bound of its posterior bad share reaches a threshold, so a host of
which little is known is let through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # (verdict, host/path)


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, null if none does; of equally long ones the first in code point order."""
    found = [F.lit(None).cast("string")]
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found)


def suffix_of(host: Column, two_part: Sequence[str] = ()) -> Column:
    """The last label, or the last two where they are one of ``two_part`` (like ``co.uk``)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_part), two).otherwise(F.substring_index(host, ".", -1)) if two_part else F.substring_index(host, ".", -1)


def registered_domain(host: Column, two_part: Sequence[str] = ()) -> Column:
    """The suffix and the label before it; a host without such a label is its own domain."""
    one = F.substring_index(host, ".", -2)
    return F.when(one.isin(*two_part), F.substring_index(host, ".", -3)).otherwise(one) if two_part else one


@dataclass(frozen=True)
class Level:
    """Totals over the groups of one level: their number, pages, bad pages, sum of bad**2/n, and of n**2 / parent's n."""

    groups: int
    n: int
    bad: int
    squares: float
    share: float


def prior_weight(child: Level, parent: Level, least: float = 0.5, most: float = 10_000.0) -> float:
    """Weight (a + b) of the beta prior of a child around its parent's mean.

    Where the data hold no spread to judge by (no outcomes, all alike, or one child a parent)
    the spread counts as none, which gives ``most``.
    """
    if not child.n:
        return most
    within = (child.bad - parent.squares) / child.n  # mean of p(1 - p) over the parents
    freedom = child.groups - parent.groups
    room = within * (child.n - child.share - freedom)
    if room <= 0:
        return most
    excess = (child.squares - parent.squares - within * freedom) / room
    return most if excess <= 0 else min(most, max(least, 1 / min(excess, 1.0) - 1))


def _squares(n: str, bad: str) -> Column:
    # summed as decimals: the sum doesn't depend on the order of the rows
    return F.sum((F.col(bad).cast("double") * F.col(bad) / F.col(n)).cast("decimal(38,6)"))


def host_reputation(outcomes: DataFrame, two_part: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """(host, n, n_bad, mean, bound) of every host of ``outcomes``, a frame (host, bad).

    ``bad`` is 1, 0 or null; pages with null have no outcome and only make their host known.
    A null host counts as empty. The four totals fetched are one row each.
    """
    hosts = outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_bad")
    ).withColumns({"domain": registered_domain(F.col("host"), two_part), "suffix": suffix_of(F.col("host"), two_part)})
    domains = hosts.groupBy("domain", "suffix").agg(
        F.sum("n").alias("d_n"), F.sum("n_bad").alias("d_bad"), F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).alias("d_n2"),
        F.count(F.when(F.col("n") > 0, 1)).alias("d_hosts"), F.sum(F.when(F.col("n") > 0, (F.col("n_bad").cast("double") * F.col("n_bad") / F.col("n")).cast("decimal(38,6)"))).alias("d_sq"))
    suffixes = domains.groupBy("suffix").agg(
        F.sum("d_n").alias("s_n"), F.sum("d_bad").alias("s_bad"), F.sum(F.col("d_n").cast("decimal(38,0)") * F.col("d_n")).alias("s_n2"),
        F.count(F.when(F.col("d_n") > 0, 1)).alias("s_domains"), F.sum("d_hosts").alias("s_hosts"), F.sum("d_sq").alias("s_host_sq"),
        F.sum(F.when(F.col("d_n") > 0, (F.col("d_bad").cast("double") * F.col("d_bad") / F.col("d_n")).cast("decimal(38,6)"))).alias("s_domain_sq"),
        F.sum(F.when(F.col("d_n") > 0, (F.col("d_n2").cast("double") / F.col("d_n")).cast("decimal(38,6)"))).alias("s_share"))
    t = suffixes.filter("s_n > 0").agg(
        F.count(F.lit(1)).alias("suffixes"), F.sum("s_domains").alias("domains"), F.sum("s_hosts").alias("hosts"),
        F.sum("s_n").alias("n"), F.sum("s_bad").alias("bad"), F.sum("s_host_sq").alias("host_sq"), F.sum("s_domain_sq").alias("domain_sq"),
        _squares("s_n", "s_bad").alias("suffix_sq"), F.sum("s_share").alias("host_share"),
        F.sum((F.col("s_n2").cast("double") / F.col("s_n")).cast("decimal(38,6)")).alias("domain_share"),
        F.sum(F.col("s_n").cast("decimal(38,0)") * F.col("s_n")).alias("suffix_n2"),
    ).first()
    n, bad = t["n"] or 0, t["bad"] or 0
    level = lambda groups, squares, share: Level(groups or 0, n, bad, float(squares or 0), float(share or 0))
    everything = level(1, bad * bad / n if n else 0, n)
    by_suffix = level(t["suffixes"], t["suffix_sq"], (t["suffix_n2"] or 0) / n if n else 0)
    by_domain = level(t["domains"], t["domain_sq"], t["domain_share"])
    by_host = level(t["hosts"], t["host_sq"], t["host_share"])
    w_suffix, w_domain, w_host = prior_weight(by_suffix, everything), prior_weight(by_domain, by_suffix), prior_weight(by_host, by_domain)

    def shrunk(bad: str, n: str, towards: Column, weight: float) -> Column:
        return (F.col(bad) + weight * towards) / (F.col(n) + weight)

    suffix_means = suffixes.select("suffix", shrunk("s_bad", "s_n", F.lit((bad + 0.5) / (n + 1)), w_suffix).alias("_s"))
    domain_means = domains.join(suffix_means, "suffix").select("domain", shrunk("d_bad", "d_n", F.col("_s"), w_domain).alias("_d"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + (w_host + 1)))
    return hosts.join(domain_means, "domain").select(
        "host", "n", "n_bad", shrunk("n_bad", "n", F.col("_d"), w_host).alias("mean")
    ).withColumn("bound", F.col("mean") - z * deviation)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url",
    outcomes: DataFrame | None = None, threshold: float = 0.5, z: float = 1.645, two_part: Sequence[str] = (),
) -> DataFrame:
    """(key, host, path, rule, verdict, bound) for every page.

    The rule's verdict holds where a rule fits; else ``block`` where the bound of the host's bad
    share is at least ``threshold``, ``allow`` otherwise. The known outcomes are those of
    ``outcomes`` (host, bad); by default those of the pages that rules decide. Null urls and urls
    without ``://`` share the empty host. Repeated rows are judged alike, each on its own.
    """
    verdicts = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v))) if rules else F.create_map().cast("map<string,string>")
    rows = pages.select(key, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("_ruled", verdicts[F.col("rule")])
    known = rows.select("host", F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0).alias("bad"))
    if outcomes is not None:
        known = rows.select("host", F.lit(None).cast("int").alias("bad")).unionByName(outcomes.select("host", F.col("bad").cast("int").alias("bad")))
    bounds = host_reputation(known, two_part, z).select("host", "bound")
    method = F.when(F.col("bound") >= threshold, "block").otherwise("allow")
    return rows.join(bounds, "host").select(key, "host", "path", "rule", F.coalesce("_ruled", method).alias("verdict"), "bound")
