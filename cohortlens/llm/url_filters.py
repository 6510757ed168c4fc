"""URL filters: explicit rules first, else the reputation of the host.

Reputation is an empirical-Bayes estimate from labelled pages.  The rate of bad pages is shrunk from
the host to its registered domain, from the domain to its suffix and from the suffix to all pages.
Each level has a beta prior whose mean is its parent's estimate and whose strength follows from the
spread between the members of the level (method of moments for the beta-binomial distribution).
A host is blocked when the lower bound of its posterior rate is above a limit.

Results for odd input: a null url or one without ``://`` has an empty host and path, which form a
host of their own; null ids stay null; repeated rows get equal verdicts; several labels of one page
are several outcomes and null labels none.  Without any labels every host has the neutral prior.
An empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of two labels, besides all last labels.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")


@dataclass(frozen=True)
class Rule:
    """``path`` starts with a slash; the rule holds for the host and all its subdomains.

    Rules stand in the query's plan: give some hundreds at most.
    """

    action: str
    host: str
    path: str = "/"


@dataclass(frozen=True)
class Reputation:
    z: float = 1.645
    block_above: float = 0.5
    least_strength: float = 1.0
    most_strength: float = 1000.0
    neutral: float = 0.1


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(_name(host), ".", -2)
    return (F.when(_is_address(host), "").when(two.isin(*LONG_SUFFIXES), two)
            .otherwise(F.substring_index(_name(host), ".", -1)))


def domain_of(host: Column) -> Column:
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return (F.when(_is_address(host), name)
            .when(two.isin(*LONG_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two))


def _is_address(host: Column) -> Column:
    return host.startswith("[") | _name(host).rlike("^[0-9]+([.][0-9]+){3}$")


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its action; null where none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        action = F.when(fits, rule.action).otherwise(action)
    return text, action


def _shrunk(children: DataFrame, rep: Reputation) -> DataFrame:
    """Adds ``strength`` and the posterior mean ``rate`` to rows of ``n``, ``bad``, ``prior``."""
    p, n, bad = F.col("prior"), F.col("n"), F.col("bad")
    own = n * p * (1 - p)
    excess = (bad - n * p) * (bad - n * p) - own
    rho = children.agg((F.sum(excess) / F.nullif(F.sum(own * (n - 1)), F.lit(0.0))).alias("rho"))
    # within [0, 1]: no spread gives the greatest strength, full spread the least
    strength = F.coalesce(1 / F.nullif(F.greatest("rho", F.lit(0.0)), F.lit(0.0)) - 1,
                          F.lit(rep.most_strength))
    level = rho.select(F.least(F.greatest(strength, F.lit(rep.least_strength)),
                               F.lit(rep.most_strength)).alias("strength"))
    return children.withColumn("strength", level.scalar()).withColumn(
        "rate", (F.col("strength") * p + bad) / (F.col("strength") + n))


def reputations(hosts: DataFrame, rep: Reputation = Reputation()) -> DataFrame:
    """From ``host``, ``n`` labelled and ``bad`` pages: the posterior of every host.

    Adds ``domain``, ``suffix``, ``rate`` (posterior mean), ``lower`` (bound) and ``blocked``.
    """
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"),
                         suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    everything = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 1 / F.lit(rep.neutral))).alias("prior"))
    suffixes = _shrunk(suffixes.withColumn("prior", everything.scalar()), rep)
    domains = _shrunk(domains.join(
        suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), rep)
    hosts = _shrunk(hosts.join(
        domains.select("domain", "suffix", F.col("rate").alias("prior")), ["domain", "suffix"]), rep)
    rate, weight = F.col("rate"), F.col("strength") + F.col("n")
    lower = rate - rep.z * F.sqrt(rate * (1 - rate) / (weight + 1))
    return hosts.select("host", "domain", "suffix", "n", "bad", "rate", lower.alias("lower"),
                        (lower > rep.block_above).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (),
          rep: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url",
          outcome_id: str = "page_id", outcome_bad: str = "bad") -> DataFrame:
    """Id, host, path, rule and verdict of every page.  ``outcome_bad`` is 0, 1 or null."""
    rows = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"),
                        path_of(pages[url_col]).alias("path"))
    known = outcomes.select(outcomes[outcome_id].alias("id"), outcomes[outcome_bad].alias("bad"))
    labelled = (rows.join(known.where("bad IS NOT NULL"), "id").groupBy("host")
                .agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    hosts = (rows.groupBy("host").agg(F.lit(0).alias("none")).join(labelled, "host", "left")
             .select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")))
    blocked = reputations(hosts, rep).select("host", "blocked")
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    return rows.join(blocked, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
