"""URL filters: empirical-Bayes host reputation.

Explicit rules decide first (longest wins).  All other pages are judged by their host: labelled outcomes are shrunk
through beta-binomial priors from suffix to registered domain to host, and a page is blocked if the posterior's
lower bound of the share of bad pages exceeds a limit.  Everything is a join or an aggregate over hosts; per page there
is one join with the host's verdict and one with the rules that fit the host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unionlake.llm.columns import fresh
from unionlake.session import materialize

#: Suffixes of two labels under which names are registered (fixed values; a parameter of ``judge``).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")


@dataclass(frozen=True)
class ReputationParams:
    """limit: a host is blocked if the lower bound of its bad share is above it.  z: standard deviations between the
    posterior mean and the bound.  min_strength, max_strength: range of a prior's weight in pages."""

    limit: float = 0.5
    z: float = 1.645
    min_strength: float = 2.0
    max_strength: float = 1000.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or if null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes=TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, mean: Column, p: ReputationParams, by: list[str]) -> DataFrame:
    """by + (strength): the weight of a beta prior for the groups (n, bad) below each parent, by the method of moments:
    the variance of their shares beyond the binomial part."""
    share = F.col("bad") / F.col("n")
    var = F.sum(F.col("n") * F.pow(share - mean, F.lit(2))) / F.sum("n")
    binomial = F.first(mean) * (1 - F.first(mean)) * F.count(F.lit(1)) / F.sum("n")
    total = F.first(mean) * (1 - F.first(mean))
    beyond = F.greatest(var - binomial, F.lit(1e-9))
    strength = F.least(F.greatest(total / beyond - 1, F.lit(p.min_strength)), F.lit(p.max_strength))
    grouped = groups.groupBy(*by) if by else groups.groupBy()
    return grouped.agg(strength.alias("strength"))


def reputations(hosts: DataFrame, p: ReputationParams = ReputationParams(), suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, lower) from (host, n, bad), labelled pages and bad ones per host (n may be 0).

    Each level's prior mean is its parent's posterior mean; its weight is fitted over all groups below the parent, and
    over all groups of the level at once for the suffixes."""
    h = hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad")
    h = materialize(h, "url-hosts")
    sums = [F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")]
    domains, tops = h.groupBy("suffix", "domain").agg(*sums), h.groupBy("suffix").agg(*sums)
    everything = tops.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m0"))
    seen = F.col("n") > 0

    def shrink(level: DataFrame, prior: str, out: str) -> DataFrame:
        return level.withColumn(out, (F.col("bad") + F.col(prior) * F.col("strength")) / (F.col("n") + F.col("strength")))

    one = tops.withColumn("m0", everything.scalar())
    fit = _strength(one.where(seen), F.col("m0"), p, [])
    tops = shrink(one.withColumn("strength", F.coalesce(fit.scalar(), F.lit(p.min_strength))), "m0", "m1").select("suffix", "m1")
    level = domains.join(tops, "suffix")
    fit = _strength(level.where(seen), F.col("m1"), p, ["suffix"])
    level = level.join(fit, "suffix", "left").fillna(p.min_strength, ["strength"])
    domains = shrink(level, "m1", "m2").select("domain", "m2")
    level = h.join(domains, "domain")
    fit = _strength(level.where(seen), F.col("m2"), p, ["domain"])
    level = shrink(level.join(fit, "domain", "left").fillna(p.min_strength, ["strength"]), "m2", "mean")
    weight = F.col("n") + F.col("strength")
    return level.select("host", "n", "bad", "mean", (F.col("mean") - p.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))).alias("lower"))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules (host, path, action) of itself and its parent domains, longest first.
    rules: columns rule (``host/path``) and action.  Ties of length: the longer host, then ``block``."""
    parsed = rules.select(
        F.col("rule"), F.col("action"),
        F.lower(F.substring_index("rule", "/", 1)).alias("at"), F.expr("substring(rule, instr(rule, '/'))").alias("path"),
    )
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.select("host", F.explode(F.array_distinct(parents)).alias("at"))
    found = up.join(parsed, "at").select("host", F.struct((-F.length("rule")).alias("o"), (-F.length("at")).alias("h"), (F.col("action") != "block").alias("a"), "rule", "path", "action").alias("r"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("rules"))


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", label_id: str = "page_id", bad: str = "bad", params: ReputationParams = ReputationParams(), suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule and verdict in one struct column ``url_verdict`` (or a fresh name beside a clash).

    labels: label_id and a boolean ``bad``; a page labelled twice is bad if any label says so; a null ``bad`` is no
    label.  Null urls have an empty host and path, fit no rule and share the reputation of the empty host.  Without
    any label every host stands at an even prior and is allowed.  Repeated page rows each get their verdict and their
    labels count once per row."""
    host, path, verdicts, out, k = fresh(pages, "host", "path", "host_facts", "url_verdict", "host_key")
    named = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    marks = labels.where(F.col(bad).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.max(F.col(bad).cast("int")).alias("b"))
    # per host counts come from narrow rows: no page content is shuffled
    counted = pages.select(F.col(page_id).alias("id"), host_of(F.col(url)).alias("host")).join(marks, F.col("id") == F.col("label_id"), "left").groupBy("host").agg(F.count("b").cast("double").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("bad"))
    seen = reputations(counted, params, suffixes)
    facts = seen.join(fitting_rules(seen.select("host"), rules), "host", "left").select(F.col("host").alias(k), F.struct("rules", "n", "bad", "mean", "lower").alias(verdicts))
    facts = materialize(facts, "url-verdicts")
    best = F.get(F.filter(F.coalesce(F.col(verdicts)["rules"], F.array().cast("array<struct<o:int,h:int,a:boolean,rule:string,path:string,action:string>>")), lambda r: F.startswith(F.col(path), r["path"])), F.lit(0))
    method = F.when(F.col(verdicts)["lower"] > params.limit, "block").otherwise("allow")
    judged = named.join(facts, F.col(host) == F.col(k), "left").withColumn(out, F.struct(
        F.col(host).alias("host"), F.col(path).alias("path"), best["rule"].alias("rule"), F.coalesce(best["action"], method).alias("verdict"),
        F.col(verdicts)["n"].cast("long").alias("labelled"), F.col(verdicts)["bad"].cast("long").alias("bad"), F.col(verdicts)["mean"].alias("mean"), F.col(verdicts)["lower"].alias("lower")))
    return judged.select(*pages.columns, out)
