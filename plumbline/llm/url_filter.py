"""URL filters: fixed rules, then empirical-Bayes host reputation. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_or_shuffled

#: (action, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Suffixes of two labels under which domains are registered; a fixed choice of common ones, not the whole public list.
SUFFIXES = tuple(f"{second}.{top}" for top, seconds in {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek govt iwi maori net org school", "za": "ac co gov net org web",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "cn": "ac com edu gov net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org",
    "in": "ac co edu firm gen gov ind net nic org res", "id": "ac co go or sch web", "th": "ac co go in net or", "my": "com edu gov net org", "sg": "com edu gov net org", "ph": "com edu gov net org", "vn": "com edu gov net org",
    "br": "com edu gov net org", "ar": "com edu gob gov net org", "mx": "com edu gob net org", "co": "com edu gov net org", "pe": "com edu gob net org", "ve": "co com gob net org", "uy": "com edu gub org",
    "tr": "com edu gen gov k12 net org", "il": "ac co gov k12 net org", "pl": "com edu gov net org", "ua": "com edu gov in net org", "ru": "com msk net org spb", "gr": "com edu gov net org", "pt": "com edu gov org", "es": "com edu gob nom org",
    "eg": "com edu gov org", "sa": "com edu gov net org", "ae": "ac co gov net org", "pk": "com edu gov net org", "bd": "com edu gov net org", "ng": "com edu gov org", "ke": "ac co go or",
}.items() for second in seconds.split())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls. A rule fits its host and all subdomains, and paths that start with its own."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or the last two where SUFFIXES has them; the domain has a label more.

    Hosts of fewer labels are their own.
    """
    two = F.substring_index(host, ".", -2)
    long = two.isin(*SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


#: A prior weighs as many pages as its level's counts say, within these bounds, or this many where they say nothing.
LEAST_STRENGTH, MOST_STRENGTH, STRENGTH = 1.0, 1000.0, 8.0
#: What a prior weighs at least, however little is known of the levels above.
LEAST_PRIOR = 0.01
#: A page is bad above this rate; a host is blocked if its rate is above it with at least this probability.
THRESHOLD, SURE = 0.3, 0.95
#: Steps of the integral over each side of a posterior, and the standard deviations of its logarithmic odds to each side that it covers.
STEPS, REACH = 128, 40


def strength(groups: DataFrame) -> DataFrame:
    """One row with `strength`, the weight in pages of the beta prior of groups(n, bad, mean), by moments.

    Of groups whose rates are drawn from beta distributions with the given means and one strength, sum n (p - mean)^2 is expected to be
    sum mean (1 - mean) (1 + (n - 1) / (strength + 1)). Groups without outcomes don't count.
    """
    v = F.col("mean") * (1 - F.col("mean"))
    seen = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), F.lit(2.0))).alias("q"), F.sum(v).alias("a"), F.sum((F.col("n") - 1) * v).alias("c"))
    share = F.try_divide(F.col("q") - F.col("a"), F.col("c"))
    found = F.when(share > 0, 1 / share - 1).when(share.isNotNull(), MOST_STRENGTH)
    return seen.select(F.coalesce(F.least(F.greatest(found, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(STRENGTH)).alias("strength"))


def _drawn(groups: DataFrame) -> DataFrame:
    """groups(n, bad, mean, weight, ...) with alpha and beta of their posteriors, and their mean and weight in mean and weight.

    mean and weight are those of the parents' posteriors. A parent known by few pages makes the prior as much wider as its own
    posterior is wide.
    """
    one = groups.join(F.broadcast(strength(groups)))
    own = 1 / (1 / (F.col("strength") + 1) + 1 / (F.col("weight") + 1)) - 1
    one = one.withColumn("prior", F.greatest(own, F.lit(LEAST_PRIOR)))
    one = one.withColumns({"alpha": F.col("bad") + F.col("prior") * F.col("mean"), "beta": F.col("n") - F.col("bad") + F.col("prior") * (1 - F.col("mean"))})
    return one.withColumns({"mean": F.col("alpha") / (F.col("alpha") + F.col("beta")), "weight": F.col("n") + F.col("prior")})


def above(alpha: Column, beta: Column, x: float) -> Column:
    """Probability that a beta variable is above x: integrals over its logarithmic odds, where its density has no poles, to both sides of x."""
    reach = REACH * F.sqrt(1 / alpha + 1 / beta)
    middle = F.ln(alpha / beta)
    low, high = middle - reach, middle + reach
    line = F.greatest(low, F.least(high, F.lit(math.log(x / (1 - x)))))
    softly = lambda u: F.ln(1 + F.exp(-F.abs(u))) + F.greatest(u, F.lit(0.0))  # noqa: E731  ln(1 + e^u)
    log = lambda u: -alpha * softly(-u) - beta * softly(u)

    def side(begin: Column, end: Column) -> Column:
        steps = F.sequence(F.lit(0), F.lit(STEPS - 1))
        return (end - begin) * F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.exp(log(begin + (end - begin) * ((k + 0.5) / STEPS)) - log(middle)))

    return side(line, high) / (side(low, line) + side(line, high))


def reputation(outcomes: DataFrame, hosts: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """host, n, bad, rate, sure for outcomes(host string, bad boolean): the posterior mean rate of bad pages, and the probability that the rate is above threshold.

    The hosts of hosts(host string) that have no outcomes are judged as well, with n = 0: by the rate of their domain, or where
    that has no outcomes either by their suffix's, or that of all.

    Beta-binomial shrinkage from the top down: the suffix's rate is drawn to that of all outcomes, the domain's to the
    suffix's, the host's to the domain's. The strength of the prior of each level is estimated from the counts of its groups,
    and weakened where the level above is itself known by few pages.
    Rows with a null outcome don't count; null hosts are left out. Without outcomes no host is surely bad. Counts are added up
    before they are shuffled, so a hot host costs a row a task.
    """
    known = outcomes.where("bad is not null and host is not null")
    counted = known.select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    if hosts is not None:
        none = F.lit(0).cast("long")
        counted = counted.unionByName(hosts.where("host is not null").select("host", none.alias("n"), none.alias("bad")))
    domain, suffix = levels(F.col("host"))
    host = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumns({"domain": domain, "suffix": suffix})
    # Each level is read twice, for its strength and for its posteriors, so it is stored: a row a host, domain or suffix.
    host = materialise(host, "hosts")
    by = {k: host.groupBy(k).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) for k in ("suffix", "domain")}
    # The mean of all is kept from 0 and 1, where a beta distribution has no width.
    whole = host.agg(F.coalesce((F.sum("bad") + 0.5) / (F.sum("n") + 1.0), F.lit(0.5)).alias("mean"), F.coalesce(F.sum("n") + 1.0, F.lit(1.0)).alias("weight"))
    top = materialise(by["suffix"].join(F.broadcast(whole)), "suffixes")
    mid = by["domain"].withColumn("suffix", levels(F.col("domain"))[1]).join(_drawn(top).select("suffix", "mean", "weight"), "suffix")
    mid = materialise(mid, "domains")
    low = materialise(host.join(_drawn(mid).select("domain", "mean", "weight"), "domain"), "priors")
    any_ = host.agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("any"))
    out = _drawn(low).join(F.broadcast(any_)).select("host", "n", "bad", F.col("mean").alias("rate"), F.when(F.col("any"), above(F.col("alpha"), F.col("beta"), threshold)).otherwise(0.0).alias("sure"))
    out = materialise(out, "reputation")
    discard(host, top, mid, low)
    return out


def judge(pages: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, sure: float = SURE, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages(url) with host, path, rule, sure double and verdict: the rule's action, or block where the host's rate of bad pages is above threshold with probability `sure`.

    Hosts without outcomes are judged by their domain's, their suffix's or the overall rate. Null urls and urls without '://'
    have empty host and path and no rule, and are allowed unless the empty host has outcomes of its own. Of rules of equal
    length that fit, the last in order of their text wins. Null ids and repeated rows are rows like others; an empty table stays
    empty. Other columns stay; existing ones of these names are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "sure", "verdict")]
    split = pages.select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes, split.select("host").where("host <> ''"), threshold).select("host", "sure")
    judged = split.withColumns({"rule": rule, "__action": action}).join(small_or_shuffled(known, known.count()), "host", "left")
    verdict = F.coalesce("__action", F.when(F.col("sure") >= sure, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*keep, "host", "path", "rule", "sure", verdict.alias("verdict"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose id has a row in labels(doc_id, quality, toxic): bad where quality is 0 or toxic is 1."""
    own = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("page_id", host_of(F.col("url")).alias("host")).join(own, "page_id")
