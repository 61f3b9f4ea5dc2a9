"""URL filter: explicit rules first, then the host's reputation (DataFrame functions only).

A URL's host is what stands after its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; its path goes on to ``?``, ``#`` or the end. A rule (action, ``host/path``) fits its
host and all subdomains where the URL's path starts with the rule's; the longest fitting rule wins
(equally long: the longer host; one rule with both actions blocks).

Reputation is empirical Bayes over labelled page outcomes (bad or not) of three levels, host within
registered domain within public suffix. Each level's rates are taken as beta distributed around the
level above: a suffix around the overall rate, a domain around its suffix's shrunk rate, a host
around its domain's. The spread rho of a level comes from the data by moments,

    sum (k - n m)^2 = sum n m (1 - m) + rho * sum n (n - 1) m (1 - m),

k bad of n labelled pages, m the rate of the level above; the prior weighs 1 / rho - 1 pages. So a host
with few labels stays near its domain, one with many speaks for itself. A host is blocked where its
posterior puts at least ``confidence`` on a rate above ``max_bad``: the lower posterior bound, not the
mean, has to be bad. The bound is an incomplete beta function of Spark expressions.

Scale. Outcomes are counted per host with partial aggregation, so a host with a third of all pages is
one row per task. Pages get their host's verdict by a broadcast of the host table where that has at
most ``broadcast_hosts`` rows (counted); beyond, only hosts with more than a ``broadcast_hosts``-th of
the pages, necessarily fewer than that many, are broadcast, and the others, none of them hot, are
joined. Domains and suffixes are joined to hosts as written tables, broadcast under the session's
size threshold, else with AQE's splitting of skewed partitions. Rules are at most MAX_RULES.

Defined results: a null URL, or one without ``://``, has empty host and path; the empty host has a
reputation like any other. A port or user stays part of the host, but not of its domain. A suffix is
the longest listed one, else the last label; a bare suffix or an address of digits is its own domain.
Labels of one page count once (bad if any label is); labels of null or unknown pages, and null
outcomes, count nowhere; repeated pages count as often as they occur. Without any label every host
gets the uniform prior, which blocks nothing at the defaults. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.stats import beta_share_col
from cohortlens.sources.sinks import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000
#: Bounds of rho, so that a level's prior weighs between 1 and 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Public suffixes of more than one label (a parameter; single labels need no entry).
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(rule, action, host, path), the rule that wins first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = []
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {action} {rule}")
        out.append((rule, action, host.lower(), slash + path))
    return sorted(out, key=lambda r: (-len(r[0]), -len(r[2]), r[1] != "block", r[0]))


def winning_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, action) of the rule that wins, or null."""
    none = F.lit(None).cast("struct<rule:string,action:string>")
    out = F.when(F.lit(False), none)
    for rule, action, rule_host, rule_path in rule_table(rules):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = out.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action")))
    return out


def with_domain(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``hosts`` (host) with its registered ``domain`` and public ``suffix``."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    x = hosts.withColumn("_bare", bare).withColumn("_l", F.split("_bare", r"\."))
    last = lambda k: F.array_join(F.slice("_l", -F.least(F.lit(k), F.size("_l")), k), ".")
    longest = max([1, *(s.count(".") + 1 for s in suffixes)])
    labels = F.lit(1)
    for k in range(2, longest + 1):
        listed = [s for s in suffixes if s.count(".") + 1 == k]
        if listed:
            labels = F.when(last(k).isin(listed), F.lit(k)).otherwise(labels)
    labels = F.when(F.col("_bare").rlike(r"^[0-9.]*$"), F.size("_l")).otherwise(labels)
    x = x.withColumn("_k", labels)
    tail = lambda k: F.array_join(F.slice("_l", -F.least(k, F.size("_l")), F.size("_l")), ".")
    return x.withColumns({"domain": tail(F.col("_k") + 1), "suffix": tail(F.col("_k"))}).drop("_bare", "_l", "_k")


def host_outcomes(pages: DataFrame, labels: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, pages, n, k): pages, labelled and bad ones per host. pages: (id, host);
    labels: (id, bad)."""
    known = labels.filter("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    # counted per page and host before the join, so that a repeated page is one row per task
    counted = pages.groupBy("id", "host").agg(F.count(F.lit(1)).alias("c"))
    seen = counted.filter("id is not null").join(known, "id")
    n = seen.groupBy("host").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("bad"), F.col("c")).otherwise(0)).alias("k"))
    every = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    x = every.join(n, "host", "left").fillna(0, ["n", "k"])
    return with_domain(x, suffixes)


def _weight(rows: DataFrame) -> float:
    """Pages that the prior of a level weighs. rows: (n, k, above), above the rate of the level above."""
    m, n, k = F.col("above"), F.col("n"), F.col("k")
    var = m * (1 - m)
    got = rows.agg(F.sum((k - n * m) * (k - n * m) - n * var), F.sum(n * (n - 1) * var)).first()
    rho = got[0] / got[1] if got[1] else MOST_RHO  # nothing known: a weak prior
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def _shrunk(rows: DataFrame, key: str) -> DataFrame:
    """(key, above): the shrunk rate of each of ``rows``, which is above those of the next level."""
    rows = materialize(rows, f"{key}-outcomes")
    w = F.lit(_weight(rows))
    return materialize(rows.select(key, ((w * F.col("above") + F.col("k")) / (w + F.col("n"))).alias("above")), f"{key}-rates")


def reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (written) with the posterior Beta(a, b) of each host's bad rate."""
    total = outcomes.agg(F.sum("n"), F.sum("k")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = _shrunk(outcomes.groupBy("suffix").agg(*counts).withColumn("above", F.lit(overall)), "suffix")
    domains = _shrunk(outcomes.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix"), "domain")
    rows = outcomes.join(domains, "domain")
    w, m = F.lit(_weight(rows)), F.col("above")
    return rows.withColumns({"a": w * m + F.col("k"), "b": w * (1 - m) + F.col("n") - F.col("k")}).drop("above")


def judged_hosts(pages: DataFrame, labels: DataFrame, max_bad: float, confidence: float, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, pages, n, k, a, b, p_bad, verdict) per host, written; ``p_bad`` is the
    posterior probability that more than ``max_bad`` of its pages are bad."""
    outcomes = materialize(host_outcomes(pages, labels, suffixes), "host-outcomes")
    p = F.lit(1.0) - beta_share_col(F.lit(float(max_bad)), F.col("a"), F.col("b"))
    x = reputation(outcomes).withColumn("p_bad", p)
    return materialize(x.withColumn("verdict", F.when(F.col("p_bad") >= confidence, F.lit("block")).otherwise(F.lit("allow"))), "hosts")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), max_bad: float = 0.3, confidence: float = 0.9,
          suffixes: Sequence[str] = SUFFIXES, broadcast_hosts: int = 50_000, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, p_bad) per row of ``pages``; labels: (id, bad)."""
    host, path = host_and_path(F.col(url))
    x = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    hosts = judged_hosts(x.select("id", "host"), labels, max_bad, confidence, suffixes)
    told = hosts.select("host", "pages", "p_bad", F.col("verdict").alias("_v"))
    count, total = hosts.agg(F.count(F.lit(1)), F.sum("pages")).first()
    if count <= broadcast_hosts:
        y = x.join(F.broadcast(told.drop("pages")), "host")
    else:
        hot = F.col("pages") > total / broadcast_hosts
        keys = F.broadcast(told.filter(hot).select("host"))
        y = x.join(F.broadcast(told.filter(hot).drop("pages")), "host").unionByName(
            x.join(keys, "host", "left_anti").join(told.filter(~hot).drop("pages"), "host"))
    y = y.withColumn("_r", winning_rule(F.col("host"), F.col("path"), rules))
    return y.select("id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.action", "_v").alias("verdict"), "p_bad")
