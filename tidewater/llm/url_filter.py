"""URL filtering by rules and by empirical-Bayes host reputation, with DataFrame operations only.

Rules decide the pages that they fit; the longest wins, and a block rule wins between equal ones.
All other pages go by their host's reputation. Labelled page outcomes (here by default: the
verdicts of the rules) are counted for each host, registered domain and suffix. A suffix is the longest of ``suffixes``
that ends the host (such as ``co.uk``), or else its last label; the registered domain has one label more. Each level's rate of bad pages is shrunk towards its parent's through a
beta-binomial prior whose strength comes from the spread of rates within parents (method of
moments); a host is blocked if the lower posterior bound of its rate exceeds ``limit``.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule, and is
judged by the prior of its (empty) host like any other; null or repeated page ids are kept; without labelled
pages every page without a rule is allowed; an empty table gives no rows. Only the id and url columns are read.

Scale: hosts are summed map-side before the shuffle and the counts are written once, as every level reads them; ``suffixes`` is a
parameter and bounds what is broadcast; pages join the host table on their host in a
plain equi-join, whose hot hosts adaptive execution splits. Three one-row aggregates reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stash

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; a rule fits its host and all subdomains."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _spread(level: DataFrame, mean: str) -> float:
    """Strength of the beta prior: ANOVA estimate of the correlation within groups."""
    d = F.col("bad") / F.col("n") - F.col(mean)
    one = level.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * d * d).alias("s")
    ).first()
    if not one["k"] or one["k"] < 2:
        return 1.0
    p = one["bad"] / one["n"]
    noise = p * (1 - p)
    room = one["n"] - one["sq"] / one["n"] - (one["k"] - 1)
    if noise <= 0 or room <= 0:
        return 1.0
    rho = min(max((one["s"] - noise * (one["k"] - 1)) / (noise * room), 1e-3), 0.5)
    return 1 / rho - 1


def with_levels(hosts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """``hosts`` with domain and suffix."""
    labels = F.split("host", r"\.")
    if not suffixes:
        return hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.element_at(labels, -1)})
    # all endings of a host of whole labels, of which the longest known one counts
    longest = max(s.count(".") + 1 for s in suffixes)
    known = hosts.sparkSession.createDataFrame([(s.lower(),) for s in set(suffixes)], "_ending string")
    endings = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(longest)))).alias("_n"))
    endings = endings.withColumn("_ending", F.expr("substring_index(host, '.', -_n)")).join(F.broadcast(known), "_ending", "left_semi")
    found = endings.groupBy("host").agg(F.max("_n").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(1))
    return hosts.join(found, "host", "left").withColumn("_n", n).withColumns({"domain": F.expr("substring_index(host, '.', -(_n + 1))"), "suffix": F.expr("substring_index(host, '.', -_n)")}).drop("_n")


def host_reputation(hosts: DataFrame, z: float = 1.645, limit: float = 0.5, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, n, bad) of labelled pages -> host, rate, bound and blocked, by shrinkage through three levels."""
    hosts = with_levels(hosts.select("host", "n", "bad"), suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (whole["bad"] or 0) / whole["n"] if whole["n"] else 0.0

    def shrunk(level: DataFrame, parent: str, strength: float) -> Column:
        return (F.lit(strength) * F.col(parent) + F.col("bad")) / (F.lit(strength) + F.col("n"))

    suffixes = suffixes.withColumn("_p", F.lit(mean))
    s = suffixes.select("suffix", shrunk(suffixes, "_p", _spread(suffixes, "_p")).alias("suffix_rate"))
    domains = domains.join(s, "suffix")
    d = domains.select("domain", "suffix", shrunk(domains, "suffix_rate", _spread(domains, "suffix_rate")).alias("domain_rate"))
    hosts = hosts.join(d, ["domain", "suffix"])
    strength = _spread(hosts, "domain_rate")
    hosts = hosts.withColumn("rate", shrunk(hosts, "domain_rate", strength))
    sd = F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / (F.lit(strength + 1) + F.col("n")))
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - F.lit(z) * sd).alias("bound")).withColumn("blocked", F.col("bound") > F.lit(limit))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], outcome: Column | None = None, z: float = 1.645, limit: float = 0.5, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's bound. ``outcome`` (true: bad, null: not labelled) replaces the rules' verdicts as labels."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), *([outcome.alias("_bad")] if outcome is not None else []))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_action": action})
    if outcome is None:
        rows = rows.withColumn("_bad", F.col("_action") == "block")
    counts = stash(rows.groupBy("host").agg(F.count("_bad").alias("n"), F.count_if("_bad").alias("bad")))
    judged = host_reputation(counts, z, limit, suffixes).select(F.col("host").alias("_host"), F.round("bound", 6).alias("bound"), "blocked")
    rows = rows.join(judged, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce(F.col("_action"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")
