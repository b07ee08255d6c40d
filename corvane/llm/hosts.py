"""URL filters: listed rules first, then the reputation of hosts; DataFrame operations only.

Reputation is empirical Bayes. Labelled outcomes (good 1, bad 0) of pages are counted by
host, registered domain (the last two labels; three after a second-level suffix) and public
suffix. A beta prior passes down: from all pages to suffixes, from a suffix's posterior mean
to its domains, from a domain's to its hosts. Each level's prior strength comes from the
spread of rates between its units by moments. A host is blocked if the upper bound of its
posterior good rate (mean + z standard deviations) is below the threshold.

A null url, or one without ://, has an empty host and path and fits no rule; hosts without
outcomes have their domain's, suffix's or overall posterior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import settle

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Second-level names under which domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def first_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of urls that a rule of the table (rule, verdict) fits, the longest each.

    A url meets a rule by equal keys only: each ending of its host at a dot, and of its path as many characters as rules of that host have.
    """
    slash = F.instr("rule", "/")
    name, start = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")), F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("")
    table = settle(rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict")).select("rule", "verdict", name.alias("name"), start.alias("start")), "rules")
    lengths = table.groupBy("name").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    x = urls.select("host", "path").distinct().select("host", "path", F.explode(endings).alias("name")).join(lengths, "name")
    x = x.select("host", "path", "name", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("start", F.left("path", F.col("n")))
    best = F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule")))
    return x.join(table, ["name", "start"]).groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.rule", "r.verdict")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without port; short hosts and addresses of numbers are their own."""
    name = F.regexp_replace(host, r":[0-9]*\z", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    second = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    size = F.when(second, 2).otherwise(1)
    address = name.rlike(r"\A([0-9]+(\.[0-9]+){3}|\[.*\])\z")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    return F.when(address, name).otherwise(last(size + 1)), F.when(address, name).otherwise(last(size))


def _posterior(units: DataFrame, least: float, most: float) -> DataFrame:
    """Adds a and t, the posterior's good and total counts, from counts (good, n) and the prior mean (prior) of each unit.

    Prior strength by moments: the weighted squared gaps between rates and their priors, less
    what chance explains. It is one number, taken through the driver.
    """
    has = F.col("n") > 0
    v = F.col("prior") * (1 - F.col("prior"))
    gap, chance, weighted = units.agg(
        F.coalesce(F.sum(F.when(has, F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2))), F.lit(0.0)),
        F.coalesce(F.sum(F.when(has, v)), F.lit(0.0)),
        F.coalesce(F.sum(F.when(has, F.col("n") * v)), F.lit(0.0)),
    ).first()
    m = (weighted - chance) / (gap - chance) - 1 if weighted > chance and gap > chance else most
    m = round(min(max(m, least), most), 9)  # sums of floats may differ in their last digits from run to run
    return units.withColumn("a", F.col("good") + m * F.col("prior")).withColumn("t", F.col("n") + m)


def reputation(outcomes: DataFrame, urls: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, n, good, mean, lower, upper) of each host in urls (host), from outcomes (host, good).

    Rows are summed by host before anything else; later steps see one row a host, domain or suffix.
    """
    hosts = urls.groupBy("host").agg(F.lit(0).alias("n"), F.lit(0).alias("good"))
    seen = outcomes.where("good is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    hosts = hosts.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = settle(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = settle(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    good, n = suffixes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    mean = F.col("a") / F.col("t")
    s = _posterior(suffixes.withColumn("prior", F.lit((good + 1) / (n + 2))), least, most).select("suffix", mean.alias("prior"))
    d = _posterior(domains.join(s, "suffix"), least, most).select("domain", mean.alias("prior"))
    h = _posterior(hosts.join(d, "domain"), least, most)
    sd = F.sqrt(mean * (1 - mean) / (F.col("t") + 1))
    return h.select("host", "n", "good", mean.alias("mean"), F.greatest(mean - z * sd, F.lit(0.0)).alias("lower"), F.least(mean + z * sd, F.lit(1.0)).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame = RULES, threshold: float = 0.5, key: str = "page_id", url: str = "url", z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, upper) for each page; outcomes: (page_id, good), good 0 or 1.

    Rules are a list, or a table (rule, verdict) of any size; a list of more than MOST_RULES becomes one.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    given = outcomes.select(F.col(key).alias("labelled"), F.col("good").cast("int").alias("good")).groupBy("labelled").agg(F.min("good").alias("good"))
    found = rows.select("k", "host").join(given, F.col("k") == F.col("labelled")).select("host", "good")
    known = reputation(found, rows.select("host"), z).select(F.col("host").alias("known"), "mean", "upper")
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
    if isinstance(rules, DataFrame):
        fitting = first_rules(rows, rules).withColumnRenamed("verdict", "says")
        rows = rows.join(fitting, ["host", "path"], "left")
        rule, verdict = F.col("rule"), F.col("says")
    else:
        rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    x = rows.join(known, F.col("host") == F.col("known"), "left")
    own = F.when(F.round("upper", 9) < threshold, "block").otherwise("allow")
    return x.select(F.col("k").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("mean", 9).alias("mean"), F.round("upper", 9).alias("upper"))
