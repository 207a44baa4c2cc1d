"""Operator 1, URL filters: Empirical-Bayes host reputation, DataFrame functions only.

Every host's labelled outcomes are a binomial sample. Its bad-page rate is shrunk towards the rate of
its registered domain, that towards the rate of its public suffix, and that towards the overall rate;
each level's prior strength is estimated from the spread between the groups of that level (ANOVA
estimate of the intra-class correlation of a beta-binomial). A host is blocked when the lower posterior
bound of its bad-page rate exceeds a limit. Explicit rules go before the reputation.

Defined results: a null url, or one without `://`, has an empty host and path and is judged by the
overall rate alone; a host without labelled pages inherits its domain's posterior; with no labels at all
the rate is 0.5 with no strength behind it, so nothing is blocked. Hosts that differ in port or user are hosts of one
domain; an address of numbers is a domain of its own without suffix. Repeated pages count as often as they
occur. Rules of equal length that both fit are the same text, so they do not tie; a bound equal to the limit allows. Very long
urls are judged whole; the html is not read. An empty table gives an empty result. Only the named columns are read, so extra columns of any name are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Public suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.kr",
    "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx", "com.tr",
)
_SUFFIX = "|".join(s.replace(".", "\\.") for s in TWO_LABEL_SUFFIXES) + "|[^.]+"
HOST_RE = "(?s)^.*?://([^/?#]*)"
PATH_RE = "(?s)^.*?://[^/?#]*([^?#]*)"
# The name within a host: without user and port; an address of numbers has no domain above it.
NAME_RE = "(?s)^(?:.*@)?(.*?)(?::[0-9]*)?$"
ADDRESS_RE = "^(?:[0-9.]+|\\[.*)$"
DOMAIN_RE = f"([^.]+\\.(?:{_SUFFIX}))$"
SUFFIX_RE = f"(?:^|\\.)({_SUFFIX})$"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_BAD_RATE, Z = 0.3, 1.645
MIN_RHO, MAX_RHO = 0.001, 0.95


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_RE, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH_RE, 1)


def registered_domain(host: Column) -> Column:
    name = F.regexp_extract(host, NAME_RE, 1)
    found = F.regexp_extract(name, DOMAIN_RE, 1)
    return F.when((found == "") | name.rlike(ADDRESS_RE), name).otherwise(found)


def public_suffix(host: Column) -> Column:
    name = F.regexp_extract(host, NAME_RE, 1)
    return F.when(name.rlike(ADDRESS_RE), "").otherwise(F.regexp_extract(name, SUFFIX_RE, 1))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, null if none does; rules are a short list, given as a parameter."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength m of a level, from its groups' sizes n and bad counts k."""
    total = groups.agg(
        F.sum("n").cast("double").alias("N"), F.sum("k").cast("double").alias("K"), F.count(F.lit(1)).cast("double").alias("J"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("S"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("P"),
    )
    mu = F.col("K") / F.col("N")
    spread = F.try_divide(F.col("P") - mu * F.col("K"), mu * (1 - mu)) - (F.col("J") - 1)
    rho = F.try_divide(spread, F.col("N") - F.col("S") / F.col("N") - (F.col("J") - 1))
    rho = F.least(F.greatest(F.coalesce(rho, F.when(F.col("N").isNull(), MAX_RHO).otherwise(MIN_RHO)), F.lit(MIN_RHO)), F.lit(MAX_RHO))
    return total.select(((1 - rho) / rho).alias("m"), F.coalesce((F.col("K") + 0.5) / (F.col("N") + 1), F.lit(0.5)).alias("mu"))


def host_reputation(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Posteriors by host, domain and suffix from outcomes(host, bad 0/1); the last holds three strengths and the rate.

    Only four numbers come to the driver. The tables have a row for each labelled host, domain and suffix.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rows = {}
    for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes)):
        got = _strength(level).first()
        rows[name], rows["mu"] = got["m"], got["mu"]
    suffixes = suffixes.select("suffix", ((F.col("k") + rows["suffix"] * rows["mu"]) / (F.col("n") + rows["suffix"])).alias("s_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + rows["domain"] * F.col("s_mean")) / (F.col("n") + rows["domain"])).alias("d_mean"))
    return hosts.select("host", "n", "k"), domains, suffixes, rows


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict for pages(page_id, url), given outcomes(host, bad)."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts, domains, suffixes, m = host_reputation(outcomes, z)
    # Posteriors are worked out once a host, however many pages it has.
    seen = urls.groupBy("host").agg(F.lit(1).alias("one")).drop("one")
    seen = seen.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    seen = seen.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    mean = F.coalesce("d_mean", "s_mean", F.lit(m["mu"]))
    a = F.coalesce("k", F.lit(0)) + m["host"] * mean
    b = F.coalesce("n", F.lit(0)) - F.coalesce("k", F.lit(0)) + m["host"] * (1 - mean)
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    seen = seen.select(F.col("host").alias("_host"), F.xxhash64("host").alias("_dealt"), F.when(low > max_bad_rate, "block").otherwise("allow").alias("_own"))
    # The join is on a column more than the grouping, so that Spark deals both sides anew and can split a hot host.
    joined = urls.withColumn("_key", F.xxhash64("host")).join(seen, (F.col("host") == F.col("_host")) & (F.col("_key") == F.col("_dealt")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.col("_own")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, F.lit(what)).otherwise(verdict)
    return joined.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """outcomes(host, bad): the page's number in its path (`/en/123.html`) names the labelled document.

    A page is bad if its document is toxic or of low quality; null marks count as good.
    """
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), (F.col("toxic") == 1), (F.col("quality") == 0), F.lit(False))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    path = url_path(F.col("url"))
    number = F.expr("try_cast(_number as bigint)")
    named = pages.select(url_host(F.col("url")).alias("host"), F.regexp_extract(path, "^/[^/]+/([0-9]+)", 1).alias("_number")).select("host", number.alias("_doc"))
    return named.join(marks, named["_doc"] == marks["doc_id"]).select("host", "bad")
