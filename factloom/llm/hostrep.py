"""URL filters: rules first, then host reputation by empirical Bayes.

Labelled page outcomes are counted by host. A host's rate of bad pages has a beta prior centred on
its registered domain's posterior mean, the domain's on its public suffix's, the suffix's on the
overall rate; the strength of each level's prior comes from how much the rates of that level scatter
(method of moments of the beta-binomial). A host is blocked where even the lower bound of its posterior is
above the limit. All of it is DataFrame code; counts are made per host before anything is joined.

Outcomes are an input, a table of pages and whether they were bad. :func:`labels_of` makes one of a table of labels whose
ids are those of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels, besides every single label.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.tr co.in co.kr co.za com.mx".split()
MAX_BAD, DEVIATIONS = 0.5, 1.645
MOST_RULES = 500


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; equal lengths: the smaller text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules are one expression; join longer lists by host instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; an address, or a bare suffix, is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    labels = F.filter(F.split(bare, r"\."), lambda x: x != "")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    width = F.when(two.isin(TWO_LABEL_SUFFIXES), 2).otherwise(1)
    suffix = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - width + 1, F.lit(1)), width))
    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - width, F.lit(1)), width + 1))
    address = bare.rlike(r"^\d+\.\d+\.\d+\.\d+$|^\[")
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def _strength(groups: DataFrame, mean: str) -> float:
    """The prior's strength s = 1/rho - 1, rho from the scatter of rates around ``mean``: one number of one aggregate."""
    n, m = F.col("n").cast("double"), F.col(mean)
    a = groups.where("n > 0").agg(
        F.sum(n * F.pow(F.col("bad") / n - m, 2)).alias("scatter"), F.sum(n * m * (1 - m)).alias("binomial"), F.sum(m * (1 - m)).alias("each"),
    )
    rho = (F.col("scatter") - F.col("each")) / (F.col("binomial") - F.col("each"))
    rho = F.when((F.col("binomial") - F.col("each")) > 0, F.greatest(F.lit(1e-3), F.least(F.lit(0.9), rho))).otherwise(F.lit(0.1))
    return a.select((1 / F.coalesce(rho, F.lit(0.1)) - 1).alias("strength")).first().strength


def reputations(hosts: DataFrame, *, deviations: float = DEVIATIONS) -> DataFrame:
    """host, posterior, low and high of the bad rate, for ``hosts(host, n, bad)`` of distinct hosts.

    Hosts, and the domains and suffixes that they add up to, are written once each, as two numbers are taken from every
    level before the next one is joined. Hot domains and suffixes are left to Spark's skew join: the other side of each join has one row for a key.
    """
    scratch = Scratch(hosts.sparkSession, "hosts")
    domain, suffix = _levels(F.col("host"))
    hosts = scratch.write(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = scratch.write(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = scratch.write(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("overall")).first().overall

    def shrink(groups: DataFrame, mean: str, name: str) -> tuple[DataFrame, Column]:
        s = F.lit(_strength(groups, mean))
        return groups.withColumn(name, (F.col("bad") + s * F.col(mean)) / (F.col("n") + s)), s

    suffixes, _ = shrink(suffixes.withColumn("overall", F.lit(overall)), "overall", "suffix_mean")
    domains, _ = shrink(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean")
    domains = scratch.write(domains.select("domain", "suffix", "domain_mean"), "domain-means")
    own, s = shrink(scratch.write(hosts.join(domains, ["domain", "suffix"]), "host-means"), "domain_mean", "posterior")
    a = F.col("bad") + s * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + s * (1 - F.col("domain_mean"))
    wide = deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    p = F.col("posterior")
    return own.select("host", "n", "bad", "posterior", F.greatest(F.lit(0.0), p - wide).alias("low"), F.least(F.lit(1.0), p + wide).alias("high"))


def judge(spark: SparkSession, pages: DataFrame, outcomes: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, max_bad: float = MAX_BAD, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict, posterior and low of every row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` are labelled outcomes (bad: boolean; null counts as unlabelled; several
    of one page count once, bad if any is). Verdict: the longest fitting rule's, else block where the
    lower bound of the host's posterior bad rate is above ``max_bad``, else allow. Null url or one without
    ``://``: empty host and path, judged as host '' is. Null page_id: judged, never labelled. Repeated
    rows: each its own row. Extra columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    # labelled pages alone are joined (so none without an id); every other page only names its host
    labelled = rows.join(known, "page_id").select("host", F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad"))
    every = rows.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad")).unionByName(labelled)
    hosts = every.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = reputations(hosts, deviations=deviations).select("host", "posterior", "low")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("posterior", 6).alias("posterior"), F.round("low", 6).alias("low"))


def labels_of(labels: DataFrame) -> DataFrame:
    """(page_id, bad) from ``labels(doc_id, quality, toxic)``: bad is low quality, or toxic."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False))) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    some = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    return labels.select(F.col("doc_id").alias("page_id"), F.when(some, bad).alias("bad"))
