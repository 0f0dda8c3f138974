"""URL filter: fixed rules first, else empirical-Bayes host reputation
(DataFrame functions only).

A host's labelled pages are good or bad.  Few pages say little, so each host's
share of good pages is shrunk to that of its registered domain, the domain's to
its suffix, and the suffix's to the whole table: at every level the children's shares
are taken as beta distributed around the parent's mean, and the strength of that
prior (its pseudo-count) is fitted by the method of moments from how much the
children differ beyond binomial chance.  A page is allowed if the lower posterior
bound of its host, ``mean - z * deviation``, reaches ``least_good``.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and is judged by the suffix-level prior of the empty host like any other host; pages
with a null outcome do not count; hosts without any outcome take their
domain's, suffix's or the table's posterior; with no outcome at all the prior is even.
Repeated rows count each; extra columns do not take part.

Registered domain: the last two labels of a host, or the last three if the last two are a
two-part public suffix listed in ``TWO_PART``.  A port or user name stays part of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.llm.common import cut_lineage, hot_join

TWO_PART = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "com.br", "co.in", "co.nz", "com.cn", "com.mx"]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
Z = 1.645
LEAST_GOOD = 0.8
#: Pseudo-counts of a prior stay in this range.
STRENGTH = (2.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    p = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, p, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits.  The rules are
    a literal list, tested longest first."""
    rule = verdict = None
    for action, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, action).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


def domain_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.when(F.substring_index(host, ".", -2).isin(TWO_PART), 3).otherwise(2)
    return F.when(n == 3, F.substring_index(host, ".", -3)).otherwise(F.when(F.size(labels) > 2, F.substring_index(host, ".", -2)).otherwise(host))


def suffix_of(domain: Column) -> Column:
    two = F.substring_index(domain, ".", -2)
    return F.when(two.isin(TWO_PART), two).otherwise(F.substring_index(domain, ".", -1))


def strength(children: DataFrame) -> Column:
    """Pseudo-count of the beta prior, by moments.  children(n, good, mean): outcomes
    of each child and its parent's mean.  With weights n, the expected squared
    distance is v * (1 + (n - 1) * rho), v = mean * (1 - mean), rho = 1 / (strength + 1)."""
    v = F.col("mean") * (1 - F.col("mean"))
    seen = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mean"), 2))
    chance, extra = F.sum(v), F.sum(v * (F.col("n") - 1))
    rho = F.when(extra > 0, (seen - chance) / extra)
    s = F.when(rho > 0, 1 / rho - 1).otherwise(STRENGTH[1])
    return F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.coalesce(s, F.lit(STRENGTH[0]))))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, rows, outcomes, good, mean, bound) of every host in outcomes(host, good):
    good 1, 0 or null.  All levels above the hosts are aggregates of the host table."""
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("rows"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = cut_lineage(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    all_n, all_good = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    top = (float(all_good) + 1) / (all_n + 2)

    def shrunk(level: DataFrame) -> DataFrame:
        """Posterior mean of a level with its parents' ``mean``."""
        s = level.where("n > 0").agg(strength(level)).first()[0]
        a, b = F.col("good") + s * F.col("mean"), F.col("n") - F.col("good") + s * (1 - F.col("mean"))
        m = a / (a + b)
        return level.withColumn("post", m).withColumn("deviation", F.sqrt(m * (1 - m) / (a + b + 1)))

    suffixes = cut_lineage(shrunk(suffixes.withColumn("mean", F.lit(top))).select("suffix", F.col("post").alias("mean")))
    domains = cut_lineage(shrunk(domains.join(suffixes, "suffix")).select("domain", F.col("post").alias("mean")))
    out = shrunk(hosts.join(domains, "domain"))
    return out.select("host", "rows", F.col("n").alias("outcomes"), "good", F.col("post").alias("mean"), (F.col("post") - z * F.col("deviation")).alias("bound"))


def judge_urls(pages: DataFrame, outcome: Column, key: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES,
               least_good: float = LEAST_GOOD, z: float = Z) -> DataFrame:
    """(key, host, path, rule, verdict, bound) of every page.  ``outcome``: 1, 0 or
    null, over the columns of ``pages``."""
    host, path = host_path(F.col(url))
    rows = cut_lineage(pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), outcome.cast("long").alias("good")))
    stats = reputation(rows.select("host", "good"), z).select("host", "rows", "bound")
    out = hot_join(rows.select("key", "host", "path"), stats, "host", "rows")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") >= least_good, "allow").otherwise("block")
    return out.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.round("bound", 6).alias("bound"))


def readable_share(html: Column) -> Column:
    """Outcome for pages that no one labelled: 1 if under a tenth of the words outside tags
    carry junk symbols, 0 if more, null for a page without words."""
    text = F.regexp_replace(html, r"(?s)<(?:script|style).*?</(?:script|style)>|<[^>]*+>|&[a-z]+;", " ")
    words, junk = F.regexp_count(text, F.lit(r"\S+")), F.regexp_count(text, F.lit(r"[#*$%|]+"))
    return F.when(words > 0, F.when(junk * 10 < words, 1).otherwise(0))
