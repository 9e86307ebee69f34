"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. Each level's
bad share is a beta-binomial posterior whose prior is the posterior mean of the level above: the corpus for
suffixes, the suffix for domains, the domain for hosts. A prior weighs as many pseudo-outcomes as its level
shows by the method of moments (between PRIOR_MIN and PRIOR_MAX). A page is blocked if the lower bound of its host's
posterior bad share exceeds `max_bad`; hosts without labels inherit their domain's or suffix's posterior. Explicit rules
come first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Fixed rules of the registered query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

# Second-level labels that act as part of a public suffix, as in co.uk.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]

PRIOR_MIN, PRIOR_MAX = 2.0, 200.0
MAX_BAD = 0.5
Z = 1.645


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = (F.size(labels) >= 3) & F.element_at(labels, -2).isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(two, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The label in front of the public suffix, and the suffix; the host itself if it is no longer than that."""
    extra = F.size(F.split(suffix_of(host), r"\.")) + 1
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) <= extra, host).otherwise(F.array_join(F.slice(labels, -extra, extra), "."))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null. Length is of host and path together."""
    found = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(table: DataFrame, prior: str, suffix: str) -> DataFrame:
    """One row: pseudo-outcomes a prior of this level weighs, from the spread of shares around their priors."""
    n, bad, p = F.col("n"), F.col("bad"), F.col(prior)
    spread = F.sum(n * F.pow(bad / n - p, F.lit(2.0))) / F.sum(n)
    chance = F.sum(p * (F.lit(1.0) - p)) / F.sum(n)
    full = F.sum(n * p * (F.lit(1.0) - p)) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-9))
    made = F.least(F.greatest(full / between - F.lit(1.0), F.lit(PRIOR_MIN)), F.lit(PRIOR_MAX))
    return table.where((n > 0) & (p > 0) & (p < 1)).agg(F.coalesce(made, F.lit(PRIOR_MIN)).alias(f"weight_{suffix}"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, domain, suffix, n, bad, mean, lower from rows (host, bad 0/1 or null).

    Rows whose `bad` is null count the host as seen but unlabelled. Counts are folded before the exchange,
    so a host with a third of all rows is one row per task. An empty table gives an empty table.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    # each level is read several times below; written once, the plans above it stay small
    hosts = materialise(hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"))), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    corpus = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + F.lit(1.0)) / (F.coalesce(F.sum("n"), F.lit(0.0)) + F.lit(2.0))).alias("p_corpus"))

    def posterior(table: DataFrame, prior: str, level: str) -> DataFrame:
        # the one-row table of strengths is an aggregate without keys: its size is bounded
        rows = table.join(F.broadcast(_strength(table, prior, level)))
        weight = F.col(f"weight_{level}")
        alpha = F.col(prior) * weight + F.col("bad")
        total = weight + F.col("n")
        return rows.withColumn(f"p_{level}", alpha / total).withColumn(f"total_{level}", total)

    suffix_rows = posterior(suffixes.join(F.broadcast(corpus)), "p_corpus", "suffix").select("suffix", "p_suffix")
    suffix_rows = materialise(suffix_rows, "suffix-posterior")
    domain_rows = posterior(domains.join(suffix_rows, "suffix"), "p_suffix", "domain").select("domain", "p_domain")
    domain_rows = materialise(domain_rows, "domain-posterior")
    rows = posterior(hosts.join(domain_rows, "domain"), "p_domain", "host")
    deviation = F.sqrt(F.col("p_host") * (F.lit(1.0) - F.col("p_host")) / (F.col("total_host") + F.lit(1.0)))
    return rows.select("host", "domain", "suffix", "n", "bad", F.col("p_host").alias("mean"), F.greatest(F.lit(0.0), F.col("p_host") - F.lit(Z) * deviation).alias("lower"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`.

    `labels` has (id, bad): the outcome of some pages; several outcomes of one page count as its mean rounded
    down, null outcomes as none. Null urls and urls without :// have empty host and path, are judged as
    host "", and keep their row. Repeated rows are kept. Other columns are ignored. Urls of any length are read
    whole; an empty `pages` gives no rows; without outcomes every prior is even and nothing beyond the rules is blocked.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.groupBy(F.col("id").alias("__id")).agg(F.floor(F.avg("bad")).alias("bad"))
    reputation = host_reputation(rows.join(known, F.col("page_id") == F.col("__id"), "left").select("host", "bad"))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("lower") > F.lit(max_bad), F.lit("block")).otherwise(F.lit("allow")))
    return (
        rows.join(reputation.select(F.col("host").alias("__host"), "lower"), F.col("host") == F.col("__host"), "left")
        .withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
    )


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u),
r AS (SELECT *, CASE
   WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
   WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
o AS (SELECT host, floor(l.bad) AS bad FROM p LEFT JOIN (SELECT doc_id, avg(1 - quality) AS bad FROM labels GROUP BY 1) l ON l.doc_id = p.page_id),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, string_split(host, '.') AS parts FROM o GROUP BY host),
h1s AS (SELECT *, CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS wide FROM h0),
h AS (SELECT host, n, bad, array_to_string(parts[-wide:], '.') AS suffix, CASE WHEN len(parts) <= wide + 1 THEN host ELSE array_to_string(parts[-wide - 1:], '.') END AS domain FROM h1s),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
s1 AS (SELECT *, (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) FROM s) AS p0 FROM s),
s2 AS (SELECT suffix, (p0 * w + bad) / (w + n) AS p FROM s1, (SELECT coalesce(least(greatest(sum(n * p0 * (1 - p0)) / sum(n) / greatest(sum(n * pow(bad / n - p0, 2)) / sum(n) - sum(p0 * (1 - p0)) / sum(n), 1e-9::DOUBLE) - 1, 2), 200), 2) AS w FROM s1 WHERE n > 0 AND p0 > 0 AND p0 < 1)),
d1 AS (SELECT d.*, s2.p AS p0 FROM d JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (p0 * w + bad) / (w + n) AS p FROM d1, (SELECT coalesce(least(greatest(sum(n * p0 * (1 - p0)) / sum(n) / greatest(sum(n * pow(bad / n - p0, 2)) / sum(n) - sum(p0 * (1 - p0)) / sum(n), 1e-9::DOUBLE) - 1, 2), 200), 2) AS w FROM d1 WHERE n > 0 AND p0 > 0 AND p0 < 1)),
h1 AS (SELECT h.*, d2.p AS p0 FROM h JOIN d2 USING (domain)),
h2 AS (SELECT host, (p0 * w + bad) / (w + n) AS p, w + n AS total FROM h1, (SELECT coalesce(least(greatest(sum(n * p0 * (1 - p0)) / sum(n) / greatest(sum(n * pow(bad / n - p0, 2)) / sum(n) - sum(p0 * (1 - p0)) / sum(n), 1e-9::DOUBLE) - 1, 2), 200), 2) AS w FROM h1 WHERE n > 0 AND p0 > 0 AND p0 < 1))
SELECT page_id, r.host, path, rule, CASE WHEN rule LIKE 'net/%' OR rule = 'example.com/en/' THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
   WHEN greatest(0, p - 1.645::DOUBLE * sqrt(p * (1 - p) / (total + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN h2 USING (host)
"""


def op7_url_filter(spark, sf_dir):
    """The outcome of page i is document i's quality label, the one labelled table there is: bad if quality is 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (F.lit(1) - F.col("quality")).alias("bad"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
