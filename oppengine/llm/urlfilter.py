"""URL filtering by rules and empirical-Bayes host reputation (operator 5).

Where no rule decides, a host is judged by the labelled outcomes of its pages (bad: quality 0 or toxic 1). Bad rates
shrink through beta-binomial priors: the corpus rate is the prior of a public suffix, the suffix of its registered
domains, the domain of its hosts. The strength of each prior comes from the spread between groups (method of
moments). A host is blocked if the lower bound of its posterior bad rate exceeds ``BLOCK_RATE``.

All of it is DataFrame expressions and aggregations; only the moments (three rows) reach the driver.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is judged as the
host '' like any other; repeated rows give repeated results; labels that repeat an id are bad if any of them is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage

#: The rules (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Public suffixes of two labels that are told apart from registered domains.
TWO_PART = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
BLOCK_RATE, BOUND_Z = 0.5, 1.645
STRENGTH_LEAST, STRENGTH_MOST = 1.0, 10_000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        ok = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*TWO_PART), two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(two.isin(*TWO_PART), F.substring_index(bare, ".", -3)).otherwise(two)
    return suffix, domain


def strength(groups: DataFrame) -> float:
    """Prior strength k = (1 - rho) / rho of beta-binomial groups (n, bad), rho by the method of moments."""
    t = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("x"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("xx")).first()
    if not t["n"] or not 0 < t["x"] < t["n"]:
        return STRENGTH_MOST
    p = t["x"] / t["n"]
    s = t["xx"] - t["x"] * p  # sum of n (p_i - p)^2
    more = t["n"] - t["nn"] / t["n"] - (t["g"] - 1)
    rho = (s / (p * (1 - p)) - (t["g"] - 1)) / more if more > 0 else 0.0
    return STRENGTH_MOST if rho <= 0 else min(max((1 - rho) / rho, STRENGTH_LEAST), STRENGTH_MOST)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, low) from rows (host, n, bad) that may repeat hosts; n and bad are sums of labels."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = stage(hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    kh, kd, ks = strength(hosts), strength(domains), strength(suffixes)
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] is not None else 0.5
    shrunk = lambda k, prior: (F.lit(k) * prior + F.col("bad")) / (F.lit(k) + F.col("n"))
    s = suffixes.select("suffix", shrunk(ks, F.lit(rate)).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(kd, F.col("suffix_mean")).alias("domain_mean"))
    h = hosts.join(d, ["suffix", "domain"]).select("host", "n", "bad", shrunk(kh, F.col("domain_mean")).alias("mean"))
    low = F.col("mean") - BOUND_Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(kh) + F.col("n") + 1))
    return h.select("host", "n", "bad", "mean", low.alias("low"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's reputation (host_mean, host_low) for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", pages["url"].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    per_host = p.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    labelled = p.join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    reputation = stage(host_reputation(per_host.unionByName(labelled)), "reputation")
    fit = match_rules(F.col("host"), F.col("path"), rules)
    judged = p.withColumn("_fit", fit).join(reputation.select("host", "mean", "low"), "host", "left")
    own = F.when(F.col("low") > block_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), own).alias("verdict"), F.col("mean").alias("host_mean"), F.col("low").alias("host_low"))


def op5_urlfilter(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return out.withColumns({c: F.round(c, 6) for c in ("host_mean", "host_low")})


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts AS (
  SELECT host, count(k.page_id) AS n, coalesce(sum(k.bad), 0) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
  FROM p LEFT JOIN known k USING (page_id) GROUP BY host),
h AS (
  SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad,
         CASE WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk')
              THEN array_to_string(string_split(bare, '.')[-2:], '.') ELSE string_split(bare, '.')[-1] END AS suffix,
         CASE WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ('ac.uk','co.jp','co.nz','co.uk','com.au','com.br','gov.uk','org.uk')
              THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain
  FROM hosts),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
groups AS (SELECT 'h' AS lvl, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
t AS (SELECT lvl, sum(n) AS n, sum(bad) AS x, count(*) AS g, sum(n * n) AS nn, sum(bad * bad / n) AS xx FROM groups WHERE n > 0 GROUP BY lvl),
r AS (
  SELECT lvl, CASE WHEN x <= 0 OR x >= n OR n - nn / n - (g - 1) <= 0 THEN 0.0
              ELSE ((xx - x * x / n) / (x / n * (1 - x / n)) - (g - 1)) / (n - nn / n - (g - 1)) END AS rho FROM t),
k AS (SELECT lvl, CASE WHEN rho <= 0 THEN 10000.0 ELSE least(greatest((1 - rho) / rho, 1.0), 10000.0) END AS k FROM r),
ks AS (SELECT coalesce(max(k) FILTER (WHERE lvl = 's'), 10000.0) AS s, coalesce(max(k) FILTER (WHERE lvl = 'd'), 10000.0) AS d,
              coalesce(max(k) FILTER (WHERE lvl = 'h'), 10000.0) AS h FROM k),
rate AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS rate FROM s),
sm AS (SELECT suffix, (ks.s * rate + bad) / (ks.s + n) AS m FROM s, ks, rate),
dm AS (SELECT d.suffix, d.domain, (ks.d * sm.m + d.bad) / (ks.d + d.n) AS m FROM d JOIN sm USING (suffix), ks),
hm AS (SELECT host, (ks.h * dm.m + h.bad) / (ks.h + h.n) AS m, ks.h + h.n + 1 AS size FROM h JOIN dm USING (suffix, domain), ks),
rules(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / size) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(m, 6) AS host_mean, round(m - 1.645 * sqrt(m * (1 - m) / size), 6) AS host_low
FROM p LEFT JOIN fit USING (page_id) JOIN hm ON p.host = hm.host
"""
