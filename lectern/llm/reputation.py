"""URL filters by empirical-Bayes host reputation, with SQL only.

Labelled pages (the label of the document whose number is in the path) give each host a count of pages
and of bad pages (quality 0 or toxic 1). Each level shrinks towards the one above: suffix to the whole, registered domain to its
suffix, host to its domain. A level's prior is a beta distribution around the parent's posterior mean; its strength
comes from the level's own over-dispersion by the method of moments. A host is blocked if the lower bound
of its posterior bad rate (mean - z * sd) is over the threshold; hosts without labels inherit their domain's posterior.
Explicit rules come first: the longest rule whose host is the url's host or a parent of it and whose path begins the url's path.

All counts are partial sums by key, so a host with a third of the pages is one row after the map side; the host table joins the pages
by a plain equi-join, which is broadcast only if Spark measures it as small and whose hot keys adaptive execution splits.
Defined results: a null url or one without '://' has an empty host and path, which is a host like any other; repeated pages each get a row;
several labels of one document count as bad if one of them is; null labels count as good; no labels at all: everything the rules don't name is allowed;
extra columns are ignored; very long urls are read whole; an empty table of pages gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import lowered, prepared, table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Block if the bad rate is over THRESHOLD with about 95 % posterior probability (Z standard deviations).
THRESHOLD, Z = 0.35, 1.645
#: Second labels under which names are registered in the countries of COUNTRIES (all pairs of the two), and other suffixes of more than one label.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "gv", "ltd", "mil", "net", "nom", "or", "org", "plc", "sch")
COUNTRIES = ("ae", "ar", "at", "au", "br", "cn", "co", "cr", "eg", "es", "gr", "hk", "id", "il", "in", "jp", "ke", "kr", "lk", "mx", "my", "ng", "nz", "pe", "ph", "pk", "pl", "pt", "sa", "sg", "th", "tr", "tw", "ua", "uk", "uy", "ve", "vn", "za")
LONG_SUFFIXES = tuple(f"{s}.{c}" for c in COUNTRIES for s in SECOND) + ("go.jp", "ne.jp", "go.kr", "re.kr", "go.id", "go.th", "nhs.uk", "police.uk", "me.uk", "asso.fr", "gouv.fr", "github.io", "blogspot.com")
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def parts(pages: DataFrame, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """Adds host, path, domain (registered) and suffix; an address of numbers is its own domain, under the suffix ''."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = lowered(F.regexp_extract(rest, r"^[^/?#]*", 0))
    out = pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    name = F.regexp_replace(F.col("host"), r":\d*$", "")
    tail = F.regexp_extract(name, r"(?:^|\.)([^.]*\.[^.]*)$", 1)  # the last two labels
    suffix = F.when(tail.isin(*long_suffixes), tail).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    before = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    domain = F.concat(F.regexp_extract(before, r"([^.]*\.)?$", 0), suffix)
    number = name.rlike(ADDRESS)
    return out.withColumn("domain", F.when(number, name).otherwise(domain)).withColumn("suffix", F.when(number, "").otherwise(suffix))


def matched(rules: tuple[tuple[str, str, str], ...]) -> tuple:
    """Columns rule and its verdict (both null without a match) of rows with host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def shrunk(rows: DataFrame) -> DataFrame:
    """Posterior a, b and mean of each key of a level (n, k, m) towards its parent's mean m."""
    fit = rows.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("spread"),
        (F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")).alias("v"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"),
    )
    over = (F.col("spread") / F.col("v") - F.col("groups")) / F.nullif(F.col("total") - F.col("groups"), F.lit(0))
    rho = F.least(F.greatest(F.coalesce(F.when(F.col("v") > 0, over), F.lit(0.001)), F.lit(0.001)), F.lit(0.9))
    strength = fit.select((1 / rho - 1).alias("s")).first()["s"]  # one number a level
    rows = rows.withColumn("s", F.lit(strength))
    rows = rows.withColumn("a", F.col("k") + F.col("s") * F.col("m")).withColumn("b", F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m")))
    return rows.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputations(pages: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """host, n_labelled, n_bad, mean, bound, blocked of each host of ``pages`` (with parts); ``outcomes`` has doc_id and bad (0 or 1)."""
    known = outcomes.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("bad").alias("bad"))
    seen = pages.select("host", "domain", "suffix", F.expr(r"try_cast(regexp_extract(path, '/(\\d+)', 1) AS bigint)").alias("doc_id"))
    seen = seen.join(known, "doc_id", "left")
    hosts = seen.groupBy("host", "domain", "suffix").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")).checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).checkpoint()
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1)).first()[0]  # one number
    by_suffix = shrunk(suffixes.withColumn("m", F.lit(whole)))
    by_domain = shrunk(domains.join(by_suffix.select("suffix", F.col("mean").alias("m")), "suffix")).checkpoint()
    by_host = shrunk(hosts.join(by_domain.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]))
    size = F.col("a") + F.col("b")
    bound = F.col("mean") - z * F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return by_host.select("host", F.col("n").cast("long").alias("n_labelled"), F.col("k").cast("long").alias("n_bad"), "mean", bound.alias("bound"), (bound > threshold).alias("blocked"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    prepared(pages.sparkSession)
    named = parts(pages.select("page_id", "url"))
    hosts = reputations(named, outcomes, threshold, z).select("host", "blocked")
    rule, verdict = matched(rules)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return named.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.select("doc_id", bad.cast("int").alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), label_outcomes(table(spark, sf_dir, "labels")))


ORACLE = (r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
d AS (
  SELECT *, CASE WHEN name IN (""" + ", ".join(f"'{x}'" for x in LONG_SUFFIXES) + r""") OR regexp_extract(name, '(?:^|\.)([^.]*\.[^.]*)$', 1) IN (""" + ", ".join(f"'{x}'" for x in LONG_SUFFIXES) + r""")
                 THEN regexp_extract(name, '(?:^|\.)([^.]*\.[^.]*)$', 1) WHEN regexp_matches(name, '""" + ADDRESS + r"""') THEN '' ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix
  FROM (SELECT *, regexp_replace(host, ':\d*$', '') AS name FROM h)),
e AS (
  SELECT *, CASE WHEN regexp_matches(name, '""" + ADDRESS + r"""') THEN name ELSE regexp_extract(left(name, length(name) - length(suffix)), '([^.]*\.)?$') || suffix END AS domain FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts AS (
  SELECT host, domain, suffix, count(bad)::double AS n, coalesce(sum(bad), 0)::double AS k
  FROM e LEFT JOIN l ON l.doc_id = try_cast(regexp_extract(path, '/(\d+)', 1) AS bigint) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s0 AS (SELECT *, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM suffixes) AS m FROM suffixes),
s1 AS (SELECT sum(n * pow(k / n - m, 2)) AS spread, sum(n * m * (1 - m)) / sum(n) AS v, sum(n) AS total, count(*) AS groups FROM s0 WHERE n > 0),
s2 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN v > 0 THEN (spread / v - groups) / nullif(total - groups, 0) END, 0.001), 0.001), 0.9) - 1 AS s FROM s1),
s3 AS (SELECT suffix, (k + s * m) / (n + s) AS mean FROM s0, s2),
d0 AS (SELECT domains.*, mean AS m FROM domains JOIN s3 USING (suffix)),
d1 AS (SELECT sum(n * pow(k / n - m, 2)) AS spread, sum(n * m * (1 - m)) / sum(n) AS v, sum(n) AS total, count(*) AS groups FROM d0 WHERE n > 0),
d2 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN v > 0 THEN (spread / v - groups) / nullif(total - groups, 0) END, 0.001), 0.001), 0.9) - 1 AS s FROM d1),
d3 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS mean FROM d0, d2),
h0 AS (SELECT hosts.*, mean AS m FROM hosts JOIN d3 USING (domain, suffix)),
h1 AS (SELECT sum(n * pow(k / n - m, 2)) AS spread, sum(n * m * (1 - m)) / sum(n) AS v, sum(n) AS total, count(*) AS groups FROM h0 WHERE n > 0),
h2 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN v > 0 THEN (spread / v - groups) / nullif(total - groups, 0) END, 0.001), 0.001), 0.9) - 1 AS s FROM h1),
h3 AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h0, h2),
h4 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.35 AS blocked FROM h3),
ruled AS (
  SELECT e.*, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                   WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                   WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                   WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM e)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN h4 USING (host)
""")
