"""URL filters: rules, and empirical-Bayes host reputation for the urls that no rule fits.

A labelled page is bad if it is toxic or of quality 0. The share of bad pages is shrunk level by level, from all pages
to the public suffix, the registered domain and the host: the posterior mean of one level is the mean of the
beta-binomial prior of the next, whose concentration comes from the spread of the shares at that level (moments).
A host is blocked if the lower bound of its posterior share of bad pages is above ``MAX_BAD``. The bound is the normal
one, from the posterior's mean and variance, as native functions and SQL have no beta quantile; at few labelled pages it
leans on the prior and is rough.

A public suffix is the last label, or two where the last is a country's and the one before is of ``SECOND_LEVEL``; another
rule can be given as a pattern.

A page's label is the row of ``labels`` whose doc_id is the page's id; several such rows count once, bad if any is.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as the empty host; hosts
without labelled pages get their domain's posterior; a label with nulls counts by what it has, with two nulls not at
all; repeated rows of pages count and are returned one by one; a null page_id has no label; empty tables give an
empty result or, for labels, allow all that no rule blocks; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import join_counted, materialize

#: The rules of the production query, as (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "id", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Its first group is a suffix of two labels.
TWO_LABELS = rf"(?:\A|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z])\z"
MAX_BAD = 0.3
Z = 1.645
EDGE = 1e-6


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as the text between the first ``://`` and the marks that end them."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column, two_labels: str = TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port; an IPv4 address is its own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r":[0-9]*\z", "")
    last2 = F.regexp_extract(bare, r"([^.]*\.[^.]*)\z", 1)
    two = F.regexp_like(bare, F.lit(two_labels))
    suffix = F.when(two, F.regexp_extract(bare, two_labels, 1)).otherwise(F.regexp_extract(bare, r"([^.]*)\z", 1))
    domain = F.when(two, F.regexp_extract(bare, r"([^.]*\.[^.]*\.[^.]*)\z", 1)).otherwise(last2)
    address = F.regexp_like(bare, F.lit(r"\A[0-9]+(\.[0-9]+){3}\z"))
    return F.when(address | (domain == ""), bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def concentration(groups: DataFrame) -> float:
    """Of the beta-binomial prior, by moments over groups with n pages, y bad ones and prior mean m."""
    m = clamp(F.col("m"), EDGE, 1 - EDGE)
    chi = F.col("n") * (F.col("y") / F.col("n") - m) * (F.col("y") / F.col("n") - m) / (m * (1 - m))
    x, g, free = groups.where("n > 0").agg(F.sum(chi), F.count("*"), F.sum(F.col("n") - 1)).first()
    rho = min(max((x - g) / free if free else 0.0, EDGE), 1 - EDGE)
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, z: float = Z, two_labels: str = TWO_LABELS) -> DataFrame:
    """hosts: host, n labelled pages, y bad ones, and others such as how many pages. Returns host, the others, mean and lower
    bound of the bad share."""
    others = [c for c in hosts.columns if c not in ("host", "n", "y")]
    domain, suffix = domain_of(F.col("host"), two_labels)
    hosts = hosts.select("host", *others, "n", "y", F.struct(suffix.alias("suffix"), domain.alias("domain")).alias("site"))
    sites = hosts.groupBy("site").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("hosts"))
    domains = sites.select("site.suffix", "site.domain", "n", "y", "hosts", "site")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    n, y = suffixes.agg(F.sum("n"), F.sum("y")).first()
    top = y / n if n else 0.0
    posterior = lambda k: (F.col("y") + k * F.col("m")) / (F.col("n") + k)
    suffixes = suffixes.withColumn("m", F.lit(top))
    suffixes = suffixes.select("suffix", posterior(concentration(suffixes)).alias("m"))
    domains = domains.join(suffixes, "suffix")
    domains = materialize(domains.select("site", "hosts", posterior(concentration(domains)).alias("m")), "domains")
    hosts = join_counted(hosts, domains, "site", "hosts", [F.col("host")])  # one domain may have very many hosts
    k = concentration(hosts)
    mean = posterior(k)
    bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return hosts.select("host", *others, "n", mean.alias("mean")).select("host", *others, "mean", bound.alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z, two_labels: str = TWO_LABELS) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_bound) for every row of pages."""
    host, path = split_url(F.col("url"))
    own = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))  # greatest skips nulls
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), bad.alias("bad")).where("bad IS NOT NULL").groupBy("label_id").agg(F.max("bad").alias("bad"))
    # Repeated ids and null ones meet as one row for each host.
    counted = own.groupBy("page_id", "host").agg(F.count("*").alias("c")).join(marks, F.col("page_id") == F.col("label_id"), "left")
    marked = F.when(F.col("bad").isNotNull(), F.col("c"))
    hosts = counted.groupBy("host").agg(F.sum("c").alias("pages"), F.coalesce(F.sum(marked), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("bad")), F.lit(0)).alias("y"))
    standing = materialize(host_reputation(materialize(hosts, "hosts"), z, two_labels), "standing")
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    judged = join_counted(own, standing, "host", "pages", [F.col("page_id"), F.col("path")])
    verdict = F.coalesce(F.col("says"), F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
    judged = judged.withColumns({"rule": rule, "says": says})
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mean", 9).alias("bad_mean"), F.round("bound", 9).alias("bad_bound"))


def rule_sql(rules=RULES) -> tuple[str, str]:
    """The rules as two CASE expressions of plain SQL over host and path."""
    whens = []
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        whens.append((f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')", text, says))
    case = lambda i, other: "CASE " + " ".join(f"{w[0]} THEN '{w[i]}'" for w in whens) + f" ELSE {other} END"
    return case(1, "NULL"), case(2, f"CASE WHEN bound > {MAX_BAD} THEN 'block' ELSE 'allow' END")


def _level(source: str, key: str) -> str:
    """SQL of one level's concentration over rows with n, y and m."""
    mm = f"least(greatest(m, {EDGE}), {1 - EDGE})"
    return f"""SELECT 1 / least(greatest(coalesce((sum(n * (y/n - {mm}) * (y/n - {mm}) / ({mm} * (1 - {mm}))) - count(*)) / nullif(sum(n - 1), 0), 0), {EDGE}), {1 - EDGE}) - 1 AS {key} FROM {source} WHERE n > 0"""


_rule, _verdict = rule_sql()
ORACLE_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
own AS (SELECT page_id, translate(regexp_extract(r, '\\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '\\A[^/?#]*([^?#]*)', 1) AS path FROM rest),
marks AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS y, regexp_replace(regexp_replace(host, '\\A.*@', ''), ':[0-9]*\\z', '') AS bare FROM own LEFT JOIN marks ON page_id = doc_id GROUP BY host),
parts AS (SELECT *, regexp_extract(bare, '([^.]*\\.[^.]*)\\z', 1) AS last2, regexp_matches(bare, '\\A[0-9]+(\\.[0-9]+){{3}}\\z') AS address, regexp_extract(bare, '{TWO_LABELS}', 1) AS two FROM counted),
named AS (SELECT host, n, y, bare, address, CASE WHEN two <> '' THEN regexp_extract(bare, '([^.]*\\.[^.]*\\.[^.]*)\\z', 1) ELSE last2 END AS d, CASE WHEN address THEN bare WHEN two <> '' THEN two ELSE regexp_extract(bare, '([^.]*)\\z', 1) END AS suffix FROM parts),
hosts AS (SELECT host, n, y, suffix, CASE WHEN address OR d = '' THEN bare ELSE d END AS domain FROM named),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(y) AS y FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(y) AS y, coalesce((SELECT sum(y) / nullif(sum(n), 0) FROM hosts), 0) AS m FROM domains GROUP BY suffix),
k1 AS ({_level('suffixes', 'k')}),
domains_m AS (SELECT d.suffix, d.domain, d.n, d.y, (s.y + k * s.m) / (s.n + k) AS m FROM domains d JOIN suffixes s USING (suffix) CROSS JOIN k1),
k2 AS ({_level('domains_m', 'k')}),
hosts_m AS (SELECT h.host, h.n, h.y, (d.y + k * d.m) / (d.n + k) AS m FROM hosts h JOIN domains_m d USING (suffix, domain) CROSS JOIN k2),
k3 AS ({_level('hosts_m', 'k')}),
means AS (SELECT host, n, k, (y + k * m) / (n + k) AS mean FROM hosts_m CROSS JOIN k3),
bounds AS (SELECT host, mean, mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) AS bound FROM means)
SELECT page_id, host, path, {_rule} AS rule, {_verdict} AS verdict, round(mean, 9) AS bad_mean, round(bound, 9) AS bad_bound FROM own JOIN bounds USING (host)
"""
