"""URL filter by empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (good or bad) are counted per host.  Reputation is shrunk through
beta-binomial priors along suffix -> registered domain -> host: the posterior mean of the parent is
the prior mean of the child, and the prior's strength at each level comes from how far the children
of that level scatter around their parents beyond binomial noise (method of moments).  A host is
blocked when the lower bound of the posterior of its bad rate exceeds ``MAX_BAD``.  List rules come
first: the longest rule that fits decides.

One aggregation of pages by host (partial sums first: a hot host is one row per task); everything
after that works on one row per host.  Pages then meet the table of hosts, which is broadcast only
when its row count has been checked.

The registered domain is the last label of the host and one more, below the suffixes of several labels
in ``SUFFIXES`` one more than that; an IP address is a domain of its own below the suffix ``ip``.

The tables have no outcomes of pages, so a label of the table ``labels`` counts for the page whose
page_id equals its doc_id.

Defined cases: a null url or one without ``://`` has an empty host and path; pages without labels
count in no outcome and get their host's verdict; several labels of one page are one outcome (bad if
any says so); null labels say nothing; without any labels every prior is even and nothing is
blocked by the method; rows that repeat a page are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, bounded_broadcast, materialise

#: Verdict and rule; a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Public suffixes of two labels.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn",
    "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn",
    "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
_IP = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"
#: A host is blocked if its bad rate lies above MAX_BAD with the lower bound of Z standard deviations.
MAX_BAD, Z = 0.5, 1.645
#: Bounds of the correlation of outcomes below one parent: prior strength is 1 / rho - 1.
RHO_LEAST, RHO_MOST = 1e-4, 0.5


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _rho(q: Column, v: Column, nv: Column) -> Column:
    """Correlation by moments from sums over children: n (p - mu)^2, mu (1 - mu), (n - 1) mu (1 - mu)."""
    return F.least(F.lit(RHO_MOST), F.greatest(F.lit(RHO_LEAST), F.coalesce((q - v) / F.nullif(nv, F.lit(0.0)), F.lit(RHO_LEAST))))


def _shrink(children: DataFrame, by: str, mean: str) -> DataFrame:
    """Adds strength (over all children), and the posterior mean and bound of each child's bad rate.
    The sums go over one row per child, in the order of ``by``, so that reruns agree."""
    mu, n = F.col(mean), F.col("n")
    p = F.col("bad") / F.nullif(n, F.lit(0))
    spread = mu * (1 - mu)
    parts = children.where("n > 0").select(F.round(n * (p - mu) * (p - mu), 9).cast("decimal(38,9)").alias("q"), F.round(spread, 9).cast("decimal(38,9)").alias("v"), F.round((n - 1) * spread, 9).cast("decimal(38,9)").alias("nv"))
    rho = parts.agg(_rho(F.sum("q").cast("double"), F.sum("v").cast("double"), F.sum("nv").cast("double")).alias("rho"))
    both = children.crossJoin(F.broadcast(rho))  # one row
    strength = 1 / F.col("rho") - 1
    a, b = mu * strength + F.col("bad"), (1 - mu) * strength + (n - F.col("bad"))
    post, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return both.select(*children.columns, post.alias(f"{by}_mean"), (post - Z * sd).alias(f"{by}_bound"))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, host_mean, host_bound) of all hosts; pages has page_id and host, outcomes has
    page_id and bad (0 or 1), a row for each labelled page."""
    counted = pages.join(bounded_broadcast(outcomes), "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    address, two = name.rlike(_IP), F.substring_index(name, ".", -2)
    long = two.isin(*SUFFIXES)
    suffix = F.when(address, "ip").when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    hosts = materialise(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"))
    total = hosts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("all_mean"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))  # one row
    suffixes = materialise(_shrink(suffixes, "suffix", "all_mean")).select("suffix", "suffix_mean")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = materialise(_shrink(domains, "domain", "suffix_mean")).select("suffix", "domain", "domain_mean")
    return materialise(_shrink(hosts.join(domains, ["suffix", "domain"]), "host", "domain_mean"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """All columns of pages in a struct ``row``, and host, path, rule, verdict, bad_bound."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = materialise(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad")))
    split = pages.select(F.struct("*").alias("row"), F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = host_reputation(split.select("page_id", "host"), outcomes)
    met = split.join(bounded_broadcast(known.select("host", "host_bound")), "host")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("host_bound") > max_bad, "block").otherwise("allow"))
    return met.select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("host_bound").alias("bad_bound"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge_pages(pages.select("page_id", "url"), labels.select("doc_id", "quality", "toxic"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def _sql_shrink(name: str, of: str, keys: str, by: str, mean: str) -> str:
    return f"""
{name}_r AS (SELECT least({RHO_MOST}, greatest({RHO_LEAST}, coalesce((sum(q)::DOUBLE - sum(v)::DOUBLE) / nullif(sum(nv)::DOUBLE, 0), {RHO_LEAST})))::DOUBLE AS rho FROM (
  SELECT round(n * (bad / n - {mean}) * (bad / n - {mean}), 9)::DECIMAL(38,9) AS q, round({mean} * (1 - {mean}), 9)::DECIMAL(38,9) AS v,
         round((n - 1) * ({mean} * (1 - {mean})), 9)::DECIMAL(38,9) AS nv FROM {of} WHERE n > 0)),
{name}_a AS (SELECT {keys}, {mean} * (1 / rho - 1) + bad AS a, (1 - {mean}) * (1 / rho - 1) + (n - bad) AS b FROM {of}, {name}_r),
{name} AS (SELECT {keys}, a / (a + b) AS {by}_mean, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS {by}_bound FROM {name}_a)"""


_FITS = [(text, said, f"(host = '{text[: text.index('/')]}' OR ends_with(host, '.{text[: text.index('/')]}')) AND starts_with(path, '{text[text.index('/') :]}')") for said, text in sorted(RULES, key=lambda r: -len(r[1]))]
SQL = rf"""
WITH o AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END)::BIGINT AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM u LEFT JOIN o USING (page_id) GROUP BY host),
kn AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name FROM h),
k AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '{_IP}') AS ip, array_to_string(string_split(name, '.')[-2:], '.') IN {SUFFIXES} AS long FROM kn),
g AS (SELECT host, n, bad, CASE WHEN ip THEN 'ip' WHEN long THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix,
             CASE WHEN ip THEN name WHEN long THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM k),
g0 AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) AS all_mean FROM g),
g1 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(all_mean) AS all_mean FROM g, g0 GROUP BY suffix),{_sql_shrink("s", "g1", "suffix", "suffix", "all_mean")},
g2 AS (SELECT g.suffix, g.domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(suffix_mean) AS suffix_mean FROM g JOIN s USING (suffix) GROUP BY g.suffix, g.domain),{_sql_shrink("dm", "g2", "suffix, domain", "domain", "suffix_mean")},
g3 AS (SELECT g.host, g.n, g.bad, dm.domain_mean FROM g JOIN dm USING (suffix, domain)),{_sql_shrink("hm", "g3", "host", "host", "domain_mean")}
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits} THEN '{text}'" for text, _, fits in _FITS)} END AS rule,
       CASE {" ".join(f"WHEN {fits} THEN '{said}'" for _, said, fits in _FITS)} WHEN host_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM u JOIN hm USING (host)
"""
