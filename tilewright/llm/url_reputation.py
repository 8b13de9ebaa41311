"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Only DataFrame functions run here. Outcomes (a host, bad 0 or 1) are counted by host; a host's bad rate is
shrunk to its registered domain's, that to its suffix's, that to the overall rate. Each level's prior is a
beta distribution around the parent's posterior mean whose strength is fitted by moments to that level's own
spread. A page goes when the lower posterior bound of its host's bad rate exceeds a limit; the bound is the posterior's mean less
`z` standard deviations, not a quantile of the beta distribution, for which Spark has no function.

Null urls, and those without "://", have empty host and path, fit no rule and get the verdict of the empty
host. Repeated rows are judged and counted one by one. Rules of one length are ties: the greater text wins. Empty tables give empty results; without outcomes the
bad rate is one half with little certainty, so pages stay. Columns host, path, rule, verdict and reputation of the input are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of two labels; `judge` takes the full public list where it matters.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.nz", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "co.za")
MOST_RULES = 500


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; both null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules fit into one expression")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last one set wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address is its own domain, without a suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = name.rlike(r"^([0-9.]+|\[.*\])$")
    wide = F.substring_index(name, ".", -2).isin(list(suffixes))
    domain = F.when(wide, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(wide, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return F.when(address, name).otherwise(domain), F.when(address, "").otherwise(suffix)


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments, from columns n, x and the parent's mean m: one row comes to the driver."""
    noise = F.col("n") * F.col("m") * (1 - F.col("m"))
    over, scale = groups.agg(F.sum((F.col("x") - F.col("n") * F.col("m")) ** 2 - noise), F.sum(noise * (F.col("n") - 1))).first()
    rho = min(0.99, max(0.01, over / scale)) if scale else 0.5
    return (1 - rho) / rho


def reputations(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES, z: float = 1.64) -> DataFrame:
    """From `hosts` (host, n outcomes, x bad ones; one row a host) to host, rate (posterior mean), bound (lower)."""
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = checkpointed(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x"))
    domains = checkpointed(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n, x = ends.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("x"), F.lit(0))).first()
    ends = ends.withColumn("m", F.lit((x + 1) / (n + 2)))
    k = _strength(ends)
    mean = lambda k: (k * F.col("m") + F.col("x")) / (k + F.col("n"))
    domains = domains.join(ends.select("suffix", mean(k).alias("m")), "suffix")
    k = _strength(domains)
    hosts = hosts.join(domains.select("domain", "suffix", mean(k).alias("m")), ["domain", "suffix"])
    k = _strength(hosts)
    a, b = k * F.col("m") + F.col("x"), k * (1 - F.col("m")) + F.col("n") - F.col("x")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", (a / (a + b)).alias("rate"), (a / (a + b) - z * spread).alias("bound"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, outcome: Column | None = None, limit: float = 0.5, z: float = 1.64, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Add host, path, rule, verdict and reputation to pages.

    `outcome`, an expression of the columns of pages, says whether a page is known bad (1), known good (0) or not labelled (null); by default the pages
    that a rule decides are the labelled ones.
    """
    host, path, rule, verdict, known, of, rate, bound = fresh(pages, "host", "path", "rule", "verdict", "known", "of", "rate", "bound")
    parts = url_parts(F.col(url))
    rows = pages.withColumns({host: parts[0], path: parts[1]} | ({known: outcome} if outcome is not None else {}))
    found = fitting_rule(F.col(host), F.col(path), rules)
    rows = rows.withColumns({rule: found[0], verdict: found[1]})
    if outcome is None:
        rows = rows.withColumn(known, F.when(F.col(verdict) == "block", 1).when(F.col(verdict) == "allow", 0))
    hosts = rows.select(F.col(host).alias("host"), F.col(known).alias("k")).groupBy("host").agg(F.count("k").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("x"))
    rates = reputations(hosts, suffixes, z).select(F.col("host").alias(of), F.col("rate").alias(rate), F.col("bound").alias(bound))
    out = rows.join(rates, F.col(host) == F.col(of), "left")
    decided = F.coalesce(F.col(verdict), F.when(F.col(bound) > limit, "block").otherwise("allow"))
    new = {"host": F.col(host), "path": F.col(path), "rule": F.col(rule), "verdict": decided, "reputation": F.round(rate, 6)}
    return out.select(*[F.col(plain(c)) for c in pages.columns if c.lower() not in new], *[v.alias(k) for k, v in new.items()])


def query(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "reputation")


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order) + " END"
    wide = "list_contains([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "], array_to_string(l[-2:], '.'))"
    level = lambda t: f"SELECT CASE WHEN r IS NULL THEN 1.0 ELSE (1 - r) / r END k FROM (SELECT least(0.99, greatest(0.01, sum((x - n * m) * (x - n * m) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0))) r FROM {t})"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM rest),
ruled AS (SELECT page_id, host, path, {rule} rule, {verdict} v FROM parts),
counted AS (SELECT host, count(v) n, coalesce(sum((v = 'block')::int), 0)::bigint x FROM ruled GROUP BY host),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') name FROM counted),
labels_of AS (SELECT *, string_split(name, '.') l, regexp_matches(name, '^([0-9.]+|\\[.*\\])$') address FROM named),
hosts0 AS (SELECT host, n, x, CASE WHEN address THEN name WHEN {wide} THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain_name,
  CASE WHEN address THEN '' WHEN {wide} THEN array_to_string(l[-2:], '.') ELSE l[-1] END suffix FROM labels_of),
domains0 AS (SELECT domain_name, suffix, sum(n)::bigint n, sum(x)::bigint x FROM hosts0 GROUP BY ALL),
ends0 AS (SELECT suffix, sum(n)::bigint n, sum(x)::bigint x FROM domains0 GROUP BY ALL),
ends AS (SELECT *, (SELECT (coalesce(sum(x), 0) + 1)::double / (coalesce(sum(n), 0) + 2) FROM ends0) m FROM ends0),
k1 AS ({level("ends")}),
domains AS (SELECT d.*, (k * m + e.x) / (k + e.n) m FROM domains0 d JOIN ends e USING (suffix), k1),
k2 AS ({level("domains")}),
hosts AS (SELECT h.*, (k * m + d.x) / (k + d.n) m FROM hosts0 h JOIN domains d USING (domain_name, suffix), k2),
k3 AS ({level("hosts")}),
ab AS (SELECT host, k * m + x a, k * (1 - m) + n - x b FROM hosts, k3),
rated AS (SELECT host, a / (a + b) rate, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) low FROM ab)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) verdict, round(rate, 6) reputation
FROM ruled JOIN rated USING (host)"""


SQL = _sql()
