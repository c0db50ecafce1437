"""URL filters: explicit rules first, then an empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted by host, registered domain and
suffix.  From the top down each level's rate is shrunk to its parent's through a
beta-binomial prior: a host's posterior is Beta(s*m + good, s*(1-m) + bad), where
m is the posterior mean of its domain and s the prior strength of hosts within
domains, estimated from all hosts by the method of moments (one-way analysis of
variance); likewise domains within suffixes and suffixes within the whole.  A
url is blocked if the upper posterior bound of its host's rate is below the
threshold, else allowed.

Defined results: a null url or one without "://" has empty host and path; hosts
without labelled pages get their parents' posterior mean; without any labels the
rate is one half and nothing is blocked; repeated rows are judged alike and
counted each; labels of a document that many pages show count for each of them; an empty table gives no rows; columns of ``pages`` named host, path,
rule or verdict are replaced, all others are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least good rate that a host must be able to have.
THRESHOLD = 0.5
#: Posterior standard deviations from the mean to the bound (about 95 % one-sided).
BOUND_Z = 1.645
#: Range of the estimated prior strengths, in labelled pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Blocked hosts, or domains or suffixes, that are broadcast at most; with more, the
#: join is shuffled.
BROADCAST_HOSTS = 100_000
#: Suffixes of two labels, under which domains are registered (fixed values); every
#: function takes another list, as the public one of suffixes is.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` urls of a host and its subdomains whose path
    begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits (of equal
    ones a blocking one), else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        made = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row with ``s``, from rows of ``good`` and ``n`` of each child: between
    and within mean squares give the intraclass correlation 1 / (1 + s)."""
    own = children.where("n > 0")
    parents = own.groupBy(parent).agg((F.sum("good") / F.sum("n")).alias("rate"), F.sum("n").alias("rows"), F.count("*").alias("kids"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    each = own.join(parents, parent)
    p = F.col("good") / F.col("n")
    sums = each.agg(
        F.sum(F.col("n") * (p - F.col("rate")) * (p - F.col("rate"))).alias("between"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"),
        F.sum("n").alias("rows"),
        F.count("*").alias("kids"),
    ).crossJoin(parents.agg(F.count("*").alias("parents"), F.sum(F.col("squares") / F.col("rows")).alias("share")))  # one row each
    free = F.col("kids") - F.col("parents")
    msb, msw = F.try_divide("between", free), F.try_divide("within", F.col("rows") - F.col("kids"))
    size = F.try_divide(F.col("rows") - F.col("share"), free)
    spread = msb + (size - 1) * msw
    correlation = F.when((msb > msw) & (spread > 0), F.try_divide(msb - msw, spread))
    strength = F.coalesce(F.try_divide(F.lit(1.0), correlation) - 1, F.lit(MOST_STRENGTH))
    return sums.select(F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("s"))


def _shrunk(children: DataFrame, parent: str, means: DataFrame) -> DataFrame:
    """``a`` and ``b`` of each child's posterior, given the parents' ``mean``.  Most
    children may have one parent, so that few parents go to the children."""
    means = common.written(means, "means")
    means = F.broadcast(means) if means.count() <= BROADCAST_HOSTS else means
    return children.join(means, parent).crossJoin(_strength(children, parent)).withColumns({"a": F.col("s") * F.col("mean") + F.col("good"), "b": F.col("s") * (1 - F.col("mean")) + F.col("n") - F.col("good")}).drop("mean", "s")


def reputation(outcomes: DataFrame, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``outcomes``: host, good (0, 1, or null where not labelled) and, if it is there,
    ``pages``, how many pages the row stands for (else one).  Returns a row for each
    host: good, n, a, b, ``mean`` and ``upper``."""
    pages = F.col("pages") if "pages" in outcomes.columns else F.lit(1)
    count = (F.coalesce(F.sum(F.col("good") * pages), F.lit(0)).cast("double").alias("good"), F.coalesce(F.sum(F.when(F.col("good").isNotNull(), pages)), F.lit(0)).cast("double").alias("n"))
    hosts = outcomes.groupBy("host").agg(*count).withColumns({"domain": domain_of(F.col("host"), two_label), "suffix": suffix_of(F.col("host"), two_label), "whole": F.lit(0)})
    hosts = common.written(hosts, "hosts")
    again = (F.sum("good").alias("good"), F.sum("n").alias("n"))
    domains = hosts.groupBy("domain", "suffix", "whole").agg(*again)
    suffixes = domains.groupBy("suffix", "whole").agg(*again)
    whole = suffixes.groupBy("whole").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
    by_suffix = _shrunk(suffixes, "whole", whole)
    by_domain = _shrunk(domains, "suffix", by_suffix.select("suffix", mean))
    by_host = _shrunk(hosts, "domain", by_domain.select("domain", mean))
    total = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.select("host", "good", "n", "a", "b", mean, F.least(F.lit(1.0), F.col("a") / total + BOUND_Z * spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    bad = common.persist_cut(reputation(outcomes, two_label).where(F.col("upper") < threshold).select(F.col("host").alias("__host"), F.lit(True).alias("__bad")))
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    own = pages.withColumns({"__host": host_of(F.col("url")), "__path": path_of(F.col("url"))})
    fit = own.withColumn("__fit", rule_for(F.col("__host"), F.col("__path"), rules)).join(bad, "__host", "left")
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow")))
    return fit.withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__fit.rule"), "verdict": verdict}).drop("__fit", "__bad", "__host", "__path")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host``, ``good`` and ``pages``.  The last part of a path names the document
    that the page shows; its labels are the page's outcome.  Pages of one host and
    document are counted before they meet the labels, so the join's keys are as rare
    as documents on hosts; pages that name no document, on the web nearly all, meet
    nothing and leave one unlabelled row for their host."""
    page = pages.select(host_of(F.col("url")).alias("host"), F.expr("try_cast(regexp_extract(url, '^.*?://[^/?#]*[^?#]*?/([0-9]{1,18})(?:[.]html|/)?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    shown = page.where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    hosts = page.select("host").distinct().select("host", F.lit(None).cast("int").alias("good"), F.lit(1).cast("long").alias("pages"))
    return shown.join(known, "doc_id").select("host", "good", "pages").unionByName(hosts)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    made = judge(pages, page_outcomes(pages, common.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))
    return made.select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, child: str, parent: str, means: str) -> str:
    return f"""
{name}_p as (select {parent}, sum(good) / sum(n) as rate, sum(n) as parent_rows, count(*) as kids, sum(n * n) as squares from {child} where n > 0 group by {parent}),
{name}_e as (select coalesce(sum(n * (good / n - rate) * (good / n - rate)), 0) as b2, coalesce(sum(n * (good / n) * (1 - good / n)), 0) as w2, coalesce(sum(n), 0) as r, count(*) as k from {child} join {name}_p using ({parent}) where n > 0),
{name}_c as (select count(*) as p, coalesce(sum(squares / parent_rows), 0) as share from {name}_p),
{name}_m as (select b2 / nullif(k - p, 0) as msb, w2 / nullif(r - k, 0) as msw, (r - share) / nullif(k - p, 0) as z, (k > p and r > k) as known from {name}_e, {name}_c),
{name}_i as (select case when known and msb + (z - 1) * msw > 0 and msb > msw then (msb - msw) / (msb + (z - 1) * msw) end as rho from {name}_m),
{name}_s as (select least(greatest(coalesce(1 / rho - 1, {MOST_STRENGTH}), {LEAST_STRENGTH}), {MOST_STRENGTH}) as s from {name}_i),
{name} as (select c.*, s * mean + good as a, s * (1 - mean) + n - good as b from {child} c join {means} using ({parent}), {name}_s)"""


_SQL_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_SQL_RULES = "\n".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'" for r in sorted(RULES, key=lambda r: -len(r.text))
)
ORACLES = {
    "op1_urls": f"""
with own as (
  select page_id, url, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')) as host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
outcome as (
  select host, l.good from own left join (select doc_id, (quality = 1 and coalesce(toxic, 0) = 0)::int as good from labels where quality is not null) l
  on l.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.]html|/)?$', 1) as bigint)),
hosts0 as (select host, coalesce(sum(good), 0)::double as good, count(good)::double as n, string_split(host, '.') as part from outcome group by host),
hosts as (select host, good, n, 0 as whole,
    case when array_to_string(part[-2:], '.') in ({_SQL_TWO}) then array_to_string(part[-3:], '.') else array_to_string(part[-2:], '.') end as domain,
    case when array_to_string(part[-2:], '.') in ({_SQL_TWO}) then array_to_string(part[-2:], '.') else array_to_string(part[-1:], '.') end as suffix from hosts0),
domains as (select domain, suffix, whole, sum(good) as good, sum(n) as n from hosts group by all),
suffixes as (select suffix, whole, sum(good) as good, sum(n) as n from domains group by all),
m0 as (select whole, (sum(good) + 1) / (sum(n) + 2) as mean from suffixes group by whole),
{_sql_level("ls", "suffixes", "whole", "m0")},
m1 as (select suffix, a / (a + b) as mean from ls),
{_sql_level("ld", "domains", "suffix", "m1")},
m2 as (select domain, a / (a + b) as mean from ld),
{_sql_level("lh", "hosts", "domain", "m2")},
bad as (select host, true as bad from lh where a / (a + b) + {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {THRESHOLD}),
fit as (select page_id, host, path, case {_SQL_RULES} end as rule from own)
select page_id, fit.host, path, rule,
  case when rule in ({", ".join(f"'{r.text}'" for r in RULES if r.verdict == "allow")}) then 'allow' when rule is not null then 'block' when bad then 'block' else 'allow' end as verdict
from fit left join bad on fit.host = bad.host"""
}
QUERIES = {"op1_urls": op1_urls}
