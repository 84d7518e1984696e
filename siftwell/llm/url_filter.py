"""URL filter: host and path rules, then trust and distrust along links.

Pages that a rule fits take its verdict. For the others a host is judged by
link-graph propagation: trust flows from hosts whose pages rules allow along
the links (personalised PageRank, as in TrustRank), distrust from hosts whose
pages rules block against them (as in Anti-Trust Rank). A host whose distrust
exceeds its trust by ``MARGIN`` is blocked.

Everything is a DataFrame expression; nothing runs in Python on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import Table, kept

DAMPING, ROUNDS, MARGIN = 0.85, 8, 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Addresses with a host of their own in link attributes of anchors.
LINKS = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (source, target, n): links between different hosts."""
    found = F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("link")
    ends = pages.select(host_of(F.col("url")).alias("source"), found)
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return ends.select("source", host_of(whole).alias("target")).filter("source <> '' and target <> '' and source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Rows (host, trust, distrust) after ``rounds`` steps.

    ``seeds`` has one row per host: host, trust, distrust. Trust goes from a
    source to its targets in proportion to its links, distrust from a target to
    its sources in proportion to the links it gets.
    """
    out = links.groupBy("source").agg(F.sum("n").alias("all_out"))
    into = links.groupBy("target").agg(F.sum("n").alias("all_in"))
    edges = Table(links.join(out, "source").join(into, "target").select("source", "target", (F.col("n") / F.col("all_out")).alias("down"), (F.col("n") / F.col("all_in")).alias("up")), "links").df
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    if edges.isEmpty():
        return start
    ranks = Table(start, "ranks")
    for _ in range(rounds):
        sent = edges.join(ranks.df.select(F.col("host").alias("source"), "trust"), "source").select(F.col("target").alias("host"), (F.col("trust") * F.col("down") * damping).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(ranks.df.select(F.col("host").alias("target"), "distrust"), "target").select(F.col("source").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("up") * damping).alias("distrust"))
        following = Table(start.union(sent).union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        ranks.drop()
        ranks = following
    return ranks.df


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, trust, distrust), one per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path; no rule
    fits it and it links to nothing, so it is allowed. Null pages have no
    links. Repeated rows are each returned and count for their host each.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", name).withColumn("own", verdict)
    links = kept(host_links(pages), "host-links")
    share = lambda v: F.coalesce(F.avg(F.when(F.col("own").isNotNull(), F.when(F.col("own") == v, 1.0).otherwise(0.0))), F.lit(0.0))
    seen = rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    linked = links.select(F.col("source").alias("host")).union(links.select("target")).distinct().join(seen, "host", "left_anti").select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    ranks = propagate(kept(seen.union(linked), "seeds"), links)
    joined = rows.join(ranks, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") - F.col("trust") > MARGIN, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), "trust", "distrust")
