"""URL filters (11): rules for hosts and paths, and for all else the link graph of hosts.

Rules. A rule (host, path, verdict) fits its host and all subdomains, if the url's path
starts with the rule's; of those that fit, the longest wins (host and path together;
then the longer host, then block).

Links. Pages that link are summed to edges between hosts, weighted by the number of
links. A host is a trusted seed with the share of its pages that rules allow, if that is
at least ``seed_share``, and a blocked seed with the share that they block. Trust runs
along the edges (a host shares what it has over its links), distrust runs against
them, from the blocked seeds to the hosts that link to them: two personalised PageRanks,
damped by ``damping``. Each seed starts with its own mass, not with a share of one, so
the thresholds mean the same for any number of hosts. Mass that reaches a host
without links ends there. A host is blocked if its distrust is at least
``least_distrust`` and exceeds ``trust_weight`` times its trust; its pages that no rule
fits get that verdict, all others allow.

At scale: pages are reduced to hosts and edges by sums before their shuffles; a round is
an equi-join of the edges with the ranks and a grouped sum, so a host with very many links
is summed up in every task that holds some of them. A few rules are an expression over
each row, many are met by equality of host suffixes and path prefixes. Nothing but a
number a round comes to the driver.

Defined cases. Null url, or one without ``://``: host and path are empty, no rule,
allow. An empty host is no host of the graph. Links to the own host, relative links
and links without a host don't count; null or empty html has none. Repeated rows are
pages of their own and count each. Without seeds or edges no rank moves. An empty table
gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The address of a link; a tag ends at > and can't hold <, so the pattern is linear in the text.
_HREF = r"""(?i)<a[ \t\r\n\f](?:[^<>]*?[ \t\r\n\f])?href[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*([^"' \t\r\n\f<>]+)"""
#: Up to so many rules are an expression over each row; more are joined. Both give the same.
INLINE_RULES = 200


@dataclass(frozen=True)
class Spread:
    """How trust and distrust run and when a host is blocked."""

    damping: float = 0.85
    rounds: int = 16
    seed_share: float = 0.5
    least_distrust: float = 0.05
    trust_weight: float = 1.0


def lowered(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lowered(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_host(link: Column) -> Column:
    """The host of an absolute link, or of one that begins with //; empty for others."""
    return lowered(F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def _inline(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The winning rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    # the last of the chain is asked first: shortest rule innermost
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == BLOCK)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """pages (host, path and others) with the struct column ``ruled`` (rule, verdict) or null. rules: (host, path, verdict)."""
    rules = rules.filter("host <> ''").select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    few = rules.limit(inline + 1).collect()
    if len(few) <= inline:
        return pages.withColumn("ruled", _inline(F.col("host"), F.col("path"), [tuple(r) for r in few]))
    order = F.struct((F.length("host") + F.length("path")).alias("all"), F.length("host").alias("of_host"), (F.col("verdict") == BLOCK).alias("blocks"))
    known = rules.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), order).alias("ruled"), F.max(order).alias("order"))
    sizes = known.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))  # at most as many as a path has characters
    # one row for each address: the ends of its host that rules name, and the starts of its path as long as theirs
    where = frames.cut(pages.groupBy("host", "path").agg(F.count("*").alias("n")).select("host", "path"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = where.select("host", "path", F.explode(ends).alias("end")).join(sizes.withColumnRenamed("host", "end"), "end")
    met = met.select("host", "path", "end", F.explode("sizes").alias("size")).filter(F.col("size") <= F.length("path"))
    met = met.withColumn("start", F.expr("substr(path, 1, size)"))
    won = met.join(known.select(F.col("host").alias("end"), F.col("path").alias("start"), "ruled", "order"), ["end", "start"]).groupBy("host", "path").agg(F.max_by("ruled", "order").alias("ruled"))
    h, p, r = (frames.free_name(pages, x) for x in ("host_", "path_", "ruled"))
    won = frames.cut(won.select(F.col("host").alias(h), F.col("path").alias(p), F.col("ruled").alias(r)))
    return pages.join(won, (pages.host == won[h]) & (pages.path == won[p]), "left").drop(h, p)


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; pages: (host, html)."""
    link = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("link"))
    met = link.select("src", link_host(F.col("link")).alias("dst")).filter("dst <> '' and dst <> src")
    return met.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, how: Spread = Spread()) -> DataFrame:
    """(host, rank): personalised PageRank over edges (src, dst, n) from seeds (host, mass), unnormalised."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = frames.cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    start = frames.cut(seeds.select("host", (F.col("mass") * (1 - how.damping)).alias("rank")))
    if shares.isEmpty():
        return start
    total, wave = start, start
    for _ in range(how.rounds):
        # what arrives after one more link; the rank is the sum of all waves
        wave = frames.cut(shares.join(wave, shares.src == wave.host).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank") * how.damping).alias("rank")).select(F.col("dst").alias("host"), "rank"))
        moved = wave.agg(F.max("rank")).first()[0]
        if moved is None:
            break
        total = frames.cut(total.union(wave).groupBy("host").agg(F.sum("rank").alias("rank")))
        if moved < 1e-9:
            break
    return total


def host_scores(hosts: DataFrame, edges: DataFrame, how: Spread = Spread()) -> DataFrame:
    """(host, trust, distrust, blocked) of all hosts with a rank. hosts: (host, pages, allowed, blocked), numbers of pages."""
    share = lambda c: F.col(c) / F.col("pages")
    seeds = lambda c: hosts.filter((F.col(c) > 0) & (share(c) >= how.seed_share)).select("host", share(c).alias("mass"))
    trust = propagated(edges, seeds("allowed"), how)
    distrust = propagated(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("blocked"), how)
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "rank"))
    ranks = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    return ranks.withColumn("blocked", (F.col("distrust") >= how.least_distrust) & (F.col("distrust") > how.trust_weight * F.col("trust")))


def judge(pages: DataFrame, rules: DataFrame, how: Spread = Spread()) -> DataFrame:
    """pages (url, html and others) with the struct column ``filter`` (or a free name like it): host, path, rule, verdict, and the host's trust and distrust (0 without).

    The html is read for its links and not carried along.
    """
    name = frames.free_name(pages, "filter")
    parts = F.struct(host_of(pages.url).alias("host"), path_of(pages.url).alias("path"))
    addresses = pages.select(parts.alias("at")).select("at.*")
    per_host = with_rules(addresses, rules).groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled.verdict") == ALLOW).alias("allowed"), F.count_if(F.col("ruled.verdict") == BLOCK).alias("blocked")
    )
    edges = frames.cut(edges_of(pages.select(host_of(pages.url).alias("host"), "html")))
    scores = frames.cut(host_scores(frames.cut(per_host.filter("host <> ''")), edges, how))
    ruled = with_rules(pages.select(F.struct(*(frames.quoted(pages, c) for c in pages.columns if c.lower() != "html")).alias("own"), host_of(pages.url).alias("host"), path_of(pages.url).alias("path")), rules)
    met = ruled.join(scores, "host", "left")
    verdict = F.coalesce("ruled.verdict", F.when(F.coalesce("blocked", F.lit(False)), BLOCK).otherwise(ALLOW))
    told = F.struct("host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return met.select("own.*", told.alias(name))


#: The rules of the query: (host, path, verdict).
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge(frames.table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return judged.select("page_id", *(f"filter.{c}" for c in ("host", "path", "rule", "verdict")))
