"""URL verdicts: host and path rules first, link-graph propagation for the rest.

Trust starts at hosts whose pages allow rules name and follows links; distrust starts at hosts whose pages
block rules name and follows links backwards (who links to bad hosts is bad). Both are personalised PageRank
over host edges, computed in one loop over DataFrames; the scores are compared per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.llm.common import cut, drop_table, filled, join_hot, need

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
RULES = "rule string, verdict string"
#: Rules and their hosts are broadcast up to this many; beyond it they are shuffled.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(filled(url), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(filled(url), URL, 2)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of host src that link to host dst. A relative link stays on its host."""
    link = lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(h)).when(h.startswith("//"), host_of(F.concat(F.lit("x:"), h))).otherwise(F.col("src"))
    found = need(pages, "url", "html").select(host_of(F.col("url")).alias("src"), F.regexp_extract_all(filled("html"), F.lit(HREF), F.lit(1)).alias("hrefs"))
    return found.select("src", F.explode(F.array_distinct(F.transform("hrefs", link))).alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 50) -> DataFrame:
    """host, trust, distrust. ``seeds``: host, trust, distrust in [0, 1]; ``edges``: src, dst, n.

    Personalised PageRank of both scores: ``r = (1 - damping) s + damping (P r + m s)``, where P shares a host's score
    among its links by their number (trust forward, distrust backward), s are the seeds as a distribution and m is the
    mass at hosts without such links, which goes back to the seeds. It ends when no score moves by ``tolerance``,
    or after ``rounds``. Scores are given in units of the seeds (times their sum, so that they add up to what the seeds
    add up to): a host that keeps to itself has its seed. A hub's row count is its number of distinct neighbours;
    scores are summed before a shuffle. Each round is written to the shared folder and the one before is deleted.
    """
    both = edges.select(F.lit("t").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "n"))
    out = both.groupBy("kind", "u").agg(F.sum("n").alias("total"))
    share = cut(both.join(out, ["kind", "u"]).select("kind", "u", "v", (damping * F.col("n") / F.col("total")).alias("w")), "host-shares")
    start = seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("trust"), F.lit("d"), F.col("distrust"))).alias("kind", "s"))
    start = start.groupBy("kind", F.col("host").alias("u")).agg(F.max("s").alias("s")).where("s > 0")
    start = cut(start.join(out.select("kind", "u", F.lit(True).alias("links")), ["kind", "u"], "left"), "host-seeds")
    total = {r.kind: r.s for r in start.groupBy("kind").agg(F.sum("s").alias("s")).collect()}
    lost = {r.kind: r.m for r in start.where("links is null").groupBy("kind").agg(F.sum("s").alias("m")).collect()}
    rank, table = start.select("kind", "u", F.col("s").alias("r")), None
    for _ in range(rounds):
        again = F.lit(1 - damping)  # the part of a seed that comes back: teleports, and what dangling hosts held
        for kind in sorted(total):
            again = again + F.when(F.col("kind") == kind, damping * lost.get(kind, 0.0) / total[kind]).otherwise(0.0)
        zero = F.lit(0.0)
        sent = share.join(rank.where("r > 0"), ["kind", "u"]).select("kind", F.col("v").alias("u"), (F.col("w") * F.col("r")).alias("r"), zero.alias("was"))
        base = start.select("kind", "u", (again * F.col("s")).alias("r"), zero.alias("was"))
        was = rank.select("kind", "u", zero.alias("r"), F.col("r").alias("was"))
        moved = sent.unionByName(base).unionByName(was).groupBy("kind", "u").agg(F.sum("r").alias("r"), F.sum("was").alias("was"))
        moved = cut(moved.join(out.select("kind", "u", F.lit(True).alias("links")), ["kind", "u"], "left"), "host-rank")
        if table is not None:
            drop_table(table)
        table, rank = moved, moved.select("kind", "u", "r")
        told = moved.groupBy("kind").agg(F.max(F.abs(F.col("r") - F.col("was"))).alias("moved"), F.coalesce(F.sum(F.when(F.col("links").isNull(), F.col("r"))), F.lit(0.0)).alias("m")).collect()
        lost = {r.kind: r.m for r in told}
        if max((r.moved for r in told), default=0) < tolerance:
            break
    score = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0))
    return rank.groupBy(F.col("u").alias("host")).agg(score("t").alias("trust"), score("d").alias("distrust"))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict (null where none fits). ``rules``: rule (host/path), verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, of
    equally long ones the alphabetically last. Rules meet hosts by equality of domain suffixes, once per
    distinct host, and pages then take their host's few rules.
    """
    told = need(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    slash = F.locate("/", F.col("rule"))
    known = rules.where("rule is not null").select(
        F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("suffix"),
        F.struct(F.char_length("rule").alias("size"), "rule", "verdict", F.when(slash > 0, F.substr(F.col("rule"), slash)).otherwise("").alias("path")).alias("r"),
    )
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    counts = cut(told.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-counts")
    hosts = counts.select("host", F.explode(suffixes).alias("suffix"))
    by_host = hosts.join(known, "suffix").groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))
    fit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return join_hot(told, by_host, "host", counts).select("page_id", "host", "path", fit["rule"].alias("rule"), fit["verdict"].alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, block_over: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of ``pages``.

    The verdict is the rule's, else ``block`` where the host's distrust is over ``block_over`` and over its
    trust, else ``allow``. A host's seed is the share of its pages that a rule of that kind decides. Null url
    or html counts as empty (empty host, no rule: allow); a null page_id stays null; repeated pages repeat;
    no rows give no rows; other columns are not read.
    """
    ruled = cut(apply_rules(pages, rules), "pages-ruled")
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("rule_verdict") == "allow") / F.count(F.lit(1))).alias("trust"), (F.count_if(F.col("rule_verdict") == "block") / F.count(F.lit(1))).alias("distrust"))
    seeds = cut(seeds, "host-shares")
    scores = propagate(cut(host_edges(pages), "host-edges"), seeds.drop("n"))
    bad = (F.col("distrust") > block_over) & (F.col("distrust") > F.col("trust"))
    return join_hot(ruled, scores, "host", seeds.select("host", "n")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        *[F.when(F.col("host") != "", F.coalesce(c, F.lit(0.0))).alias(c) for c in ("trust", "distrust")],
    )


def op6_url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
