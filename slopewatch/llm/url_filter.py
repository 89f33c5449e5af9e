"""URL verdicts from rules and, where no rule fits, from trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank from the hosts whose pages rules allow, along links; distrust the same from the
hosts whose pages rules block, against the links' direction (who links to blocked hosts is suspect). A host's seed
is the share of its pages that the rules judge so. All of it are DataFrame operations.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.shared import ascii_lower, small_or_shuffled, written

DAMPING = 0.85
#: Rounds of spread() where no tolerance is given.
ROUNDS = 12
#: judge() spreads until the changes of a round, summed up over all hosts, are below this. Each later round changes at
#: most DAMPING times as much, so no host's trust or distrust is further than 6 tolerances from the limit.
TOLERANCE = 1e-6
#: A host is blocked if its distrust is so far above its trust; 1 is what a host has whose pages all are blocked.
MARGIN = 0.5

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for urls without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and for urls without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages to other hosts, counted. Takes host and html."""
    out = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    return out.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src != dst and src != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules that fit each host or a domain above it, as structs (size, verdict, path, rule)."""
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    rule = F.concat("r.host", "r.path")
    fit = hosts.select("host", F.explode(suffixes).alias("domain")).join(rules.alias("r"), F.col("domain") == F.col("r.host"))
    found = F.struct(F.length(rule).alias("size"), F.col("r.verdict").alias("verdict"), F.col("r.path").alias("path"), rule.alias("rule"))
    return fit.groupBy(hosts["host"]).agg(F.collect_set(found).alias("rules"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """(host, trust, distrust) from (host, trust, distrust) and (src, dst, n), in units of a fully seeded lone host.

    With a tolerance, `rounds` doesn't count: rounds follow until the sums of absolute changes of trust and of distrust are below it.
    """
    outward = edges.groupBy("src").agg(F.sum("n").alias("out"))
    inward = edges.groupBy("dst").agg(F.sum("n").alias("in"))
    e = written(edges.join(outward, "src").join(inward, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("w_out"), (F.col("n") / F.col("in")).alias("w_in")), "url-edges")
    now = seeds
    if e.isEmpty():
        return now
    for k in count():
        if tolerance is None and k == rounds:
            break
        trust = e.join(now.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("w_out")).alias("t"), F.lit(0.0).alias("d"))
        doubt = e.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("w_in")).alias("d"))
        got = trust.union(doubt).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        last, now = now, written(
            seeds.alias("s").join(got.alias("g"), "host", "full").select(
                "host",
                (F.coalesce("s.trust", F.lit(0.0)) + damping * F.coalesce("g.t", F.lit(0.0))).alias("trust"),
                (F.coalesce("s.distrust", F.lit(0.0)) + damping * F.coalesce("g.d", F.lit(0.0))).alias("distrust"),
            ),
            "url-scores",
        )
        if tolerance is not None and changed(last, now) < tolerance:
            break
    return now


def changed(last: DataFrame, now: DataFrame) -> float:
    """Sum of absolute changes over all hosts, of trust or of distrust, whichever is more."""
    d = now.join(last.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left")
    total = lambda c, old: F.coalesce(F.sum(F.abs(F.col(c) - F.coalesce(old, F.lit(0.0)))), F.lit(0.0))
    return max(d.agg(total("trust", "t"), total("distrust", "d")).first())


def judge(pages: DataFrame, rules: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    pages: page_id, url, html (more columns are ignored). rules: host, path, verdict (allow or block). A rule fits its
    host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones that which
    blocks, then the greater string. Pages without a fitting rule get their host's verdict: block if distrust is at
    least `margin` above trust. Null urls and urls without :// have the host "", which no link reaches: they are
    allowed unless a rule says otherwise. Repeated rows are judged alike.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = written(rules_by_host(named.select("host").distinct(), rules), "url-rules")
    fit = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(r["size"], r["verdict"], r["rule"])))
    judged = named.join(small_or_shuffled(hosts), "host", "left").select("page_id", "host", "path", best.alias("best"))
    judged = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    share = lambda v: F.avg(F.coalesce((F.col("ruled") == v).cast("double"), F.lit(0.0)))
    seeds = written(judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "url-seeds")
    scores = written(spread(seeds, host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")), tolerance=TOLERANCE), "url-scores")
    blocked = F.coalesce(F.col("distrust") - F.col("trust") >= margin, F.lit(False)) & (F.col("host") != "")
    return judged.join(small_or_shuffled(scores), "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"
    )
