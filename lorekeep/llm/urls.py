"""URL filters: rules by host and path, and trust and distrust carried along the links between hosts.

Rules decide first. A rule is a host, which stands for its subdomains too, and the beginning of a path;
the longest rule that fits a url wins. Where none fits, the host decides. Its pages judged by rules are
seeds: the share of allowed pages is trust, the share of blocked pages is distrust. Trust runs along the
links (personalised PageRank), distrust runs against them: who links to blocked hosts is suspect. With
damping a both are the series (1 - a) * sum over k of a^k * (mass moved k times); a round moves what the last one
moved, and the rounds end when all that is still to come is below ``tolerance``. In the unit of a host
without links whose pages are all blocked, a host is blocked if distrust less trust exceeds ``threshold``.

Only DataFrame functions are used. Pages never move with their html: what is shuffled are hosts, paths
and counted (host, host) links, combined before every shuffle; adaptive joins split a hot host.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule of a named
host and is allowed. Null and empty html have no links. Repeated pages count as often as they occur. Rules
that repeat with different verdicts block. Links are read from ``href`` of ``a`` tags with a host of their
own (``scheme://host`` or ``//host``), also in comments; links within a host move nothing. Empty tables
give empty results; columns of the pages that are named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import written

# fixed value: what a link with a host of its own looks like, up to the end of that host
LINK = r"""(?i)<a[ \t\n\r\f][^<>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\n\r\f]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, verdict of (verdict, ``host/path``) pairs, as a relation whose size Spark knows."""
    none = "array<struct<verdict:string,rule:string>>"
    made = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]).cast(none)
    return spark.range(1).select(F.inline(made)).select("rule", "verdict")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct urls (host, path) that a rule fits.

    A url asks for every (number of labels, length of path) that occurs among the rules. There are at
    most as many of these as the longest rule has labels and characters, however many rules there are.
    """
    cut = F.instr("rule", "/")
    parts = rules.select(
        "rule", "verdict",
        F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("r_host"),
        F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("r_path"),
    ).withColumn("r_host", F.translate("r_host", UPPER, LOWER))
    shapes = parts.select(F.size(F.split("r_host", r"\.")).alias("k"), F.length("r_path").alias("n")).distinct().collect()
    asked = [
        F.when(
            (F.size("labels") >= s.k) & (F.length("path") >= s.n),
            F.struct(F.substring_index("host", ".", -s.k).alias("r_host"), F.substring("path", 1, s.n).alias("r_path")),
        )
        for s in shapes
    ]
    none = F.array().cast("array<struct<r_host:string,r_path:string>>")
    keyed = urls.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    keyed = keyed.select("host", "path", F.inline(F.array_compact(F.array(*asked)) if asked else none))
    # the longest rule, then the longest host; one rule told twice blocks
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("verdict") == "block")
    best = keyed.join(parts, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")


def host_links(pages: DataFrame, *, html: str = "html", host: str = "host") -> DataFrame:
    """source, target, n: links between different hosts, counted before they are shuffled."""
    found = pages.select(F.col(host).alias("source"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("target"))
    found = found.select("source", F.translate("target", UPPER, LOWER).alias("target"))
    return found.where("source <> '' and source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """kind, host, score: the mass of ``seeds`` (kind, host, mass of zero or more) carried along the ``links``
    (kind, source, target, n) of its kind.

    A host passes what it gets on in proportion to n. The score of a seed without links is its mass. The
    scores of all hosts together are at most ``tolerance`` below the exact ones.
    """
    total = links.groupBy("kind", "source").agg(F.sum("n").alias("all"))
    share = (F.col("n") / F.col("all")).alias("share")
    shares = written(links.join(total, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", share))
    parts = [seeds.where("mass > 0").select("kind", "host", "mass")]
    left = 1.0
    while left / (1 - damping) > tolerance:
        moved = parts[-1].join(shares, ["kind", "host"]).groupBy("kind", F.col("target").alias("host"))
        parts.append(written(moved.agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))))
        left = parts[-1].agg(F.sum("mass")).first()[0] or 0.0
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("kind", "host").agg(F.sum("mass").alias("score"))


def judge(
    pages: DataFrame, rules: DataFrame, *, url: str = "url", html: str = "html", damping: float = 0.85,
    threshold: float = 0.5, tolerance: float = 1e-4,
) -> DataFrame:
    """``pages`` without html, with host, path, rule (null if none fits), verdict, trust and distrust of the host.

    ``rules`` has rule (``host/path``) and verdict (``allow`` or ``block``).
    """
    made = ("host", "path", "rule", "verdict", "trust", "distrust")
    kept = [c for c in pages.columns if c.lower() not in (html.lower(), *made)]
    at = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    urls = pages.select(F.col(url)).select(*[c.alias(n) for n, c in at.items()])
    best = written(fitting_rules(urls, rules))

    counted = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(best, ["host", "path"], "left")
    share = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0)) / F.sum("n")
    seeds = written(counted.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    links = written(host_links(pages.select(at["host"].alias("host"), F.col(html).alias("html"))))
    forth = links.select(F.lit("trust").alias("kind"), "source", "target", "n")
    back = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n")
    mass = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("mass")) for k, c in (("trust", "good"), ("distrust", "bad"))]))
    scored = propagate(seeds.select("host", mass), forth.unionByName(back), damping=damping, tolerance=tolerance)
    both = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    # written, so that Spark knows whether the hosts are few enough to be broadcast
    hosts = written(scored.groupBy("host").agg(*both))

    judged = pages.select(*kept, *[c.alias(n) for n, c in at.items()])
    judged = judged.join(best, ["host", "path"], "left").join(hosts, "host", "left")
    scores = {c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")}
    by_host = F.when(scores["distrust"] - scores["trust"] > threshold, "block").otherwise("allow")
    return judged.withColumns({"verdict": F.coalesce("verdict", by_host), **scores}).select(*kept, *made)
