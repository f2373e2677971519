"""URL filter: domain and path rules, and trust propagated over the graph of host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, rule); a rule is a domain and a path that starts at its first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What a link names: an address with a scheme, or one that takes the page's (``//host/...``).
LINK = r"""(?i)<(?:a|area)\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    rows = [(r, r[: r.index("/")], r[r.index("/") :], v) for v, r in rules]
    names = ("rule", "domain", "rule_path", "rule_verdict")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])))


def match_rules(urls: DataFrame, rules: DataFrame, most_labels: int) -> DataFrame:
    """(host, path) -> the longest rule that fits; of equally long ones the least by code point.

    A host fits the rules of its own name and of every parent domain, so its suffixes of up to
    ``most_labels`` labels (no rule's domain has more) are joined by equality with the rules'
    domains; no host meets a rule of another domain.
    """
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, most_labels + 1)]))
    distinct = urls.select("host", "path").distinct()
    fits = distinct.withColumn("domain", F.explode(suffixes)).join(F.broadcast(rules), "domain").where(F.startswith("path", "rule_path"))
    ranked = fits.groupBy("host", "path", F.length("rule").alias("n")).agg(F.min(F.struct("rule", "rule_verdict")).alias("r"))
    ranked = ranked.groupBy("host", "path").agg(F.max_by("r", "n").alias("r"))
    return ranked.select("host", "path", "r.rule", "r.rule_verdict")


def host_edges(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """(src, dst, n): how many absolute links each host's pages have to each other host."""
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("src", host_of(F.concat(F.when(F.startswith("to", F.lit("//")), F.lit("any:")).otherwise(F.lit("")), F.col("to"))).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, scratch: common.Scratch, damping: float = 0.85, tolerance: float = 1e-4, every: int = 8, most: int = 400) -> DataFrame:
    """Two personalised PageRanks at once: (host, trust, distrust).

    Trust starts at hosts with ``seed_trust`` > 0 and follows links; distrust starts at hosts with
    ``seed_block`` > 0 and goes against them, since a host that links to a blocked one is suspect.
    What a host without links holds goes back to the seeds. That only adds to what seeds give, in
    their proportion, so ranks are summed without it, ``x = seed + damping * (what links bring)``,
    and divided by their sum at the end. A round is one join and one aggregation on the host of the
    ranks before, used once; every few rounds the ranks are written, and the work ends when a round
    moves less than ``tolerance`` of either rank. More than ``most`` rounds raise an error.
    """
    flow = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    flow = flow.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = flow.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    flow = scratch.write(flow.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")), "flow")

    sums = hosts.agg(F.sum("seed_trust").alias("trust"), F.sum("seed_block").alias("distrust")).first()
    seeds = None
    for kind, column in (("trust", "seed_trust"), ("distrust", "seed_block")):
        if sums and sums[kind]:
            part = hosts.where(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(column) / float(sums[kind])).alias("seed"))
            seeds = part if seeds is None else seeds.unionByName(part)
    if seeds is None:
        return hosts.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    seeds = scratch.write(seeds, "seeds")

    def step(score: DataFrame) -> DataFrame:
        moved = score.join(flow, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        return moved.unionByName(seeds.withColumnRenamed("seed", "score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))

    score, change, rounds = seeds.withColumnRenamed("seed", "score"), 1.0, 0
    if flow.isEmpty():
        change = 0.0
    while change > tolerance:
        if rounds >= most:
            raise RuntimeError(f"ranks still move by {change} after {rounds} rounds")
        for _ in range(every - 1):
            score = step(score)
        before = scratch.write(score, "score")
        score = scratch.write(step(before), "score")
        rounds += every
        both = before.withColumnRenamed("score", "old").join(score, ["kind", "host"], "full")
        moved = both.groupBy("kind").agg((F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / F.sum("score")).alias("d"))
        change = moved.agg(F.max("d")).first()[0] or 0.0
    total = score.groupBy("kind").agg(F.sum("score").alias("total"))  # a row a kind
    score = score.join(F.broadcast(total), "kind").withColumn("score", F.col("score") / F.col("total"))
    by_host = score.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )
    return hosts.select("host").join(by_host, "host", "left").na.fill(0.0, ["trust", "distrust"])


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: tuple[tuple[str, str], ...] = RULES,
    damping: float = 0.85,
    threshold: float = 0.5,
    margin: float = 1e-3,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, trust, distrust.

    The rule's verdict holds where a rule fits the page; elsewhere the host's propagated scores
    decide: a host is blocked when distrust makes up more than ``threshold`` of both, beyond a
    share ``margin`` that the ranks' last changes may make. Seeds are the hosts of rule-matched
    pages, in proportion to their number of distinct paths. A host that nothing reaches is allowed,
    and so are an empty host and a null url. Links are counted over the whole html of every page,
    however long; null html has none. Repeated rows count as repeated links and are judged alike.
    Other columns are ignored. Empty table: empty result.
    """
    spark = pages.sparkSession
    host = host_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.col(url_col)).alias("path"))
    with common.Scratch(spark, "links") as scratch:
        labels = max(r.split("/")[0].count(".") + 1 for _, r in rules)
        matched = common.materialize(match_rules(urls, rule_table(spark, rules), labels), "url-rules")
        edges = scratch.write(host_edges(pages, host, html_col), "edges")
        hosts = urls.select("host").union(edges_hosts(edges)).distinct()
        seeds = matched.groupBy("host").agg(
            F.sum((F.col("rule_verdict") == "allow").cast("int")).alias("seed_trust"),
            F.sum((F.col("rule_verdict") == "block").cast("int")).alias("seed_block"),
        )
        hosts = scratch.write(hosts.join(seeds, "host", "left").na.fill(0, ["seed_trust", "seed_block"]), "hosts")
        scores = common.materialize(propagate(hosts, edges, scratch, damping), "url-scores")
    out = urls.join(common.small(matched, common.BROADCAST_ROWS // 10), ["host", "path"], "left").join(common.small(scores, common.BROADCAST_ROWS // 10), "host", "left")
    both = F.col("trust") + F.col("distrust")
    bad = F.col("distrust") - threshold * both > margin * both
    verdict = F.coalesce("rule_verdict", F.when(bad & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def edges_hosts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("host")).union(edges.select("dst"))
