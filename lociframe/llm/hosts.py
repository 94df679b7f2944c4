"""URL filters: rules by host and path, and for the rest trust and distrust carried over the links between hosts.

Rules. A rule fits its host and all subdomains where the url's path starts with its own; the longest rule wins
(of equal ones the longer host, then block). Rules are a table; hosts meet it by their suffixes, so neither side
needs to be small. A host's rules are kept as one short list, longest first, and a page takes the first that fits.

Method. Hosts, with or without pages, and the links between them, counted, form a graph. Blocked seeds are hosts
whose root a rule blocks; trusted seeds are other hosts that a rule allows something on. Personalised PageRank
carries trust from trusted seeds along the links, and distrust from blocked seeds against them: who links to a blocked host earns
a share of its distrust. A seed starts with 1. A host is blocked if its distrust is at least `least` and above
its trust; hosts that neither reaches are allowed. Each step is a join and a sum over edges in Spark, with the
ranks written to the shared folder; a host with very many links is summed in parts first.

Null urls and those without "://" have an empty host and path; their pages are allowed unless a rule of the
empty host blocks them, and take no part in the graph. Null html has no links. Links within a host count nowhere.
A host that is only linked to is a seed if the rules say so and passes distrust back to who links to it; without
links of its own it passes no trust on. Repeated rows count as often as they occur.
An empty table gives an empty table. Extra columns aren't used.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LINK = r"(?is)\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules: array of (length, host, path, verdict), longest first) for hosts(host) that some rule's host fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("_suffix")).join(rules.select(F.col("host").alias("_suffix"), "path", "verdict"), "_suffix")
    order = F.struct((-F.length("_suffix") - F.length("path")).alias("o1"), (-F.length("_suffix")).alias("o2"), (F.col("verdict") != "block").alias("o3"), F.col("_suffix").alias("host"), "path", "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))


def first_fit(rules: Column, path: Column) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, share of src's links, share of dst's links) between different hosts; html is read in the JVM only."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")).where("src <> ''")
    edges = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n")).where("src <> dst")
    outs, ins = edges.groupBy("src").agg(F.sum("n").alias("o")), edges.groupBy("dst").agg(F.sum("n").alias("i"))
    return edges.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("n") / F.col("o")).alias("ahead"), (F.col("n") / F.col("i")).alias("back"))


def propagate(hosts: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = 0.85, enough: float = 1e-6) -> DataFrame:
    """hosts(host, trusted, blocked: seed weights) with trust and distrust, when no rank moves by more than `enough`.

    What moves in all shrinks by `damping` (below 1) a step at least, so this ends: after some 85 steps and, where
    cycles pass on what many seeds give, a few more.
    """
    ranks = scratch.table(hosts.select("host", "trusted", "blocked", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")), "ranks-0")
    if edges.isEmpty():
        return ranks
    for i in count(1):
        ahead = edges.join(ranks.select(F.col("host").alias("src"), "trust").where("trust > 0"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "distrust").where("distrust > 0"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        sums = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = ranks.join(sums, "host", "left").select("host", "trusted", "blocked", *(((1 - damping) * F.col(s) + damping * F.coalesce(c, F.lit(0.0))).alias(r) for s, c, r in (("trusted", "t", "trust"), ("blocked", "d", "distrust"))), F.greatest(F.abs(F.col("trust") - ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0)))), F.abs(F.col("distrust") - ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))))).alias("moved"))
        new = scratch.table(new, f"ranks-{i}")
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        scratch.drop(f"ranks-{i - 1}")
        ranks = new.drop("moved")
        if moved <= enough:
            break
    return ranks


def judge(pages: DataFrame, rules: DataFrame, least: float = 0.01, damping: float = 0.85) -> DataFrame:
    """pages(page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "hosts")
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    links = scratch.table(host_links(placed), "edges")
    hosts = placed.select("host").unionByName(links.select(F.col("src").alias("host"))).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    known = hosts.join(rules_of_hosts(hosts, rules), "host", "left")
    root = first_fit(F.col("rules"), F.lit("/"))["verdict"]
    blocked = F.coalesce(root == "block", F.lit(False)) & (F.col("host") != "")
    trusted = F.coalesce(F.exists("rules", lambda r: r["verdict"] == "allow"), F.lit(False)) & ~blocked & (F.col("host") != "")
    known = scratch.table(known.withColumns({"trusted": trusted.cast("double"), "blocked": blocked.cast("double")}), "known")
    ranks = propagate(known, links, scratch, damping)
    method = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    of_host = known.select("host", "rules").join(ranks.select("host", "trust", "distrust", method.alias("method")), "host")
    judged = placed.drop("html").join(of_host, "host", "left").withColumn("_rule", first_fit(F.col("rules"), F.col("path")))
    return judged.select("page_id", "host", "path", F.concat("_rule.host", "_rule.path").alias("rule"), F.coalesce("_rule.verdict", "method").alias("verdict"), "trust", "distrust")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages by the contract's four rules and the method."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
