"""URL verdicts by rules, and by trust and distrust that spread over links between hosts.

Trust is personalised PageRank from hosts with allowed pages along links; distrust is the same from hosts with blocked pages
against links. A page without a rule has its host's verdict.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberpanel.llm.common import hot_join, hot_keys, settle

#: (verdict, host and path prefix) as the query's contract states them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A link to another host: absolute or without a scheme.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct<rule, verdict> of the longest fitting rule (of equally long ones the first as text), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted before they are shuffled."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("dst"))
    return links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, *, damping: float, settled: float = 1e-3, every: int = 6) -> DataFrame:
    """Personalised PageRank (host, mass) from seeds (host, mass) along links (src, dst, n); lost mass returns to the seeds.

    Mass that leaves the graph only scales the rest, so rounds add up the seeds and what links move, and the sum is made 1 at the end.
    Each round joins links with the mass of their source host and sums by target host, partly aggregated before its shuffle; links of
    a host that has more than 1/256 of them stay where they are. Lineage is cut ``every`` few rounds, and rounds end when the last
    moved less than ``settled`` of the mass: no later than when ``damping`` to their power is below it.
    """
    out = settle(links.groupBy("src").agg(F.sum("n").alias("total"), F.count("*").alias("targets")))
    hot = hot_keys(out, "src", "targets", links.count())
    shares = settle(hot_join(links, out.select("src", "total"), "src", hot, F.xxhash64("dst")).select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    mass = seeds = settle(seeds)
    while True:
        for _ in range(every):
            moved = hot_join(shares, mass.select(F.col("host").alias("src"), "mass"), "src", hot, F.xxhash64("dst")).where("mass is not null")
            arrived = moved.select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"), F.lit(0.0).alias("old"))
            kept = mass.select("host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")) if _ == every - 1 else None
            rows = arrived.unionByName(seeds.select("host", "mass", F.lit(0.0).alias("old")))
            mass = (rows if kept is None else rows.unionByName(kept)).groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old"))
        mass = settle(mass, as_table=True)
        total, change = mass.agg(F.sum("mass"), F.sum(F.abs(F.col("mass") - F.col("old")))).first()
        if (change or 0.0) <= settled * (total or 0.0):
            return mass.select("host", (F.col("mass") / (total or 1.0)).alias("mass"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """``id_col``, host, path, rule and verdict of each page, and host_distrust, the distrust's share of the host's mass.

    The longest rule that fits decides; without one a host is blocked whose distrust is more than ``threshold`` of its trust and
    distrust together. Hosts that neither reaches are allowed. Seeds weigh as the share of the host's pages that rules allow or
    block. A null url, or one without ``://``, has empty host and path and no rule. Null pages link nowhere. Repeated
    pages count and stay row by row; null ids are kept. Whole pages are searched for links, however long. An empty table gives no
    rows. Other columns are ignored. Rules are a short list, matched in place.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("_rule.verdict")
    hosts = rows.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.avg((F.coalesce(verdict == "allow", F.lit(False))).cast("double")).alias("good"), F.avg((F.coalesce(verdict == "block", F.lit(False))).cast("double")).alias("bad"))
    hosts = settle(hosts)
    links = settle(host_links(pages, url_col, html_col))
    reached = hosts.select("host")
    any_links = not links.isEmpty()
    for column, own in (("good", links), ("bad", links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        total = hosts.agg(F.sum(column)).first()[0] or 0.0
        seeds = hosts.where(F.col(column) > 0).select("host", (F.col(column) / (total or 1.0)).alias("mass"))
        mass = spread(seeds, own, damping=damping) if any_links and total else seeds
        reached = reached.join(mass.withColumnRenamed("mass", f"{column}_mass"), "host", "left")
    good, bad = (F.coalesce(F.col(f"{c}_mass"), F.lit(0.0)) for c in ("good", "bad"))
    judged = reached.select("host", F.when(bad > 0, bad / (good + bad)).otherwise(0.0).alias("host_distrust"))
    # A host may have a third of all pages: pages of such hosts stay where they are and get the verdict by broadcast.
    hot = hot_keys(hosts, "host", "pages", hosts.agg(F.sum("pages")).first()[0] or 0)
    out = hot_join(rows, judged, "host", hot, F.xxhash64("_id", "path"))
    by_host = F.when(F.col("host_distrust") > threshold, "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.coalesce("host_distrust", F.lit(0.0)).alias("host_distrust"))
