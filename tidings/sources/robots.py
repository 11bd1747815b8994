"""robots.txt rules of the generic group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.functions import markup as mk, urls


def robots_disallows(robots: DataFrame) -> DataFrame:
    """(host, pos, rule) of robots files (host, body)."""
    return robots.select("host", F.posexplode(mk.robots_rules(F.col("body"))).alias("pos", "rule"))


def allowed_urls(links: DataFrame, robots: DataFrame) -> DataFrame:
    """Rows of ``links`` (url) no rule of their host forbids; a host without a file allows all.

    A host's rules stay together in one row, so a busy host adds no rows to the join.
    """
    patterns = F.transform(mk.robots_rules(F.col("body")), urls.rule_pattern)
    rules = robots.select(F.col("host").alias("_host"), patterns.alias("_rules"))
    keyed = links.withColumn("_host", urls.authority(F.col("url")))
    target = urls.path_and_query(F.col("url"))
    forbidden = F.exists("_rules", lambda r: F.regexp_like(target, r))
    return keyed.join(rules, "_host", "left").filter(~F.coalesce(forbidden, F.lit(False))).select(*links.columns)
