"""URL filters by a path-template tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeview.llm.common import written

#: (verdict, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host up to ? # or the end; empty for null or no ://."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null.

    The longest host and path together wins; of two as long, the one that stands first.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        fits = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_children: int = 16,
    min_support: int = 3,
    prior_strength: float = 4.0,
    similar_z: float = 1.96,
    reject_purity: float = 0.5,
) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url); ``labels``: (page_id, good 0/1), for any part of the pages.

    Per host a tree of path segments grows level by level. Below one branch, segments that only digits, hex digits
    or dates make up, and segments of a branch with more than ``max_children`` children that occur in under
    ``min_support`` urls, become a wildcard that keeps the file extension. Then sibling branches with the same
    templates below them whose shares of good labels differ by less than ``similar_z`` standard errors are merged.
    A template's purity is its share of good labels, smoothed by ``prior_strength`` pseudo-labels at its host's
    smoothed share, which itself leans on the share in all labels. A template under ``reject_purity`` is blocked.
    A rule that fits comes before the method. The tree is kept as counts of (host, template); no path list is
    gathered, and a host with a third of all rows is pre-aggregated before any shuffle.

    Returns (page_id, host, path, rule, verdict, template, purity), a row for each row of ``pages``. Null urls and
    urls without :// have an empty host and path and the one template of that host. Null page_ids stay and match no
    label; a page_id with several labels counts by their mean; repeated rows are judged alike; an empty table gives
    an empty result; columns other than page_id and url are not looked at.
    """
    seen = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    good = labels.select(F.col("page_id").alias("lid"), F.col("good").cast("double").alias("good")).where("lid is not null and good is not null").groupBy("lid").agg(F.avg("good").alias("good"))
    rows = seen.join(good, seen.page_id == good.lid, "left").drop("lid")
    # one row for each distinct (host, path): how many urls, how many labels, how many of them good
    paths = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    tree = paths.select("host", "path", "n", "labelled", "good", parts.alias("parts"), F.lit("").alias("template"))
    depth = paths.select(F.max(F.size(parts))).head()[0] or 0
    extension = F.regexp_extract("segment", r"(\.[A-Za-z]{1,5})$", 1)
    shape = F.regexp_replace("segment", r"\.[A-Za-z]{1,5}$", "")
    variable = shape.rlike(r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]+[-_][0-9-_]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})$")
    for level in range(depth):
        here = tree.withColumn("segment", F.get("parts", F.lit(level)))
        named = here.where(F.col("segment").isNotNull() & ~variable)
        children = named.groupBy("host", "template", "segment").agg(F.sum("n").alias("support"))
        many = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("fan")).where(F.col("fan") > max_children)
        rare = children.where(F.col("support") < min_support).join(many, ["host", "template"], "left_semi").select("host", "template", "segment", F.lit(True).alias("rare"))
        step = F.when(F.col("segment").isNull(), "").when(variable | F.coalesce("rare", F.lit(False)), F.concat(F.lit("/*"), extension)).otherwise(F.concat(F.lit("/"), F.col("segment")))
        tree = written(here.join(rare, ["host", "template", "segment"], "left").select("host", "path", "n", "labelled", "good", "parts", F.concat("template", step).alias("template")))
    tree = tree.select("host", "path", "n", "labelled", "good", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))
    nodes = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    nodes = nodes.withColumn("merged", F.col("template"))
    # sibling branches: the same template but for one segment, from the last place to the first; what is merged goes on as one
    for place in range(depth - 1, -1, -1):
        sibling = F.regexp_replace("merged", r"^((?:/[^/]*){%d})/[^/]*" % place, "$1/{}")
        one = nodes.groupBy("host", "merged").agg(F.sum("labelled").alias("own_labelled"), F.sum("good").alias("own_good")).withColumn("sibling", sibling)
        pooled = one.groupBy("host", "sibling").agg(F.sum("own_labelled").alias("all_labelled"), F.sum("own_good").alias("all_good"), F.count(F.lit(1)).alias("branches"))
        one = one.join(pooled, ["host", "sibling"])
        rest_n, rest_good = F.col("all_labelled") - F.col("own_labelled"), F.col("all_good") - F.col("own_good")
        share = F.col("all_good") / F.greatest(F.col("all_labelled"), F.lit(1))
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.01)) * (1 / F.greatest(F.col("own_labelled"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
        alike = (F.col("own_labelled") == 0) | (rest_n == 0) | (F.abs(F.col("own_good") / F.greatest(F.col("own_labelled"), F.lit(1)) - rest_good / F.greatest(rest_n, F.lit(1))) < similar_z * error)
        if place:
            alike = alike & (F.col("branches") > 1)
        to = one.select("host", "merged", F.when(alike, F.col("sibling")).otherwise(F.col("merged")).alias("to"))
        nodes = written(nodes.join(to, ["host", "merged"]).drop("merged").withColumnRenamed("to", "merged"))
    final = nodes.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    hosts = nodes.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    every = paths.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 1).alias("g"), (F.coalesce(F.sum("labelled"), F.lit(0)) + 2).alias("l")).head()
    base = float(every["g"]) / float(every["l"])
    host_share = (F.col("host_good") + prior_strength * base) / (F.col("host_labelled") + prior_strength)
    purity = ((F.col("good") + prior_strength * host_share) / (F.col("labelled") + prior_strength)).alias("purity")
    judged = final.join(hosts, "host").select("host", "merged", purity)
    judged = nodes.select("host", "template", "merged").join(judged, ["host", "merged"]).select("host", "template", F.col("merged").alias("judged"), "purity")
    by_path = tree.select("host", "path", "template").join(judged, ["host", "template"]).select("host", "path", F.col("judged").alias("template"), "purity")
    rule = _rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("purity") < reject_purity, "block").otherwise("allow")
    return seen.join(by_path, ["host", "path"]).select("page_id", "host", "path", rule.alias("r"), "template", "purity").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "template", "purity"
    )
