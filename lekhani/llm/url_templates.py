"""URL filters: host rules first, then a tree of path templates judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Loop, attach, cut

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def rule_for(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule, as text and verdict; null if none fits. The rules are a short list in the code."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def template_tree(shapes: DataFrame, *, many: int = 8, spread: float = 0.5, evidence: int = 10, z: float = 1.96, prior_weight: float = 10.0) -> DataFrame:
    """(host, parts, n, labelled, good), one row per host and path -> the same with ``template`` and ``purity``.

    From the root of each host down, the children of each node are generalised:
    - all of them to ``*`` if the segment is variable: at least ``many`` different children that are over ``spread`` of
      the node's pages;
    - a child with at least ``evidence`` labels to ``~k``, k the tenth that its share of good pages is in, if siblings of
      the same tenth have as many and the shares don't differ by a test of proportions at ``z``: similar branches
      become one;
    - else it stays as it is; children with few labels are never merged.
    A node's purity is (good + ``prior_weight`` * its parent's purity) / (labelled + ``prior_weight``), that of a root
    with the share of all labels in the parent's place: nodes with few labels lean on what lies above them. Descent ends
    where a node has one path only; what remains of it belongs to the template as it is.

    Sums are taken per node in each task first, and what is known of a node with very many paths is sent to every task.
    """
    whole = shapes.agg(F.sum("good"), F.sum("labelled")).first()
    share = ((whole[0] or 0) + prior_weight) / ((whole[1] or 0) + prior_weight)  # without evidence pages are good
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    purer = (F.col("good") + prior_weight * F.col("purity")) / (F.col("labelled") + prior_weight)
    keep = ["host", "parts", "n", "labelled", "good", "template", "purity"]

    roots = shapes.groupBy("host").agg(*sums, F.count(F.lit(1)).alias("paths"))
    roots = cut(roots.withColumn("purity", F.lit(share)).select("host", purer.alias("purity"), "paths"))
    live = attach(shapes, roots.withColumn("c", F.col("paths")), {"host": "host"}, "c", shapes.count())
    loop, at = Loop(shapes.sparkSession), 0
    live = loop.put(live.withColumn("template", F.lit("")))
    while True:
        tail = F.when((F.size("parts") > F.lit(at)), F.concat("template", F.lit("/"), F.array_join(F.slice("parts", at + 1, F.greatest(F.size("parts") - at, F.lit(0))), "/"))).otherwise(F.col("template"))
        over = (F.col("paths") == 1) | (F.size("parts") <= at)
        finished = live.where(over).withColumn("template", tail).select(*keep)
        loop.add(finished)
        live = live.where(~over).withColumn("seg", F.get("parts", F.lit(at)))
        total = live.count()
        if not total:
            break
        child = live.groupBy("host", "template", "seg").agg(*sums, F.max("purity").alias("purity"), F.count(F.lit(1)).alias("rows"))
        tenth = F.when(F.col("labelled") >= evidence, F.least(F.floor(10 * F.col("good") / F.nullif(F.col("labelled"), F.lit(0))), F.lit(9))).otherwise(-1)
        child = cut(child.withColumn("tenth", tenth.cast("int")))
        like = child.groupBy("host", "template", "tenth").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("like_n"), F.sum("labelled").alias("like_labelled"), F.sum("good").alias("like_good"))
        node = like.groupBy("host", "template").agg(F.sum("c").alias("kids"), F.sum("like_n").alias("visits"))
        like, node = cut(like), cut(node.withColumn("c", F.col("kids")))
        kids = child.count()
        child = attach(child, like, {"host": "host", "template": "template", "tenth": "tenth"}, "c", kids)
        child = cut(attach(cut(child), node, {"host": "host", "template": "template"}, "c", kids))
        others, others_good = F.col("like_labelled") - F.col("labelled"), F.col("like_good") - F.col("good")
        both = F.col("like_good") / F.nullif(F.col("like_labelled"), F.lit(0))
        off = F.abs(F.col("good") / F.nullif(F.col("labelled"), F.lit(0)) - others_good / F.nullif(others, F.lit(0)))
        alike = (F.col("tenth") >= 0) & (others >= evidence) & (off <= z * F.sqrt(both * (1 - both) * (1 / F.nullif(F.col("labelled"), F.lit(0)) + 1 / F.nullif(others, F.lit(0)))))
        name = F.when((F.col("kids") >= many) & (F.col("kids") > spread * F.col("visits")), "*").when(alike, F.concat(F.lit("~"), "tenth")).otherwise(F.col("seg"))
        child = cut(child.withColumn("name", F.concat("template", F.lit("/"), name)))
        grown = child.groupBy("host", "name").agg(*sums, F.max("purity").alias("purity"), F.sum("rows").alias("paths"), F.count(F.lit(1)).alias("c"))
        grown = cut(grown.select("host", "name", purer.alias("purity"), "paths", "c"))
        child = attach(child.select("host", "template", "seg", "name", "rows"), grown, {"host": "host", "name": "name"}, "c", child.count())
        live = attach(live.drop("paths", "purity"), cut(child), {"host": "host", "template": "template", "seg": "seg"}, "rows", total)
        live, at = loop.put(live.drop("template", "seg").withColumnRenamed("name", "template")), at + 1
    return loop.done(finished)


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: tuple = RULES, prior_weight: float = 10.0, least_purity: float = 0.5) -> DataFrame:
    """Judge every page's url.

    ``labels`` (label_id, good): what is known of pages by the last number in their path; null labels are unknown, and
    an id with several labels is good only if all are.
    A rule decides if one fits. Else the page's template does (``template_tree``, over all segments of the paths): a page
    is blocked where the template's smoothed share of good pages is under ``least_purity``. Empty segments don't count.

    Returns page_id, host, path, rule, verdict, template, purity. A null url has empty host and path, no rule, and the
    verdict of the empty host's root. Rows that repeat are separate rows; an empty table gives no rows; without labels
    every template has purity 1. Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    number = F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1)
    p = cut(p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v"), parts.alias("parts"), number.try_cast("bigint").alias("_id")))
    # The number stands in the parts: pages of one host and path share it.
    shapes = cut(p.groupBy("host", "parts").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_id")))
    uses = shapes.where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("c"))
    known = labels.where("label_id is not null and good is not null").groupBy(F.col("label_id").cast("long").alias("label_id")).agg(F.min(F.col("good").cast("int")).alias("g"))
    known = cut(uses.join(known, F.col("_id") == F.col("label_id"), "left").select(F.col("_id").alias("_k"), "g", "c"))
    numbered = shapes.where("_id is not null")
    numbered = attach(numbered, known, {"_id": "_k"}, "c", shapes.count()).unionByName(shapes.where("_id is null").withColumn("g", F.lit(None).cast("int")))
    labelled = F.when(F.col("g").isNotNull(), F.col("n")).otherwise(F.lit(0))
    shapes = cut(numbered.select("host", "parts", "n", labelled.alias("labelled"), (labelled * F.coalesce("g", F.lit(0))).alias("good")))
    tree = template_tree(shapes, prior_weight=prior_weight)
    p = attach(p, tree.select("host", "parts", "template", "purity", "n"), {"host": "host", "parts": "parts"}, "n", p.count())
    verdict = F.coalesce("_v", F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
