"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, running, words

WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> with ``target``: shares of the whole by weight, each at most ``most`` times its size.

    Sources by code point, null last, get the weights in turn. Excess over a limit goes to the others by weight; the
    fixed point has one level L with target = min(limit, weight * L), found from sums in ascending limit/weight.
    One row per source: the windows see no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    s = s.withColumn("_cap", F.col("source_size") * float(most)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    asc = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = asc.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    lighter = F.coalesce(F.sum("_w").over(below), F.lit(0.0))
    s = s.withColumn("_at", F.row_number().over(asc)).withColumn("_level", (F.sum("source_size").over(everything) - capped) / (F.sum("_w").over(everything) - lighter))
    first = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_at", "_level"))).over(everything)
    s = s.withColumn("_l", first["_level"])
    return s.select("source", "source_size", F.round(F.least("_cap", F.col("_w") * F.col("_l")), 6).alias("target"))


def rates(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Rows with source, target, weight, words -> with ``want``: copies wanted of a document of each weight.

    Within a source, copies are in proportion to weight and at most ``most``, so that their words are the target: there
    is one level L with want = min(most, weight * L), found from sums in descending weight. One row per source and
    distinct weight: the windows see no documents.
    """
    down = Window.partitionBy("source").orderBy(F.col("weight").desc())
    heavier = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum(F.col("weight") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    x = sizes.withColumn("_at", F.row_number().over(down)).withColumn("_level", F.when(lighter > 0, (F.col("target") - float(most) * heavier) / lighter))
    first = F.min(F.when(F.col("_level") * F.col("weight") <= float(most), F.struct("_at", "_level"))).over(Window.partitionBy("source"))
    want = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce(first["_level"] * F.col("weight"), F.lit(float(most)))))
    return x.withColumn("want", want).drop("_at", "_level")


def bits(size: Column) -> Column:
    """The number of binary digits of a size: the default weight of a document."""
    return F.length(F.bin(size)).cast("double")


def mix(docs: DataFrame, *, weights: tuple = WEIGHTS, most: int = 3, seed: str = "mix", rounds: int = 3, weight: Column | None = None, piece: int = 4096) -> DataFrame:
    """How often each document goes into a mix of its sources.

    Each document is wanted a number of times, at most ``most``, in proportion to its ``weight``, by default the binary
    digits of its number of words: so longer texts, which carry longer contexts, have up to some times the odds of
    shorter ones. ``weight`` should have few distinct values; null and negative weights count as 0.
    The whole part is certain; for the fraction p, documents are ordered by (u / (1 - u)) / (p / (1 - p)), u a uniform
    number from the MD5 of seed and doc_id, and taken in this order until the source's words are reached. The size
    that is fixed is the number of words: the document that crosses the target is taken if that ends nearer to it,
    else passed by, and ``rounds - 1`` more passes go on with those that can still bring the sum nearer. So a source
    misses its target by less than half of its largest document, and by far less where small ones are left.

    Returns doc_id, text_hash, source, size, source_size, target, copies, taken (= copies * size).
    Null text has size 0; null sources form one source; null doc_ids share one u; rows that repeat are separate rows,
    and which of them is taken doesn't show; an empty table gives no rows. Other columns are ignored.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    size = words(F.col("text"))
    w = bits(size) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    d = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), u.alias("_u"), w.alias("_w"), F.xxhash64("text").alias("text_hash")))

    kinds = cut(d.groupBy("source", "_w").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    per = kinds.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("_n"))
    goal = source_targets(per.select("source", "source_size"), weights, most)
    per = per.select(F.col("source").alias("_s"), "_n").join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    per = cut(per)  # one row per source
    want = kinds.select(F.col("source").alias("_s"), F.col("_w").alias("weight"), "words", F.col("n").alias("_k")).join(per, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    want = rates(want, most).drop("words")
    total = d.count()
    x = attach(d, cut(want), {"source": "source", "_w": "weight"}, "_k", total)
    x = x.withColumn("_whole", F.floor("want")).withColumn("_p", F.col("want") - F.col("_whole"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    x = x.withColumn("_q", F.when(F.col("_p") > 0, odds))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_n") / piece))
    x = x.withColumn("_b", F.coalesce(F.floor(F.col("_q") / (1 + F.col("_q")) * pieces), F.lit(-1)))
    x = x.withColumn("_extra", F.lit(0).cast("long"))
    keep = ["doc_id", "text_hash", "source", "size", "source_size", "target", "_whole", "_q", "_b", "_n", "_extra"]
    x = cut(x.select(*keep))
    for _ in range(rounds):
        done = x.groupBy("source").agg(F.max("target").alias("_t"), F.max("_n").alias("_m"), F.sum((F.col("_whole") + F.col("_extra")) * F.col("size")).alias("_done"))
        done = cut(done.select(F.col("source").alias("_s"), (F.col("_t") - F.col("_done")).alias("_rest"), "_m"))
        y = attach(x, done, {"source": "_s"}, "_m", total)
        fits = F.col("_q").isNotNull() & (F.col("_extra") == 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_rest"))
        y = y.withColumn("_v", F.when(fits, F.col("size")).otherwise(F.lit(0)))
        y = running(y, ["source"], "_b", ["_q", "doc_id", "size", "text_hash"], "_v", "_cum")
        nearer = (F.col("_cum") <= F.col("_rest")) | ((F.col("_cum") - F.col("size") < F.col("_rest")) & (2 * F.col("_cum") - F.col("size") < 2 * F.col("_rest")))
        x = cut(y.withColumn("_extra", F.when(fits & nearer, F.lit(1)).otherwise(F.col("_extra")).cast("long")).select(*keep))
    copies = (F.col("_whole") + F.col("_extra")).cast("long")
    return x.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; all columns as they are.

    Rows with the same doc_id and text, which exact dedup leaves none of, are all taken as often as the one taken most.
    """
    found = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("__lekhani_i"), F.col("text_hash").alias("__lekhani_h")).agg(F.max("copies").alias("__lekhani_n"))
    x = docs.withColumn("__lekhani_x", F.xxhash64("text"))
    x = x.join(found, x["doc_id"].cast("long").eqNullSafe(F.col("__lekhani_i")) & (x["__lekhani_x"] == F.col("__lekhani_h")))
    return x.withColumn("__lekhani_k", F.explode(F.sequence(F.lit(1), F.col("__lekhani_n").cast("int")))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER a AS nth,
        ((SELECT sum(source_size) FROM r)::DOUBLE - coalesce(sum(cap) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
      FROM r WINDOW a AS (ORDER BY ratio, source ASC NULLS LAST)),
t AS (SELECT source, source_size, round(least(cap, w * (SELECT arg_min(lev, nth) FROM l WHERE ratio >= lev)), 6) AS target FROM l),
c AS (SELECT d.source, length(bin(size))::DOUBLE AS weight, sum(size)::DOUBLE AS words, any_value(target) AS target, any_value(source_size) AS source_size
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, length(bin(size))),
v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC) AS nth,
        (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(weight * words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lev FROM c),
y AS (SELECT source, arg_min(lev, nth) AS lev FROM v WHERE lev * weight <= 3.0::DOUBLE GROUP BY source),
x AS (SELECT doc_id, d.source, size, source_size, target, u,
        CASE WHEN target <= 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE, coalesce(lev * length(bin(size))::DOUBLE, 3.0::DOUBLE)) END AS want
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source),
q AS (SELECT *, floor(want) AS whole, CASE WHEN want - floor(want) > 0 THEN (u / (1 - u)) / ((want - floor(want)) / (1 - (want - floor(want)))) END AS q FROM x),
e1 AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS r1 FROM q),
g1 AS (SELECT *, q IS NOT NULL AND size > 0 AND size < 2 * r1 AS ok1, sum(CASE WHEN q IS NOT NULL AND size > 0 AND size < 2 * r1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum1 FROM e1),
f1 AS (SELECT *, CASE WHEN (ok1 AND (cum1 <= r1 OR (cum1 - size < r1 AND 2 * cum1 - size < 2 * r1))) THEN 1 ELSE 0 END AS x1 FROM g1),
e2 AS (SELECT *, target - sum((whole + x1) * size) OVER (PARTITION BY source) AS r2 FROM f1),
g2 AS (SELECT *, q IS NOT NULL AND size > 0 AND x1 = 0 AND size < 2 * r2 AS ok2, sum(CASE WHEN q IS NOT NULL AND size > 0 AND x1 = 0 AND size < 2 * r2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum2 FROM e2),
f2 AS (SELECT *, CASE WHEN x1 = 1 OR (ok2 AND (cum2 <= r2 OR (cum2 - size < r2 AND 2 * cum2 - size < 2 * r2))) THEN 1 ELSE 0 END AS x2 FROM g2),
e3 AS (SELECT *, target - sum((whole + x2) * size) OVER (PARTITION BY source) AS r3 FROM f2),
g3 AS (SELECT *, q IS NOT NULL AND size > 0 AND x2 = 0 AND size < 2 * r3 AS ok3, sum(CASE WHEN q IS NOT NULL AND size > 0 AND x2 = 0 AND size < 2 * r3 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum3 FROM e3),
f3 AS (SELECT *, CASE WHEN x2 = 1 OR (ok3 AND (cum3 <= r3 OR (cum3 - size < r3 AND 2 * cum3 - size < 2 * r3))) THEN 1 ELSE 0 END AS x3 FROM g3)
SELECT doc_id, size, source_size, target, ((whole + x3) * size)::BIGINT AS taken FROM f3
"""
