"""Exact dedup by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Loop, attach, cut, ranks

#: Runs that are not already one plain space.
_RUNS = f"[\\x09-\\x0D][{SPACE}]*|\\x20[{SPACE}]+"


def normal(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _names_of(distinct: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Integer names of distinct units (h, unit): their places in a sort by hash and bytes.

    Returns names of the hashes that one unit has alone (h, name), and (h, unit, name) for the others, or None without
    any. So only narrow rows are sorted, and bytes decide wherever hashes can't: two names are equal only if the units are.
    """
    counted = ranks(distinct().groupBy("h").agg(F.count(F.lit(1)).alias("k")), ["h"], "k")
    several = counted.where("k > 1")
    one = counted.where("k = 1").select("h", "name")
    if several.isEmpty():
        return one, None
    found = distinct().join(several.select("h", "name"), "h")
    place = F.row_number().over(Window.partitionBy("h").orderBy("unit")) - 1
    return one, cut(found.select("h", "unit", (F.col("name") + place).alias("name")))


def exact_dedup(docs: DataFrame, *, block_bytes: int = 4096, bucket: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The class of equal texts of every row.

    The normalised text is cut into blocks of ``block_bytes``. All distinct blocks are sorted and named by their place,
    the blocks of a text become its string of names, and then distinct pairs of neighbouring names are sorted and
    named, level by level, until one name is left. (Number of blocks, last name) is the identity of a text: equal
    exactly when the texts are. Blocks are sorted by ``bucket``, a hash, then by their bytes; a weak hash costs time,
    not correctness. Names of blocks and pairs that many rows share are sent to every task, so that no task joins all
    rows of one.

    Returns doc_id, rid, keep_id, group_size, kept, text_sha256, n_bytes. Null text is the empty text. Of equal texts the
    smallest doc_id stays, null last; of rows that repeat with that doc_id, one. An empty table gives no rows.
    """
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("norm"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.substring(F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))
    clean = clean.withColumn("bin", F.col("norm").cast("binary"))
    clean = clean.withColumn("n", F.ceil(F.octet_length("bin") / block_bytes).cast("int")).withColumn("units", blocks)

    def distinct() -> DataFrame:
        # Outer, since the filter on empty arrays that the planner would add normalises the text again.
        return clean.select(F.explode_outer("units").alias("unit")).select(bucket(F.col("unit")).alias("h"), "unit").distinct()

    one, several = _names_of(distinct)
    hashes = F.transform("units", lambda u: bucket(u))
    bytes_too = F.lit(None).cast("array<binary>") if several is None else F.col("units")
    # The bytes of blocks stay behind, but where some hash can't tell two of them apart.
    start = clean.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), hashes.alias("h"), bytes_too.alias("units"))
    start = cut(start)
    each = start.select("rid", F.size("h").alias("blocks"), F.posexplode(F.arrays_zip("h", F.coalesce("units", F.array_repeat(F.lit(None).cast("binary"), F.size("h"))).alias("units"))).alias("pos", "x"))
    each = cut(each.select("rid", "blocks", "pos", "x.h", F.col("x.units").alias("unit")))
    total = each.count()
    uses = cut(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")))
    narrow = each.select("rid", "blocks", "pos", "h")
    level = attach(narrow, cut(one.join(uses, "h")), {"h": "h"}, "c", total).select("rid", "blocks", "pos", "name")
    if several is not None:
        often = several.join(each.groupBy("h", "unit").agg(F.count(F.lit(1)).alias("c")), ["h", "unit"])
        level = level.unionByName(attach(each, cut(often), {"h": "h", "unit": "unit"}, "c", total).select("rid", "blocks", "pos", "name"))

    loop, finished = Loop(docs.sparkSession), ["rid", "blocks", "name"]
    level = loop.put(level.withColumn("width", F.col("blocks")))
    while True:
        loop.add(level.where("width = 1").select(*finished))
        left = level.where("width > 1")
        if left.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = left.groupBy("rid", "blocks", "width", half.alias("pos")).agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
        pairs = cut(pairs)
        named = ranks(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")), ["a", "b"])
        level = attach(pairs, cut(named), {"a": "a", "b": "b"}, "c", pairs.count())
        level = loop.put(level.select("rid", "blocks", "pos", "name", F.expr("(width + 1) div 2").cast("int").alias("width")))
    state = loop.done(level.select(*finished))
    rows = start.select(F.col("rid").alias("_rid"), "doc_id", "text_sha256", "n_bytes")
    state = cut(state.join(rows, F.col("rid") == F.col("_rid")).drop("_rid"))

    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))
    groups = cut(state.groupBy("blocks", "name").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size")))
    out = attach(state, groups.withColumn("_c", F.col("group_size")), {"blocks": "blocks", "name": "name"}, "_c", state.count())
    return out.select("doc_id", "rid", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("_best.rid")).alias("kept"), "text_sha256", "n_bytes")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` doesn't keep; all columns as they are.

    Null text counts as empty; a null doc_id stays only where its text has no other; of rows that repeat one stays; an
    empty table gives no rows.
    """
    found = cut(exact_dedup(docs).select("doc_id", "text_sha256", "kept"))
    stay = found.where("kept").select(F.col("doc_id").alias("__lekhani_i"), F.col("text_sha256").alias("__lekhani_h"))
    x = docs.withColumn("__lekhani_sha", F.sha2(normal(F.col("text")), 256))
    x = x.join(stay, x["doc_id"].cast("long").eqNullSafe(F.col("__lekhani_i")) & (x["__lekhani_sha"] == F.col("__lekhani_h")), "left_semi")
    twice = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("k")).where("n > 1 and k")
    if not twice.isEmpty():  # rows that repeat: one of each stays
        x = x.dropDuplicates(["doc_id", "__lekhani_sha"])
    return x.drop("__lekhani_sha")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
