"""Sharding by a k-d tree over metadata, cut at weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, ranks

DIMENSIONS = ("size", "first_doc", "source", "lang")
_EDGE = 1 << 60


@dataclass
class _Node:
    shards: int
    first: int
    bytes: int = 0
    split: tuple | None = None  # (dimension, values): left if the row's keys, so many of them, are less


def _placed(groups: DataFrame, names: DataFrame, value: str, out: str, broadcast_rows: int = 100_000) -> DataFrame:
    """``groups`` with the place of ``value`` among the distinct values of ``names``, from 0, as column ``out``; null is -1."""
    places = cut(ranks(names.toDF("_v").where("_v IS NOT NULL").distinct(), ["_v"]).withColumnRenamed("name", "_place"))
    if places.count() <= broadcast_rows:
        places = F.broadcast(places)
    x = groups.join(places, F.col(value) == F.col("_v"), "left")
    return x.withColumn(out, F.coalesce(F.col("_place").cast("long"), F.lit(-1))).drop("_v", "_place")


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(-_EDGE)), F.lit(-_EDGE)), F.lit(_EDGE))


_DIMS = [f"c{i}" for i in range(len(DIMENSIONS))]
_TIES = ["h1", "h2", "d1", "d2"]
#: Histogram rows that a job may bring to the driver, over all nodes.
_MOST_BINS = 1_000_000


def _keys(dim: Column) -> Column:
    """What rows are ordered by in a node that is cut along ``dim``: its coordinate, then the tie breakers."""
    return F.array(F.element_at(F.array(*_DIMS), dim + 1), *_TIES)


def _cut_points(rows: DataFrame, todo: list[_Node], total: int, shards: int, bins: int, slack: float, group_slack: float) -> None:
    """Find the weighted median of each node of ``todo`` along its widest dimension; all nodes in each job together.

    The median is searched by histograms of at most ``bins`` bins for each node, fewer for very many nodes, each job
    looking into the bin that holds it, until a bin's edge is near enough; only histograms come to the driver. What is
    looked for is a small table, a row a node, joined on node, so the plan doesn't grow with the nodes.
    """
    spark = rows.sparkSession
    bins = max(16, min(bins, _MOST_BINS // len(todo)))
    nodes = spark.createDataFrame([(x.first,) for x in todo], "node int")
    here = rows.join(F.broadcast(nodes), "node")  # a row a shard at most
    seen = here.groupBy("node").agg(F.sum("size").alias("b"), *[f(c).alias(f"{n}_{c}") for c in [*_DIMS, *_TIES] for n, f in (("lo", F.min), ("hi", F.max))])
    seen = {r["node"]: r for r in seen.collect()}
    wide = [max((r[f"hi_{c}"] for r in seen.values()), default=0) - min((r[f"lo_{c}"] for r in seen.values()), default=0) for c in _DIMS]
    search = {}
    for node in todo:
        r = seen.get(node.first)
        if r is None:
            continue
        node.bytes = r["b"]
        dim = max(range(len(_DIMS)), key=lambda i: ((r[f"hi_c{i}"] - r[f"lo_c{i}"]) / max(1, wide[i]), -i))
        search[node.first] = {"node": node, "dim": dim, "fixed": [], "lo": r[f"lo_c{dim}"], "hi": r[f"hi_c{dim}"], "before": 0, "want": r["b"] * (node.shards // 2) / node.shards}
    leaf = total / shards
    while search:
        spec = [(first, s["dim"], s["fixed"], s["lo"], s["hi"], max(1, -(-(s["hi"] - s["lo"] + 1) // bins))) for first, s in search.items()]
        table = spark.createDataFrame(spec, "node int, dim int, fixed array<long>, lo long, hi long, step long")
        now = rows.join(F.broadcast(table), "node").withColumn("keys", _keys(F.col("dim")))
        now = now.where(F.slice("keys", F.lit(1), F.size("fixed")) == F.col("fixed")).withColumn("x", F.element_at("keys", F.size("fixed") + 1))
        now = now.where("x >= lo AND x <= hi").withColumn("bin", F.expr("(x - lo) div step"))
        hist = now.groupBy("node", "bin").agg(F.sum("size").alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"), *[f(c).alias(f"{n}_{c}") for c in _TIES for n, f in (("l", F.min), ("h", F.max))])
        by_node: dict = {}
        for r in hist.collect():
            by_node.setdefault(r["node"], []).append(r)
        for first, s in list(search.items()):
            at, before = None, s["before"]
            for r in sorted(by_node.get(first, []), key=lambda r: r["bin"]):
                if before + r["b"] >= s["want"] or at is None:
                    at = (r, before)
                if before + r["b"] >= s["want"]:
                    break
                before += r["b"]
                at = (r, before)
            r, before = at
            level = len(s["fixed"])
            low, high = s["want"] - before, before + r["b"] - s["want"]
            near = min(abs(low), abs(high))
            last = level == len(_TIES) and r["lo"] == r["hi"]
            group_edge = level == 2 and r["lo"] == r["hi"] and near <= group_slack * leaf
            if last or group_edge or near <= slack * leaf:
                s["node"].split = (s["dim"], [*s["fixed"], r["lo"] if abs(low) <= abs(high) else r["hi"] + 1])
                del search[first]
            elif r["lo"] == r["hi"]:  # the next key decides among rows equal so far
                nxt = _TIES[level]
                s |= {"fixed": [*s["fixed"], r["lo"]], "lo": r[f"l_{nxt}"], "hi": r[f"h_{nxt}"], "before": before}
            else:
                s |= {"lo": r["lo"], "hi": r["hi"], "before": before}


def shard(docs: DataFrame, *, shards: int = 16, target_bytes: int | None = None, bins: int = 1024, slack: float = 0.001, group_slack: float = 0.005, piece: int = 4096) -> DataFrame:
    """Put each document into a leaf of a k-d tree whose leaves hold nearly equal bytes.

    A node of k leaves is cut along its widest dimension (range relative to the whole level's) where its bytes divide
    as k // 2 to the rest. Dimensions are of the group of equal texts: bytes, smallest doc_id, smallest source and
    language by their places among the distinct ones. So equal texts stay together, but where a group is so large that the leaves
    would differ by over ``group_slack`` of a leaf; then doc_id divides it. ``target_bytes``, if given, sets the number of
    shards to the whole size divided by it.

    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null). size is UTF-8 bytes plus 1; null text
    has no bytes. A null doc_id sorts first. Rows that repeat are separate rows; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    d = cut(d)
    total, n = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    groups = d.groupBy("size", "crc", "h").agg(F.min("doc_id").alias("first_doc"), F.min("source").alias("s"), F.min("lang").alias("l"), F.count(F.lit(1)).alias("copies"))
    groups = _placed(_placed(groups, d.select("source"), "s", "c2"), d.select("lang"), "l", "c3")
    groups = groups.select(F.col("size").alias("gs"), F.col("crc").alias("gc"), F.col("h").alias("gh"), _clamp(F.col("first_doc")).alias("c1"), "c2", "c3", "copies")
    rows = attach(d, cut(groups), {"size": "gs", "crc": "gc", "h": "gh"}, "copies", n)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    low = F.lit((1 << 32) - 1)
    rows = cut(rows.select("doc_id", "size", "crc", F.col("size").alias("c0"), "c1", "c2", "c3", F.shiftright("h", 32).alias("h1"), F.col("h").bitwiseAND(low).alias("h2"), F.shiftright(key, 32).alias("d1"), key.bitwiseAND(low).alias("d2")))

    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    todo = [_Node(shards, 0)] if shards > 1 and total else []
    rows = rows.withColumn("node", F.lit(0))
    while todo:
        _cut_points(rows, todo, total, shards, bins, slack, group_slack)
        grown, splits = [], []
        for node in todo:
            if node.split is None:
                continue
            half = node.shards // 2
            left, right = _Node(half, node.first), _Node(node.shards - half, node.first + half)
            splits.append((node.first, *node.split, right.first))
            grown += [x for x in (left, right) if x.shards > 1]
        table = docs.sparkSession.createDataFrame(splits, "node int, dim int, split array<long>, right int")
        x = rows.join(F.broadcast(table), "node", "left")  # a row a shard at most
        less = F.slice(_keys(F.col("dim")), F.lit(1), F.size("split")) < F.col("split")
        at = F.when(F.col("split").isNotNull() & ~less, F.col("right")).otherwise(F.col("node"))
        rows, todo = cut(x.withColumn("node", at).drop("dim", "split", "right")), grown

    out = rows.select("doc_id", "size", "crc", F.col("node").cast("int").alias("shard"))
    pieces = max(1, -(-n // (piece * shards)))
    out = out.withColumn("_b", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(pieces)))
    counts = out.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("shard", "_b").orderBy("doc_id", "crc", "size")
    out = out.join(base, ["shard", "_b"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.row_number().over(own) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
