"""Nearest neighbours by adaptive dimension scan within the probed lists of an inverted index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, cut, small_batches


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means of a sample; a list without members keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first, ties to the first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[a : a + 4096] @ c.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, keep: np.ndarray, turn: np.ndarray, *, width: int = 8, eps: float = 2.1, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of what each query finds among ``vectors``: its ``keep`` nearest, but none farther
    than its ``limit``, the distance that is known to be near enough.

    Vectors are rotated and looked at ``width`` dimensions at a time. After d of D dimensions a candidate goes if its
    partial squared distance exceeds t * d / D * (1 + eps / sqrt(d))^2, t the query's squared limit: a test of the
    hypothesis that it is within the limit. A query without a limit gets one from a first part of the vectors.
    Distances of those that remain are taken from the vectors themselves.
    """
    size = vectors.shape[1]
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    turned, asked = vectors @ turn, queries @ turn
    steps = [(a, min(a + width, size)) for a in range(0, size, width)]
    chunk = int(max(64, min(len(ids), most // max(1, len(queries)), 16 * int(keep.max(initial=1)))))
    t = limits.astype(np.float64) ** 2
    kept: list = []
    a = 0
    while a < len(ids):
        b = min(len(ids), a + chunk)
        c = turned[a:b]
        q = np.repeat(np.arange(len(asked)), b - a)
        x = np.tile(np.arange(a, b), len(asked))
        part = np.zeros(len(q))
        dense = True
        for lo, hi in steps:
            if dense:
                u, v = asked[:, lo:hi], c[:, lo:hi]
                part += ((u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T).ravel()
            else:
                part += ((asked[q, lo:hi] - turned[x, lo:hi]) ** 2).sum(1)
            slack = (1 + eps / np.sqrt(hi)) ** 2 if hi < size else 1 + 1e-9  # the whole distance needs no test
            ok = part <= t[q] * (hi / size) * slack + 1e-9
            if dense:
                if ok.mean() < 0.3 or hi == size:
                    q, x, part, dense = q[ok], x[ok], part[ok], False
            else:
                q, x, part = q[ok], x[ok], part[ok]
            if not len(q):
                break
        if len(q):
            exact = np.sqrt(((queries[q] - vectors[x]) ** 2).sum(1))
            kept.append((q, x, exact))
            q, x, exact = (np.concatenate(z) for z in zip(*kept, strict=True))
            order = np.lexsort((ids[x], exact, q))
            q, x, exact = q[order], x[order], exact[order]
            first = np.searchsorted(q, np.arange(len(asked)))
            ok = np.arange(len(q)) - first[q] < keep[q]
            q, x, exact = q[ok], x[ok], exact[ok]
            kept = [(q, x, exact)]
            n = np.bincount(q, minlength=len(asked))
            last = np.searchsorted(q, np.arange(len(asked)), "right") - 1
            full = n >= keep
            t[full] = np.minimum(t[full], exact[last[full]] ** 2 * (1 + 1e-9) + 1e-12)
        a, chunk = b, int(max(64, most // max(1, len(asked))))
    if not kept:
        return np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0)
    q, x, exact = kept[0]
    return q, ids[x], exact


def probes_for(x: np.ndarray, centre: np.ndarray, k: int, want: float, seed: int = 13) -> int:
    """How many of the nearest lists of a query hold the share ``want`` of its ``k`` nearest, in the mean of a sample.

    In the whole, which is denser than the sample, neighbours are nearer and lie in fewer lists.
    """
    asked = x[np.random.default_rng(seed).permutation(len(x))[:400]]
    own = nearest(x, centre, 1)[:, 0]
    found = []
    for q in asked:
        d = ((x - q) ** 2).sum(1)
        near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
        order = nearest(q[None], centre, len(centre))[0]
        at = np.empty(len(centre), np.int64)
        at[order] = np.arange(len(centre))
        found.append(at[own[near]])
    every = np.sort(np.concatenate(found))
    return int(every[min(len(every) - 1, int(np.ceil(want * len(every))))]) + 1


def search(rows: DataFrame, is_query: Column, *, k: int = 10, sample: int = 20_000, most_lists: int = 2000, recall: float = 0.96, first: int = 4, eps: float = 2.1, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """The ``k`` nearest other vectors of each query by Euclidean distance, found in the lists nearest to it.

    rows: vec_id, embedding. The centres of the lists, about the square root of the vectors and at most ``most_lists``,
    are fitted on at most ``sample`` vectors with the smallest hash of vec_id; every vector is in the list of its
    nearest centre. How many lists are scanned is measured on the same sample so that they hold the share ``recall`` of
    the nearest vectors; a query scans more until they hold ``k`` others. The nearest ``first`` lists, or more until they
    hold ``k`` others, are scanned first, which gives each query a limit; the others are scanned with that limit, so
    that most candidates are abandoned after some dimensions. Lists of over ``block`` vectors are scanned in blocks, by
    blocks of queries, so that no task holds a list whole. Queries with the same vector are searched once.

    Returns query_id, rank, vec_id, score. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor those of another length than the most frequent one. Null vec_ids take no part; rows that repeat are
    candidates each, but never of their own vec_id. An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark, rows=4096)
    v = F.col("embedding").cast("array<double>")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n = sizes["d"], sizes["count"]
    base = base.where(F.size("v") == size)
    some = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(sample, 8_000_000 // size))).select("v").toPandas()
    some = np.stack(some["v"].map(np.asarray))
    centre = centroids(some, max(1, min(most_lists, round(n**0.5), len(some))))
    probes = probes_for(some, centre, k, recall)
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((size, size)))[0]

    def place(frames):
        for f in frames:
            if len(f):
                yield f.assign(list=nearest(np.stack(f["v"].map(np.asarray)), centre, 1)[:, 0])

    # Rows that repeat are one candidate with a number of times.
    single = base.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"), F.max(F.coalesce("q", F.lit(False))).alias("q"))
    placed = cut(single.mapInPandas(place, "vec_id long, v array<double>, times long, q boolean, list int"))
    held = np.zeros(len(centre), np.int64)
    for r in placed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    asked = cut(placed.where("q").select("vec_id", "v").distinct())
    # What a query must find: k others, besides the vectors that stand under its own vec_id.
    own = placed.join(asked.select(F.col("vec_id").alias("_i")).distinct(), F.col("vec_id") == F.col("_i")).groupBy("_i").agg(F.count(F.lit(1)).alias("own"))
    reps = asked.join(own, F.col("vec_id") == F.col("_i")).groupBy("v").agg(F.min("vec_id").alias("rep"), (F.max("own") + k).alias("keep"), F.count(F.lit(1)).alias("same"))

    def aim(frames):
        for f in frames:
            if not len(f):
                continue
            near = nearest(np.stack(f["v"].map(np.asarray)), centre, len(centre))
            enough = np.cumsum(held[near], axis=1) >= f["keep"].to_numpy()[:, None]
            need = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, len(centre))
            f["first"] = [x[: max(first, m)].tolist() for x, m in zip(near, need, strict=True)]
            f["rest"] = [x[max(first, m) : max(probes, m)].tolist() for x, m in zip(near, need, strict=True)]
            yield f

    aimed = cut(reps.mapInPandas(aim, "v array<double>, rep long, keep long, same long, first array<int>, rest array<int>"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "vec_id": [], "times": [], "score": []}).astype({"rep": "int64", "vec_id": "int64", "times": "int64"})
        a = a.sort_values("vec_id", kind="stable")
        at = np.arange(len(a))  # ties go to the smaller vec_id
        q, x, d = scan(np.stack(a["v"].map(np.asarray)), at, np.stack(b["v"].map(np.asarray)), b["t"].to_numpy(np.float64), b["keep"].to_numpy(np.int64), turn, eps=eps)
        return pd.DataFrame({"rep": b["rep"].to_numpy()[q], "vec_id": a["vec_id"].to_numpy()[x], "times": a["times"].to_numpy()[x], "score": d})

    def scanned(queries: DataFrame) -> DataFrame:
        """queries: rep, v, keep, t, list -> what they find in their lists."""
        queries = cut(queries)
        parts = {r["list"]: (max(1, -(-int(held[r["list"]]) // block)), -(-r["count"] // query_block)) for r in queries.groupBy("list").count().collect()}
        dealt = spark.createDataFrame([(i, *x) for i, x in parts.items()], "list int, cb int, qb int")
        dealt = F.broadcast(dealt)  # a row a list, at most most_lists
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        c = placed.join(dealt, "list").withColumn("x", F.pmod(F.xxhash64("vec_id"), F.col("cb")).cast("int")).withColumn("y", spread("qb")).select("list", "x", "y", "vec_id", "times", "v")
        q = queries.join(dealt, "list").withColumn("y", F.pmod(F.xxhash64("rep"), F.col("qb")).cast("int")).withColumn("x", spread("cb")).select("list", "x", "y", "rep", "keep", "t", "v")
        found = c.groupBy("list", "x", "y").cogroup(q.groupBy("list", "x", "y")).applyInPandas(match, "rep long, vec_id long, times long, score double")
        return found.join(F.broadcast(keeps) if few else keeps, "rep")

    keeps = cut(aimed.select("rep", "keep"))
    few = keeps.count() <= 200_000
    by_rep = Window.partitionBy("rep").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("r", F.row_number().over(by_rep)).where("r <= keep")
    near = cut(best(scanned(aimed.select("rep", "v", "keep", F.lit(float("inf")).alias("t"), F.explode("first").alias("list")))).select("rep", "vec_id", "times", "score", "keep", "r"))
    limit = near.where("r = keep").select("rep", F.col("score").alias("t"))
    later = aimed.select("rep", "v", "keep", F.explode("rest").alias("list")).join(limit, "rep", "left").withColumn("t", F.coalesce("t", F.lit(float("inf"))))
    found = best(near.select("rep", "vec_id", "times", "score", "keep").unionByName(scanned(later).select("rep", "vec_id", "times", "score", "keep")))
    found = found.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "times"))).alias("f"))  # keep each at most
    members = asked.join(reps.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("_rep")).distinct()
    found = found.join(reps.select(F.col("rep").alias("_i"), "same"), F.col("rep") == F.col("_i")).drop("_i")
    mine = attach(cut(members), cut(found), {"_rep": "rep"}, "same", n)
    # A member's own vectors go; what is left is in order, and its first k rows, times counted, are the result.
    others = mine.select("query_id", "_rep", F.filter("f", lambda x: x["vec_id"] != F.col("query_id")).alias("f"))
    each = F.flatten(F.transform(F.slice("f", 1, k), lambda x: F.array_repeat(F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")), F.least(x["times"], F.lit(k)).cast("int"))))
    out = others.select("query_id", F.posexplode(F.slice(each, 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
