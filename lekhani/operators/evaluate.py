"""Ranking quality: hits, reciprocal ranks, bootstrap intervals and weight search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import numbered

_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def outcomes(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """cases (roman, dev, source) against ranked (roman, dev, rank): roman, source, top1, top5, top10, rr."""
    hit = cases.join(ranked.select("roman", "dev", "rank"), ["roman", "dev"], "left").groupBy("roman", "source").agg(F.min("rank").alias("r"))
    flag = lambda k: F.coalesce((F.col("r") <= k).cast("int"), F.lit(0)).alias(f"top{k}")
    return hit.select("roman", "source", flag(1), flag(5), flag(10), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def numbered_cases(cases: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """Cases with ``case_id``, their place by ``order`` from 1; the first ``most`` if given."""
    x = numbered(cases, order, "_place").withColumn("case_id", F.col("_place") + 1).drop("_place")
    return x if most is None else x.where(F.col("case_id") <= most)


def case_outcomes(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """cases (case_id, roman, targets array, source) against ranked (roman, dev, rank).

    case_id, roman, source, top1, top5, top10, rr by the first of the ranked words that is any of the targets.
    """
    wanted = cases.select("case_id", "roman", "source", F.explode_outer(F.array_distinct("targets")).alias("dev"))
    hit = wanted.join(ranked.select("roman", "dev", "rank"), ["roman", "dev"], "left").groupBy("case_id", "roman", "source").agg(F.min("rank").alias("r"))
    flag = lambda k: F.coalesce((F.col("r") <= k).cast("int"), F.lit(0)).alias(f"top{k}")
    return hit.select("case_id", "roman", "source", flag(1), flag(5), flag(10), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def misses(out: DataFrame, most: int = 20, *, flag: str = "top10") -> DataFrame:
    """The first ``most`` cases, by case_id, without a target among the best."""
    return out.where(F.col(flag) == 0).orderBy("case_id").limit(most).select("case_id", "roman", "source")


def rollup(out: DataFrame) -> DataFrame:
    """By source and over all (source null)."""
    return out.rollup("source").agg(F.count(F.lit(1)).alias("total"), F.sum("top1").alias("top1"), F.sum("top5").alias("top5"), F.sum("top10").alias("top10"), F.round(F.avg("rr"), 6).alias("mrr"))


def draws(i: np.ndarray, seed: int) -> np.ndarray:
    """Numbers ``i`` of the seeded 64-bit stream: each depends on its place only."""
    x = (np.uint64(seed & _ALL) + (i.astype(np.uint64) + np.uint64(2)) * np.uint64(_STEP)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(out: DataFrame, *, resamples: int = 1000, seed: int = 42, order: str = "roman") -> DataFrame:
    """95 % intervals of the mean top1, top5, top10 and rr: metric, low, high.

    Outcomes are numbered by ``order``. Draw j of resample r is number r * n + j of the stream; drawn places are counted
    for each resample, so that what is joined is (resample, place, times), in tasks of some resamples each.
    """
    spark = out.sparkSession
    n = out.count()
    if not n:
        return spark.createDataFrame([], "metric string, low double, high double")
    placed = numbered(out, order, "place")

    def draw(frames):
        for f in frames:
            for r in f["id"]:
                place, times = np.unique(draws(np.arange(r * n, (r + 1) * n), seed) % np.uint64(n), return_counts=True)
                yield pd.DataFrame({"r": r, "place": place.astype(np.int64), "times": times})

    drawn = spark.range(resamples).mapInPandas(draw, "r long, place long, times long")
    metrics = ("top1", "top5", "top10", "rr")
    means = drawn.join(placed, "place").groupBy("r").agg(*[(F.sum(F.col("times") * F.col(m)) / n).alias(m) for m in metrics])
    ends = means.agg(*[F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in metrics])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m)[0], 6).alias("low"), F.round(F.col(m)[1], 6).alias("high")) for m in metrics])).alias("x")).select("x.*")


def objective(dev: DataFrame, weights: list[tuple[float, ...]]) -> DataFrame:
    """dev (case_id, pos, f array, is_target): for each weight vector the cases whose best candidate, the first of equals, is the target."""
    tried = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in x]).alias("w")) for i, x in enumerate(weights)])
    score = F.aggregate(F.zip_with("f", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = dev.withColumn("x", F.explode(tried)).select("case_id", "pos", "f", "is_target", "x.i", "x.w").withColumn("s", score)
    best = scored.groupBy("i", "case_id").agg(F.max_by("is_target", F.struct("s", -F.col("pos"))).alias("hit"))
    return best.groupBy("i").agg(F.sum(F.col("hit").cast("int")).alias("hits"))


def tune(dev: DataFrame, grids: list[list[float]], *, passes: int = 6) -> tuple[list[float], int]:
    """Coordinate ascent from all ones: a job a coordinate; strictly better values are taken, the first of equals."""
    now = [1.0] * len(grids)
    best = {r["i"]: r["hits"] for r in objective(dev, [tuple(now)]).collect()}.get(0, 0)
    for _ in range(passes):
        before = list(now)
        for k, grid in enumerate(grids):
            tried = [tuple(x if j == k else now[j] for j in range(len(now))) for x in grid]
            got = {r["i"]: r["hits"] for r in objective(dev, tried).collect()}
            for i, x in enumerate(grid):
                if got.get(i, 0) > best:
                    best, now[k] = got[i], x
        if now == before:
            break
    return now, best
