"""Expectation-maximisation of how syllables are written."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import cut, spread
from .align import CHUNK, clean, seed_emissions, seeds

#: Rows of a model that are sent to every task: syllables and chunks bound them. Larger models are joined instead.
MOST_ROWS = 5_000_000


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df`` has at most ``most`` rows; no more than one row beyond is counted."""
    most = MOST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def posteriors(roman: str, aks: list[str], p: dict[tuple[str, str], float]) -> tuple[float, dict[tuple[str, str], float]]:
    """Likelihood of a pair over all ways to cut the letters into chunks, and the expected use of each (syllable, chunk)."""
    m, n = len(roman), len(aks)
    arcs = [[(i, k, q) for i in range(m) for k in range(1, min(CHUNK, m - i) + 1) if (q := p.get((a, roman[i : i + k]), 0.0)) > 0] for a in aks]
    front = [[0.0] * (m + 1) for _ in range(n + 1)]
    front[0][0] = 1.0
    for j in range(n):
        for i, k, q in arcs[j]:
            front[j + 1][i + k] += front[j][i] * q
    z = front[n][m]
    if not 0 < z < float("inf"):
        return 0.0, {}
    out: dict = defaultdict(float)
    back = [0.0] * (m + 1)
    back[m] = 1.0
    for j in range(n - 1, -1, -1):
        now = [0.0] * (m + 1)
        for i, k, q in arcs[j]:
            tail = q * back[i + k]
            now[i] += tail
            if tail and front[j][i]:
                out[aks[j], roman[i : i + k]] += front[j][i] * tail / z
        back = now
    return z, out


class Emissions:
    """A model as arrays: its (syllable, chunk) pairs in order, and the share of each."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.a, self.chunk = rows["a"].to_pylist(), rows["chunk"].to_pylist()
        order = sorted(range(len(self.a)), key=lambda i: (self.a[i], self.chunk[i]))
        self.a, self.chunk = [self.a[i] for i in order], [self.chunk[i] for i in order]
        self.p = rows["p"].to_numpy()[order].astype(float)
        self.place = {k: i for i, k in enumerate(zip(self.a, self.chunk, strict=True))}

    def frame(self, spark: SparkSession, p: np.ndarray, name: str = "p") -> DataFrame:
        """Rows a, chunk and a number each, where it is above 0."""
        some = np.flatnonzero(p > 0)
        table = pa.table({"a": pa.array([self.a[i] for i in some], pa.string()), "chunk": pa.array([self.chunk[i] for i in some], pa.string()), name: pa.array(p[some], pa.float64())})
        return spark.createDataFrame(table)


def arcs_of(pairs: DataFrame, model: Emissions) -> DataFrame:
    """Pairs with what their sums need, looked up once: m letters, n syllables, and for each syllable, place and chunk
    length the place of the emission in the model (-1: none), as 4-byte integers. Pairs of one shape stand together."""
    place = pairs.sparkSession.sparkContext.broadcast(model.place)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = place.value.get
        for f in frames:
            out = []
            for roman, aks in zip(f["roman"], f["aks"], strict=True):
                chunks = [[roman[i : i + k] if i + k <= len(roman) else None for k in range(1, CHUNK + 1)] for i in range(len(roman))]
                out.append(np.array([get((a, c), -1) if c else -1 for a in aks for at in chunks for c in at], "<i4").tobytes())
            yield pd.DataFrame({"roman": f["roman"], "dev": f["dev"], "m": f["roman"].str.len(), "n": f["aks"].map(len), "arcs": out})

    dealt = spread(pairs.select("roman", "dev", "aks"), "roman")
    return cut(dealt.mapInPandas(run, "roman string, dev string, m int, n int, arcs binary").sortWithinPartitions("m", "n"))


def sums(ids: np.ndarray, p: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Likelihoods of pairs of one shape over all ways to cut the letters, and the expected use of each emission.

    ids: (pairs, syllables, letters, chunk lengths) -> places in ``p``, -1 for none. All pairs advance together.
    """
    size, n, m, most = ids.shape
    q = np.append(p, 0.0)[ids]
    front = np.zeros((n + 1, size, m + 1))
    front[0, :, 0] = 1
    lengths = range(1, min(most, m) + 1)
    for j in range(n):
        for k in lengths:
            front[j + 1][:, k:] += front[j][:, : m + 1 - k] * q[:, j, : m + 1 - k, k - 1]
    z = front[n][:, m].copy()
    z[~(z < np.inf)] = 0
    if not count:
        return z, None
    share = np.divide(1.0, z, out=np.zeros_like(z), where=z > 0)
    back, use = np.zeros((size, m + 1)), np.zeros(q.shape)
    back[:, m] = share
    for j in range(n - 1, -1, -1):
        now = np.zeros((size, m + 1))
        for k in lengths:
            tail = q[:, j, : m + 1 - k, k - 1] * back[:, k:]
            now[:, : m + 1 - k] += tail
            use[:, j, : m + 1 - k, k - 1] = front[j][:, : m + 1 - k] * tail
        back = now
    return z, np.bincount(ids.ravel() + 1, use.ravel(), len(p) + 1)[1:]


def _shapes(f: pd.DataFrame, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, ids) of the pairs of each shape, no more at once than ``most`` places."""
    for (m, n), rows in f.groupby(["m", "n"]).indices.items():
        step = max(1, most // (m * n * CHUNK))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            ids = np.frombuffer(b"".join(f["arcs"].iloc[some]), "<i4").reshape(len(some), n, m, CHUNK)
            yield some, ids


def _used(arcs: DataFrame, p: np.ndarray) -> DataFrame:
    """id, c: expected uses, summed in each task first."""
    shared = arcs.sparkSession.sparkContext.broadcast(p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shared.value))
        for f in frames:
            for _, ids in _shapes(f):
                total += sums(ids, shared.value)[1]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "c": total[some]})

    return arcs.select("m", "n", "arcs").mapInPandas(run, "id long, c double").groupBy("id").agg(F.sum("c").alias("c"))


def _vector(used: DataFrame, size: int) -> np.ndarray:
    got, out = used.toArrow(), np.zeros(size)
    out[got["id"].to_numpy()] = got["c"].to_numpy()
    return out


def _joined(pairs: DataFrame, emission: DataFrame) -> DataFrame:
    """Pairs with the emissions that they can use, joined on (a, chunk): for models too large to be sent to tasks."""
    at = pairs.withColumn("id", F.monotonically_increasing_id())
    at = cut(at.select("id", "roman", "dev", "aks"))
    each = at.select("id", "roman", F.explode(F.array_distinct("aks")).alias("a")).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("roman"))))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.length("roman") - F.col("i") + 1))))
    each = each.select("id", "a", F.substring("roman", F.col("i"), F.col("k")).alias("chunk")).distinct()
    known = each.join(emission.select("a", "chunk", "p"), ["a", "chunk"]).groupBy("id").agg(F.collect_list(F.struct("a", "chunk", "p")).alias("known"))
    return at.join(known, "id")


def _from_joined(rows: DataFrame, schema: str, out) -> DataFrame:
    """``out`` (roman, dev, likelihood, uses) -> rows of ``schema`` for each pair, by its own emissions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for roman, dev, aks, known in zip(f["roman"], f["dev"], f["aks"], f["known"], strict=True):
                got += out(roman, dev, *posteriors(roman, list(aks), {(x["a"], x["chunk"]): x["p"] for x in known}))
            yield pd.DataFrame(got, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.select("roman", "dev", "aks", "known").mapInPandas(run, schema)


def expected(pairs: DataFrame, emission: DataFrame) -> DataFrame:
    """Expected counts a, chunk, c over all pairs: summed in each task first, then by key."""
    if not small(emission):
        each = _from_joined(_joined(pairs, emission), "a string, chunk string, c double", lambda roman, dev, z, use: [(*k, v) for k, v in use.items()])
        return each.groupBy("a", "chunk").agg(F.sum("c").alias("c"))
    model = Emissions(emission.select("a", "chunk", "p").toArrow())
    return model.frame(pairs.sparkSession, _vector(_used(arcs_of(pairs, model), model.p), len(model.p)), "c")


def likelihoods(pairs: DataFrame, emission: DataFrame) -> DataFrame:
    """roman, dev, log_z: the logarithm of each pair's likelihood; pairs that can't be cut are left out."""
    schema = "roman string, dev string, log_z double"
    if not small(emission):
        return _from_joined(_joined(pairs, emission), schema, lambda roman, dev, z, use: [(roman, dev, log(z))] if z > 0 else [])
    model = Emissions(emission.select("a", "chunk", "p").toArrow())
    shared = pairs.sparkSession.sparkContext.broadcast(model.p)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for some, ids in _shapes(f):
                z = sums(ids, shared.value, False)[0]
                part = f.iloc[some[z > 0]]
                yield pd.DataFrame({"roman": part["roman"], "dev": part["dev"], "log_z": np.log(z[z > 0])})

    return arcs_of(pairs, model).mapInPandas(run, schema)


def maximise(counts: DataFrame, prior: DataFrame, old: DataFrame, smoothing: float = 0.05) -> DataFrame:
    """New shares (c + s * prior) / (total + s); syllables without counts keep the old ones."""
    total = counts.groupBy("a").agg(F.sum("c").alias("t"))
    new = counts.where("c > 0").join(total, "a").join(prior, "chunk").select("a", "chunk", ((F.col("c") + smoothing * F.col("prior")) / (F.col("t") + smoothing)).alias("p"))
    return new.unionByName(old.join(total.select("a"), "a", "left_anti").select("a", "chunk", "p"))


def priors(counts: DataFrame) -> DataFrame:
    """Share of each chunk among all seeds: chunk, prior."""
    whole = counts.agg(F.sum("n")).first()[0]
    return counts.groupBy("chunk").agg((F.sum("n") / F.lit(float(whole or 1))).alias("prior"))


def limited(pairs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pairs (in order of roman, dev) that training takes; pairs it leaves out don't count."""
    return clean(pairs).select("roman", "dev").orderBy("roman", "dev").limit(most)


def train(pairs: DataFrame, *, iterations: int = 12, smoothing: float = 0.05, seeded: bool = True, limit: int | None = None) -> DataFrame:
    """(roman, dev) -> a, chunk, p. Without ``seeded`` every seeded pair starts from 1. ``limit``: as ``limited``.

    What the pairs can use is looked up once; then only the vector of shares goes out and the vector of counts comes
    back each round. Models of over ``MOST_ROWS`` rows are joined and maximised as tables instead.
    """
    if limit is not None:
        pairs = cut(limited(pairs, limit))
    ready = cut(spread(clean(pairs).select("roman", "dev", "aks"), "roman"))
    counts = cut(seeds(ready.select("roman", "dev")))
    start = seed_emissions(counts) if seeded else counts.select("a", "chunk", F.lit(1.0).alias("p"))
    spark = ready.sparkSession
    if not small(counts):
        prior, now = cut(priors(counts)), cut(start)
        for _ in range(iterations):
            now = cut(maximise(expected(ready, now), prior, now, smoothing))
        return now
    if counts.isEmpty():
        return start
    model = Emissions(start.toArrow())
    _, of = np.unique(np.array(model.a, object), return_inverse=True)
    share = {r["chunk"]: r["prior"] for r in priors(counts).collect()}
    prior = np.array([share[c] for c in model.chunk])
    arcs, p = arcs_of(ready, model), model.p
    for _ in range(iterations):
        c = _vector(_used(arcs, p), len(p))
        total = np.bincount(of, c)[of]
        p = np.where(total > 0, np.where(c > 0, (c + smoothing * prior) / (total + smoothing), 0.0), p)
    return model.frame(spark, p)
