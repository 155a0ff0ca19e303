"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from lekhani.llm import ann

SCHEMA = "vec_id long, embedding array<double>, rep long, v int, list string"


def brute(rows, q, k=10):
    """The k nearest other rows of a query's vector, as (distance, vec_id)."""
    v = next(np.array(x) for i, x in rows if i == q)
    return sorted((float(np.sqrt(((np.array(x) - v) ** 2).sum())), i) for i, x in rows if i != q)[:k]


def test_all_lists_give_the_exact_answer(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(400 + i, x[0].tolist()) for i in range(120)]
    good += [(100, x[100].tolist())] * 3 + [(7, x[7].tolist())] * 2  # rows that repeat, a query among them
    rows = [*good, (1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0] * 3), (1400, [None] * 16), (None, x[1].tolist())]
    e = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    got = ann.search(e, F.col("vec_id") % 100 == 0, first=10**6, eps=1e6, block=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert sorted(by) == [0, 100, 200, 300, 400, 500]
    for q, found in by.items():
        want = brute(good, q)
        assert [i for _, i in found] == [i for _, i in want]
        assert np.allclose([d for d, _ in found], [d for d, _ in want], atol=1e-9)
    assert ann.search(e.where("vec_id < 0"), F.lit(True)).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(e, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 1.414214)]


def test_recall_as_shipped(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((2000, 32)), rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] * 2 + rng.standard_normal((3000, 32)) * 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 5000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & by[q])
    assert hit / 2500 >= 0.9


def test_limits_abandon_candidates_and_lose_few(monkeypatch):
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((50, 64))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    limits = np.sort(d, axis=1)[:, 10]
    looked = []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: looked.append(len(keys[0])) or real(keys))
    a, i, score = ann.scan(x, np.arange(3000), q, limits, np.full(50, 10), turn)
    assert sum(looked) < 0.05 * 50 * 3000  # of all distances so many are worked out to the end
    want = np.argsort(d, axis=1)[:, :10]
    assert sum(len(set(i[a == k].tolist()) & set(want[k].tolist())) for k in range(50)) >= 0.95 * 500
    assert np.allclose(score, d[a, i])
