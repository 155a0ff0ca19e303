"""Joins that split hot keys, and names by rank."""

import pytest

from lekhani.llm.common import attach, cut, ranks


@pytest.mark.parametrize("most", [100_000, 3])
def test_attach_is_a_join(spark, most):
    rows = [(i, "hot") for i in range(4000)] + [(i, f"k{i % 7}") for i in range(100)] + [(1, None), (2, None), (3, "unknown")]
    a = cut(spark.createDataFrame(rows, "i long, k string"))
    b = cut(spark.createDataFrame([("hot", 1, 4000), *((f"k{j}", j, 14) for j in range(7)), (None, 9, 2)], "k string, v long, n long"))
    got = attach(a, b, {"k": "k"}, "n", len(rows), most=most)
    assert got.columns == ["i", "k", "v"]
    want = {"hot": 1, **{f"k{j}": j for j in range(7)}, None: 9}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, k, want[k]) for i, k in rows if k in want], key=repr)


def test_ranks(spark):
    units = spark.createDataFrame([(i * 7 % 101, i % 3 + 1) for i in range(101)], "u long, t long").repartition(5)
    assert [r["name"] for r in ranks(units, ["u"]).orderBy("u").collect()] == list(range(101))
    rows = ranks(units, ["u"], "t").orderBy("u").collect()
    at = 0
    for r in rows:
        assert r["name"] == at
        at += r["t"]
    assert ranks(units.limit(0), ["u"]).count() == 0
