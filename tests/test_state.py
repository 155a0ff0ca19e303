"""State between sessions, streams, and views of a model."""

import pytest
from pyspark.sql import functions as F

from lekhani.engine import Engine
from lekhani.operators import align, summary
from lekhani.plans.runtime import numbered
from lekhani.sources import state
from lekhani.streaming.learn import SCHEMA, learn_context


def test_engine_learns_and_keeps(spark, tmp_path):
    lexicon = spark.createDataFrame([("nepal", "नेपाल")], "roman string, dev string")
    path = str(tmp_path / "user")
    one = Engine(spark, lexicon=lexicon, path=path)
    assert one.suggest_json("") == "[]"
    assert one.suggest_json("nepal") == '["नेपाल"]'
    one.confirm([("ram", "राम"), ("", "क"), ("ram", "राम"), ("raam", "राम")])
    one.save()
    two = Engine(spark, lexicon=lexicon, path=path)
    assert {(r["roman"], r["dev"], r["n"]) for r in two.tables["pairs"].collect()} == {("ram", "राम", 2), ("raam", "राम", 1)}
    assert [(r["prev"], r["dev"], r["n"]) for r in two.tables["context"].collect()] == [("राम", "राम", 2)]
    assert [(r["dev"], r["score"]) for r in two.suggest(["ram"]).collect()] == [("राम", 183)]
    assert [(r["dev"], r["score"]) for r in one.suggest(["ram"]).collect()] == [("राम", 193)]  # after itself twice


def test_half_a_snapshot_does_not_count(spark, tmp_path):
    path, t = str(tmp_path / "s"), spark.range(1)
    assert state.load(spark, path, ["t"]) is None
    assert [state.save(spark, path, {"t": spark.range(n)}) for n in (1, 2, 3)] == [1, 2, 3]
    t.write.parquet(f"{path}/v4/t")
    assert state.load(spark, path, ["t"])["t"].count() == 3
    assert state.load(spark, path, ["t", "other"]) is None
    assert state.save(spark, path, {"t": spark.range(5)}) == 5
    assert state.load(spark, path, ["t"])["t"].count() == 5


def test_places(tmp_path, monkeypatch):
    monkeypatch.delenv("LEKHANI_DATA_DIR", raising=False)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").touch()
    places = [str(tmp_path / p) for p in ("a", "b", "c")]
    assert state.resolve("x", places=places) == f"{places[1]}/x"
    assert state.resolve("y", places=places) == f"{places[2]}/y"
    monkeypatch.setenv("LEKHANI_DATA_DIR", places[1])
    assert state.resolve("x", places=places[:1]) == f"{places[1]}/x"


def test_context_stream_goes_on(spark, tmp_path):
    folder, keep, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    row = lambda u, t, p, d: (u, t, p, "r", d)
    spark.createDataFrame([row(1, 0, 1, "b"), row(1, 0, 0, "a"), row(2, 0, 0, "z")], SCHEMA).write.parquet(folder)
    assert {tuple(r) for r in learn_context(spark, folder, keep, out).collect()} == {("a", "b", 1)}
    spark.createDataFrame([row(1, 1, 0, "c"), row(2, 1, 0, "z")], SCHEMA).write.mode("append").parquet(folder)
    assert {tuple(r) for r in learn_context(spark, folder, keep, out).collect()} == {("a", "b", 1), ("b", "c", 1), ("z", "z", 1)}


@pytest.mark.parametrize(("m", "n"), [(1, 1), (3, 5), (7, 6), (8, 4), (9, 2), (24, 12)])
def test_least_cost(m, n):
    want = m + 1.5 * (n - m) if m <= n else n + 0.3 * (m - n) if m <= 2 * n else 1.3 * n + 1.5 * (m - 2 * n)
    assert align.least_cost(m, n) == pytest.approx(want)
    assert len(align.spans(m, n)) == n


def test_views_of_a_model(spark):
    chunks = spark.createDataFrame([("a",), ("ka",), ("krya",), ("",), ("sTe",), ("abcdefg",)], "c string").select("c", summary.pack_chunk(F.col("c")).alias("p"))
    got = {r["c"]: (r["p"], r["u"]) for r in chunks.select("c", "p", summary.unpack_chunk(F.col("p")).alias("u")).collect()}
    assert all(got[c][1] == c for c in ("a", "ka", "krya", ""))
    assert got["sTe"][1] == "se"
    assert got["abcdefg"][1] == "abcde"
    assert got["ka"][0] == 10 + (2 << 26)
    e = spark.createDataFrame([("A", "a", 0.5), ("A", "b", 0.5), ("B", "c", 1.0)], "a string, chunk string, p double")
    assert [(r["a"], r["chunk"], r["rank"]) for r in summary.top_emissions(e, 1).orderBy("a").collect()] == [("A", "a", 1), ("B", "c", 1)]


def test_numbered(spark):
    df = spark.range(50).select(F.format_string("%03d", F.col("id")).alias("s"))
    assert [r["p"] for r in numbered(df.repartition(7), "s", "p").orderBy("s").collect()] == list(range(50))
