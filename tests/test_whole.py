"""Queries on small tables against brute force where no SQL is given."""

import pytest

from lekhani.operators import decode
from lekhani.plans import queries as plans
from lekhani.sources import corpus as src

WORDS = "ka kab kad kag kal kam kan kap kar kas kat kaj mala mali malai nama namaste nepal nepali rama kamal kamala kamalama".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, " ".join(WORDS[i::3] * (i + 1)), lang, "s", 1) for i, lang in enumerate(("en", "fr", "de"))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "nepal namaste kamal")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, "ka kal mala nama kamal nepali kamalama unknown")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture
def model(monkeypatch):
    """Some syllables for each letter and pair of letters, so that words have many candidates."""
    reverse = {}
    for c, d in zip("kgdlmnprst", "कगदलमनपरसत", strict=True):
        reverse |= {c: [(d, 1.0), (d + "ा", 1.2), (d + "ि", 1.4)], c + "a": [(d + "ा", 0.3), (d, 0.9), (d + "ि", 1.1)], c + "i": [(d + "ि", 0.2), (d + "ी", 0.5)], c + "e": [(d + "े", 0.2)]}
    all_ = sorted({a for x in reverse.values() for a, _ in x})
    costs = {a: 1 + i / 64 for i, a in enumerate(all_)}
    found = decode.Model(reverse, costs, costs, dict.fromkeys(all_, 0.0), {}, {}, {})
    monkeypatch.setattr(plans, "_model", lambda spark, sf_dir: found)
    return found


def _searched(cases, grids):
    """Coordinate ascent over cases of (features, place of the target)."""

    def hits(w):
        best = [max(range(len(c)), key=lambda i: (sum(a * b for a, b in zip(w, c[i], strict=True)), -i)) if c else None for c, _ in cases]
        return sum(t is not None and b == t for b, (_, t) in zip(best, cases, strict=True))

    now, best = [1.0] * 4, hits([1.0] * 4)
    for _ in range(6):
        for k, grid in enumerate(grids):
            take = now[k]
            for x in grid:
                got = hits([*now[:k], x, *now[k + 1 :]])
                if got > best:
                    best, take = got, x
            now[k] = take
    return (*now, best)


def test_weights_are_searched_on_the_decoders_candidates(spark, tables, model):
    word = {r["roman"]: r["dev"] for r in src.corpus(spark, tables).collect()}
    cases = []
    for roman in sorted({r["roman"] for r in src.query(spark, tables).collect()} & word.keys()):
        found = decode.decode([roman], 50, model, decode.Config(beam=128))[0]
        at = [x[0] for x in found]
        cases.append(([(-e, -lm, -float(n), float(dev == word[roman])) for dev, e, lm, n in found], at.index(word[roman]) if word[roman] in at else None))
    low = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
    want = _searched(cases, [low, low, [-1.0, -0.5, -0.25, -0.1, 0.0, 0.1, 0.25, 0.5, 1.0], [0.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0]])
    assert max(len(c) for c, _ in cases) == 50
    assert tuple(plans.QUERIES["mert_grid"](spark, tables).first()) == want


def test_the_rankers_ten_best_are_evaluated(spark, tables, model):
    word = {r["roman"]: r["dev"] for r in src.corpus(spark, tables).collect()}
    ranks = {(r["roman"], r["dev"]): r["rank"] for r in plans._suggest(spark, tables, 20).collect()}
    got = {r["roman"]: r for r in plans.QUERIES["suggest_hits"](spark, tables).collect()}
    assert got.keys() == {"ka", "kal", "mala", "nama", "kamal", "nepali", "kamalama"}
    at = {q: ranks.get((q, word[q]), 99) for q in got}
    for q, r in got.items():
        assert (r["top1"], r["top5"], r["top10"]) == (at[q] <= 1, at[q] <= 5, at[q] <= 10)
        assert r["rr"] == pytest.approx(1 / at[q] if at[q] <= 10 else 0, abs=1e-6)
    total = plans.QUERIES["suggest_mrr"](spark, tables).first()
    assert total["mrr"] == pytest.approx(sum(r["rr"] for r in got.values()) / len(got), abs=1e-5)


def test_a_target_in_tenth_place_counts(spark, tables, model, monkeypatch):
    def tenth(queries, *, count, **_):
        words = [("ka", "क" if i == 10 else str(i), i) for i in range(1, count + 1)]
        return spark.createDataFrame(words, "roman string, dev string, rank int")

    monkeypatch.setattr(plans.ranking, "suggest", tenth)
    r = next(r for r in plans.QUERIES["suggest_hits"](spark, tables).collect() if r["roman"] == "ka")
    assert (r["top1"], r["top5"], r["top10"], r["rr"]) == (0, 0, 1, 0.1)
