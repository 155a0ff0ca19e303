"""Facts of the transliteration engine on small inputs."""

import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhani.functions.text import SYLLABLE, bounded_distance, collapse_vowels, deletes
from lekhani.operators import align, decode, em, evaluate, fuzzy, suggest, summary, variants
from lekhani.sources import corpus as src


@pytest.mark.parametrize(("word", "parts"), [("नमस्ते", ["न", "म", "स्ते"]), ("अग", ["अ", "ग"]), ("क्ष", ["क्ष"]), ("कृपया", ["कृ", "प", "या"]), ("क्", ["क्"]), ("क a", ["क", " ", "a"]), ("१२", ["१", "२"]), ("", []), ("काठमाडौं", ["का", "ठ", "मा", "डौं"])])
def test_syllables(word, parts):
    assert re.findall(SYLLABLE, word) == parts


def test_alignment_by_lengths():
    assert align.spans(2, 1) == [(0, 2)]
    assert [n for _, n in align.spans(1, 2)] == [0, 1]
    assert sum(n for _, n in align.spans(7, 6)) == 7


def test_em_prefers_what_is_seen(spark):
    pairs = spark.createDataFrame([("nama", "नम")] * 3 + [("namaste", "नमस्ते")], "roman string, dev string")
    p = {(r["a"], r["chunk"]): r["p"] for r in em.train(pairs, iterations=8).collect()}
    assert p["न", "na"] > p.get(("न", "n"), 0)
    assert p["म", "ma"] > p.get(("म", "m"), 0)


def test_posteriors_against_all_cuts():
    p = {("A", "a"): 0.5, ("A", "ab"): 0.25, ("B", "bc"): 0.5, ("B", "c"): 0.125}
    z, use = em.posteriors("abc", ["A", "B"], p)
    assert z == pytest.approx(0.5 * 0.5 + 0.25 * 0.125)
    assert use["A", "a"] == pytest.approx(0.25 / z)


TINY = ({"k": [("क", 1.0)], "ka": [("का", 0.5), ("क", 0.7)], "a": [("अ", 0.1)]}, {"क": 1.0, "का": 2.0, "अ": 0.5}, {"क": 1.0, "का": 1.0, "अ": 1.0}, {"क": 0.0, "का": 0.0, "अ": 0.0}, {}, {}, {})


def test_beam_is_exhaustive_on_short_words():
    model = decode.Model(*TINY)
    got = decode.decode(["ka", "", "é", "KA", "kz"], 5, model)
    assert [g[0] for g in got[0]] == ["क", "का", "कअ"]
    assert got[1:3] == [[], []]
    assert got[3] == got[0]
    assert got[4] == []
    assert decode.decode([], 5, model) == []


def plain_decode(roman, k, tables, config):
    """The search state by state."""
    reverse, start, unigram, backoff, bigram, trigram, trigram_backoff = tables

    def fluency(before, last, a):
        if last is None:
            return start.get(a, 12.0)
        if a not in unigram or last not in backoff:
            return 15.0
        two = bigram.get((last, a), backoff[last] + unigram[a])
        if before is None:
            return min(two, 25.0)
        return min(trigram.get((before, last, a), trigram_backoff.get((before, last), 0.0) + two), 30.0)

    states, best = [(0.0, (), 0, 0.0, 0.0)], {}
    for _ in range(config.rounds):
        grown = {}
        for score, path, at, emit, lm in states:
            if at == len(roman):
                dev = "".join(path)
                if dev not in best or score < best[dev][0]:
                    best[dev] = (score, emit, lm, len(path))
                continue
            before, last = (None, None, *path)[-2:]
            for to in range(at + 1, min(len(roman), at + 5) + 1):
                for a, w in reverse.get(roman[at:to], ()):
                    e, f = emit + w, lm + fluency(before, last, a)
                    s, key = e + config.lm_weight * f, (to, (*path, a))
                    if key not in grown or s < grown[key][0]:
                        grown[key] = (s, key[1], to, e, f)
        states = sorted(grown.values())[: config.beam]
    return [(dev, e, f, n) for _, dev, e, f, n in sorted((s, dev, e, f, n) for dev, (s, e, f, n) in best.items())[:k]]


@pytest.mark.parametrize("beam", [2, 7, 64])
def test_decoding_in_arrays_is_the_plain_search(beam):
    r = random.Random(beam)
    aks = ["क", "का", "ख", "अ", "गा", "ग"]
    weight = lambda: r.choice([0.25, 0.5, 0.5, 1.0, 1.5, 3.25])
    letters = "abk"
    chunks = [x for n in (1, 2, 3) for x in map("".join, product(letters, repeat=n))]
    for _ in range(12):
        tables = (
            {c: sorted(((a, weight()) for a in r.sample(aks, r.randint(1, 4))), key=lambda x: (x[1], x[0])) for c in r.sample(chunks, 14)},
            {a: weight() for a in aks[:4]}, {a: weight() for a in aks[:5]}, {a: weight() for a in aks[:5]},
            {(a, b): weight() for a in aks for b in aks if r.random() < 0.4}, {(a, b, c): weight() for a in aks for b in aks for c in aks if r.random() < 0.2}, {(a, b): weight() for a in aks for b in aks if r.random() < 0.4},
        )
        model, config = decode.Model(*tables), decode.Config(beam=beam, lm_weight=r.choice([1.0, 0.5]))
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(25)]
        assert decode.decode(words, 6, model, config) == [plain_decode(w, 6, tables, config) for w in words]


def test_sums_of_batches_are_those_of_each_pair():
    r, rng = random.Random(8), np.random.default_rng(8)
    keys = [(a, c) for a in "ABC" for n in (1, 2, 5) for c in map("".join, product("xy", repeat=n))]
    p = rng.random(len(keys))
    place = {k: i for i, k in enumerate(keys)}
    for m, n in ((1, 1), (3, 2), (6, 3), (2, 3)):
        pairs = [("".join(r.choice("xy") for _ in range(m)), [r.choice("ABC") for _ in range(n)]) for _ in range(20)]
        ids = np.array([[[[place.get((a, w[i : i + k]), -1) if i + k <= m else -1 for k in range(1, 6)] for i in range(m)] for a in aks] for w, aks in pairs])
        z, use = em.sums(ids, p)
        want, total = [em.posteriors(w, aks, dict(zip(keys, p, strict=True))) for w, aks in pairs], np.zeros(len(keys))
        assert np.allclose(z, [x for x, _ in want])
        for _, d in want:
            for k, v in d.items():
                total[place[k]] += v
        assert np.allclose(use, total)


def test_large_models_are_joined_with_the_same_result(spark, monkeypatch):
    pairs = spark.createDataFrame([("nama", "नम")] * 3 + [("namaste", "नमस्ते"), ("ka", "क"), ("kamala", "कमला"), ("KA", "क"), ("x", "")], "roman string, dev string")
    ask = lambda df: {(r["a"], r["chunk"]): round(r["p"], 9) for r in df.collect()}
    want = ask(em.train(pairs, iterations=3))
    z = {r["roman"]: round(r["log_z"], 9) for r in em.likelihoods(align.clean(pairs), align.seed_emissions(align.seeds(pairs))).collect()}
    monkeypatch.setattr(em, "MOST_ROWS", 1)
    assert ask(em.train(pairs, iterations=3)) == want
    assert {r["roman"]: round(r["log_z"], 9) for r in em.likelihoods(align.clean(pairs), align.seed_emissions(align.seeds(pairs))).collect()} == z
    assert em.train(pairs.where("roman = ''")).count() == 0
    few = ask(em.train(pairs, iterations=2, limit=1))
    assert {a for a, _ in few} == {"क"}


def test_model_is_checked(spark):
    one = lambda *rows: spark.createDataFrame([(a, 1.0) for a in rows], "a string, w double")
    two = spark.createDataFrame([("क", "का", 1.0)], "a string, b string, w double")
    emission = spark.createDataFrame([("क", "k", 1.0)], "a string, chunk string, p double")
    lm = {"start": one("क", "का"), "unigram": one("क", "का"), "backoff": one("क", "का"), "bigram": two}
    assert summary.valid(emission, lm)
    assert not summary.valid(emission, lm | {"unigram": one()})
    assert not summary.valid(emission, lm | {"backoff": one("क")})
    assert not summary.valid(spark.createDataFrame([("ग", "g", 1.0)], "a string, chunk string, p double"), lm)


def brute_rewrites(word):
    """All rewrites in order."""
    out = {}

    def walk(at, written, cost):
        if at == len(word):
            out[written] = min(cost, out.get(written, cost))
            return
        walk(at + 1, written + word[at], cost)
        for a, b, c in variants.RULES:
            if word.startswith(a, at) and (len(word) > 2 or a not in variants.NOT_SHORT):
                walk(at + len(a), written + b, cost + c)

    walk(0, "", 0)
    return sorted(out.items(), key=lambda x: (x[1], -len(x[0]), x[0]))


def test_variants(spark):
    rows = variants.expand(spark.createDataFrame([("namaste",), ("malaai",), ("maya",), ("ic",), ("k-a_l",)], "roman string"), most=16).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r["roman"], []).append((r["variant"], r["penalty"]))
    assert by["namaste"][0] == ("namaste", 0)
    assert variants.rewrites("iii", 6) == brute_rewrites("iii")[:6]
    assert variants.rewrites("", 6) == [("", 0)]
    r = random.Random(5)
    for _ in range(150):
        word = "".join(r.choice("aiueow-k") for _ in range(r.randint(1, 7)))
        assert variants.rewrites(word, 6) == brute_rewrites(word)[:6]
    assert "malai" in dict(by["malaai"])
    assert {"maaya", "maayaa"} <= dict(by["maya"]).keys()
    assert "iic" not in dict(by["ic"])
    assert "kal" in dict(by["k-a_l"])


def test_fuzzy_and_distances(spark):
    words = spark.createDataFrame([("raam", "राम"), ("xyzzy", "क")], "variant string, dev string")
    got = fuzzy.match(spark.createDataFrame([("ram",), ("rm",)], "roman string"), words).collect()
    assert {(r["roman"], r["dev"], r["distance"]) for r in got} == {("ram", "राम", 0), ("rm", "राम", 1)}
    row = spark.range(1).select(collapse_vowels(F.lit("kaaAAb")).alias("c"), bounded_distance(F.lit("kal"), F.lit("xyz"), 2).alias("d"), deletes(F.lit("ab")).alias("x"), deletes(F.lit("")).alias("e")).first()
    assert row["c"] == "kaAb"
    assert row["d"] is None
    assert sorted(row["x"]) == ["", "a", "ab", "b"]
    assert row["e"] == [""]


def test_distance_is_over_all_variants_of_a_found_word(spark):
    words = spark.createDataFrame([("raaamxy", "राम"), ("ramx", "राम"), ("kkkkkk", "ओम")], "variant string, dev string")
    got = fuzzy.match(spark.createDataFrame([("raaaamx",), ("om",), ("kk",)], "roman string"), words)
    assert {(r["roman"], r["dev"]): r["distance"] for r in got.collect()} == {("raaaamx", "राम"): 0}
    short = spark.createDataFrame([("om", "ओम")], "variant string, dev string")  # found by its native form, two deletions from nothing
    assert fuzzy.match(spark.createDataFrame([("ox",)], "roman string"), short).first()["distance"] == 1


def test_index_upkeep_is_the_index_at_once(spark):
    a = spark.createDataFrame([("ram", "राम"), ("raam", "राम"), ("ram", "राम")], "variant string, dev string")
    b = spark.createDataFrame([("ram", "राम"), ("raama", "राम"), ("ka", "का")], "variant string, dev string")
    first, known = fuzzy.add_variants(None, None, a)
    more, fresh = fuzzy.add_variants(first, known, b)
    whole, _ = fuzzy.add_variants(None, None, a.unionByName(b))
    assert sorted(map(tuple, first.unionByName(more).collect())) == sorted(map(tuple, whole.collect()))
    assert {tuple(r) for r in fresh.collect()} == {("raama", "राम"), ("ka", "का")}


def test_suggest_takes_any_case_and_context(spark):
    lex = spark.createDataFrame([("Nepal", "नेपाल"), ("nepal", "नेपाली")], "roman string, dev string")
    learned = spark.createDataFrame([("xyzzy", "क")], "variant string, dev string")
    pre = spark.createDataFrame([("zzz", "क", 5)], "prefix string, dev string, frequency long")
    ask = lambda q, **more: [(r["dev"], r["score"]) for r in suggest.suggest(spark.createDataFrame([(q,)], "roman string"), lexicon=lex, learned=learned, learned_prefixes=pre, model=None, **more).orderBy("rank").collect()]
    assert ask("NEPAL") == [("नेपाल", 300), ("नेपाली", 300)]
    assert ask("nepal", context=spark.createDataFrame([("नेपाली", 20)], "dev string, boost long")) == [("नेपाली", 320), ("नेपाल", 300)]
    assert ask("") == []


def test_suggest_without_model(spark):
    lex = spark.createDataFrame([("nepal", "नेपाल")], "roman string, dev string")
    learned = spark.createDataFrame([("nepaal", "नेपाल")], "variant string, dev string")
    pre = spark.createDataFrame([("nepal", "नेपालि", 5)], "prefix string, dev string, frequency long")
    got = suggest.suggest(spark.createDataFrame([("nepal",)], "roman string"), lexicon=lex, learned=learned, learned_prefixes=pre, model=None)
    assert [(r["dev"], r["score"]) for r in got.orderBy("rank").collect()] == [("नेपाल", 300), ("नेपालि", 185)]
    assert suggest.as_json(got).first()["suggestions"] == '["नेपाल","नेपालि"]'


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", "x", "s"), ("b", "y", "s")], "roman string, dev string, source string")
    ranked = spark.createDataFrame([("a", "q", 1), ("a", "x", 2)], "roman string, dev string, rank int")
    out = evaluate.outcomes(cases, ranked)
    assert {(r["roman"], r["top1"], r["top5"], r["rr"]) for r in out.collect()} == {("a", 0, 1, 0.5), ("b", 0, 0, 0.0)}
    ci = {r["metric"]: (r["low"], r["high"]) for r in evaluate.bootstrap(out, resamples=50).collect()}
    assert all(a <= b for a, b in ci.values())
    assert (evaluate.draws(np.arange(3), 42) != evaluate.draws(np.arange(3), 43)).all()
    dev = spark.createDataFrame([(1, 0, [1.0, 0.0], False), (1, 1, [0.0, 3.0], True), (2, 0, [2.0, 0.0], True), (2, 1, [0.0, 1.0], False)], "case_id int, pos int, f array<double>, is_target boolean")
    assert evaluate.tune(dev, [[0.5, 1.0], [0.5, 1.0]])[1] == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"english word": "ram", "native word": "राम"}\n\nbad\n', encoding="utf-8")
    (tmp_path / "a.tsv").write_text("# note\nstation\tस्टेशन|स्टेसन\n", encoding="utf-8")
    assert [tuple(r)[:2] for r in src.read_pairs(spark, str(tmp_path / "a.jsonl")).collect()] == [("ram", "राम")]
    assert src.read_pairs(spark, str(tmp_path / "a.tsv")).first()["targets"] == ["स्टेशन", "स्टेसन"]
    with pytest.raises(Exception, match="malformed"):
        src.read_pairs(spark, str(tmp_path / "a.jsonl"), strict=True).collect()
    src.write_weights(str(tmp_path / "w.json"), (1.0, 2.0, 0.0, 0.5))
    assert src.read_weights(str(tmp_path / "w.json")) == (1.0, 2.0, 0.0, 0.5)
    assert src.read_weights(str(tmp_path / "none.json")) == src.WEIGHTS
