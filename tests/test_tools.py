import json

import pytest

from lekhani import tools
from lekhani.operators import evaluate, summary
from lekhani.sources import artifacts
from lekhani.sources import corpus as src

PAIRS = [("ram", "राम"), ("rama", "रमा"), ("mara", "मारा"), ("kalam", "कलम"), ("kamal", "कमल"), ("nagar", "नगर"), ("nam", "नाम"), ("kam", "काम")]


def _lines(path, pairs, source=None):
    rows = [json.dumps({"english word": r, "native word": d, **({"source": source} if source else {})}, ensure_ascii=False) for r, d in pairs]
    path.write_text("\n".join(rows + ["", "not a pair"]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tools")
    train, extra = _lines(at / "train.jsonl", PAIRS[:5]), _lines(at / "extra.jsonl", [*PAIRS[5:], ("Ram", "राम"), ("r2", "र")])
    model = tools.main(["train-model", "--train", train, "--extra", extra, "--out", str(at / "model"), "--iterations", "3"], spark)
    lexicon = tools.main(["build-lexicon", "--train", train, "--extra", extra, "--out", str(at / "lexicon")], spark)
    return at, model, lexicon


def test_training_tools(spark, built):
    at, model, lexicon = built
    assert tuple(model["lines"].first()) == (10, 2) and tuple(lexicon["lines"].first()) == (10, 2)
    assert [tuple(r) for r in artifacts.load_lexicon(spark, str(at / "lexicon")).collect()] == sorted(PAIRS)
    assert lexicon["lexicon"].first()["pairs"] == 8
    emission, lm = artifacts.load_tables(spark, str(at / "model"))
    assert summary.valid(emission, lm) and model["widest"].count() == 10
    assert artifacts.load_model(spark, str(at / "none")) is None and artifacts.load_lexicon(spark, str(at / "none")) is None
    with pytest.raises(ValueError):
        artifacts.save_model(spark, str(at / "bad"), emission.limit(0), {k: t.limit(0) for k, t in lm.items()})


def test_evaluation_tools(spark, built):
    at, _, _ = built
    dev = _lines(at / "dev.jsonl", [(" RAM", "राम "), ("kalam", "कलम"), ("zzz", "नगर")], "a")
    had = ["--model", str(at / "model")]
    found = tools.main(["train-reranker", *had, "--dev", dev, "--out", str(at / "w.json"), "--lexicon", str(at / "lexicon")], spark)
    assert found["recall"].first()["hits"] == 2 and src.read_weights(str(at / "w.json"))[0] > 0
    found = tools.main(["evaluate-model", *had, "--dataset", dev], spark)
    assert [tuple(r) for r in found["hits"].collect()][-1][:2] == ("all", 3)
    assert [r["roman"] for r in found["misses"].collect()] == ["zzz"]
    engine = [*had, "--lexicon", str(at / "lexicon"), "--weights", str(at / "w.json")]
    found = tools.main(["evaluate-pairs", *engine, "--dataset", dev], spark)
    assert [tuple(r) for r in found["hits"].collect()] == [("a", 3, 2, 2)]
    several = at / "cases.tsv"
    several.write_text("# cases\nram\tक|राम\n\nkalam\tकलम\nzzz\tक\n")
    found = tools.main(["evaluate-targets", *engine, "--dataset", str(several)], spark)
    assert tuple(found["hits"].first())[:3] == (3, 2, 2) and [r["case_id"] for r in found["misses"].collect()] == [5]
    found = tools.main(["evaluate-engine", *engine, "--dataset", str(several), "--limit", "2", "--resamples", "20"], spark)
    assert tuple(found["means"].first()) == (2, 1.0, 1.0, 1.0, 1.0) and found["intervals"].count() == 4 and found["misses"].isEmpty()
    found = tools.main(["probe-model", *had, "--word", "ram"], spark)
    assert found["edges"].where("len > 4").isEmpty() and "राम" in [r["dev"] for r in found["words"].collect()]


def test_cases_by_line(spark, tmp_path):
    p = tmp_path / "bad.jsonl"
    p.write_text('{"english word": "a", "native word": "b"}\n\nnot\n')
    with pytest.raises(Exception, match="malformed line 3: not"):
        src.read_cases(spark, str(p)).collect()
    p = tmp_path / "bad.tsv"
    p.write_text("a\tb\nonly a key\n")
    with pytest.raises(Exception, match="malformed line 2"):
        src.read_cases(spark, str(p)).collect()


def test_first_of_several_targets(spark):
    cases = spark.createDataFrame([(1, "x", ["b", "c", "b"], None), (2, "x", ["d"], None), (3, "y", ["a"], "s"), (4, "x", [], "s")], "case_id long, roman string, targets array<string>, source string")
    ranked = spark.createDataFrame([("x", "a", 1), ("x", "c", 2), ("x", "b", 6)], "roman string, dev string, rank int")
    out = evaluate.case_outcomes(cases, ranked)
    assert sorted((r["case_id"], r["top1"], r["top5"], r["rr"]) for r in out.collect()) == [(1, 0, 1, 0.5), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 0, 0, 0.0)]
    assert [r["case_id"] for r in evaluate.misses(out, 2).collect()] == [2, 3]
