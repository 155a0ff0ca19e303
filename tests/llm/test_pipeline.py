"""The pipeline's stages on a small folder of tables, against plain Python."""

import random
import re

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, _w string, name string"


def _rows():
    r = random.Random(12)
    vocabulary = {k: ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(400)] for k, letters in (("en", "etaoinshrdlu"), ("fr", "aeiouéèçlmrst"))}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    rows = []
    for i in range(240):
        lang = ("en", "fr")[i % 2]
        rows.append((i, text(lang, r.randint(20, 120)), lang, f"s{i % 3}" if i % 7 else None))
    rows += [(1000 + i, rows[i][1].replace(" ", "\n ", 2), rows[i][2], "s1") for i in range(12)]  # exact copies
    rows += [(2000 + i, rows[100 + i][1] + " tail", rows[100 + i][2], "s2") for i in range(12) if len(rows[100 + i][1].split()) > 40]  # near copies
    rows += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, "12 34 !", "en", "s0"), (5, rows[5][1], "fr", "s2"), (None, text("en", 50), "en", "s0")]
    rows.append((4000, text("en", 20_000), "en", "s1"))
    return [(*x, 1, 2, "w", "n") for x in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(_rows(), COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = _rows()
    letters = [(x[0], x[1]) for x in rows if x[1] and re.search(r"[^\W\d_]", x[1])]
    assert sorted(kept["language_id"], key=repr) == sorted(letters, key=repr)
    seen = {}
    for i, t in sorted(letters, key=lambda x: (x[0] is None, x[0] or 0)):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(i for i, _ in kept["exact_dedup"] if i is not None) == sorted(i for i in seen.values() if i is not None)
    assert len(kept["exact_dedup"]) == len(seen)
    near = {i for i, _ in kept["near_dedup"]}
    assert near == {i for i, _ in kept["exact_dedup"] if i is None or not 2000 <= i < 3000}
    assert {i for i, _ in kept["mix_sources"]} <= near
    assert max(kept["mix_sources"].count(x) for x in set(kept["mix_sources"])) <= 3


def test_run_gives_whole_sequences(spark, folder):
    by = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
