"""Near copies: hashes of words, components, and one document of each group."""

import random

import numpy as np
import pytest

from lekhani.llm import components, jaccard
from lekhani.llm.hashing import words


def complementary(n):
    x = "a"
    while len(x) < n:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_a_polynomial_confuses_have_other_hashes(n):
    a, b = complementary(n)
    assert not len(np.intersect1d(jaccard.shingles(f"{a} x y z", 4), jaccard.shingles(f"{b} x y z", 4)))


def test_word_hashes_depend_on_the_bytes_only():
    r = random.Random(1)
    some = ["".join(r.choice("ab\0é") for _ in range(n)).encode() for n in (1, 2, 3, 7, 8, 9, 16, 40) for _ in range(60)]
    data = b" ".join(some)
    ends = np.cumsum([len(x) + 1 for x in some]) - 1
    got = words(data, ends - [len(x) for x in some], ends)
    assert len(set(got.tolist())) == len(set(some))
    assert dict(zip(some, got.tolist(), strict=True)) == {x: int(words(x, np.array([0]), np.array([len(x)]))[0]) for x in some}


def test_complementary_words_are_not_linked(spark):
    a, b = complementary(1024)
    docs = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()} == {(1, 1), (2, 2)}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (7, None)]
    root = {n: n for x in links for n in x if n is not None and None not in x}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x, y in links:
        if x is not None and y is not None:
            p, q = sorted((find(x), find(y)))
            root[q] = p
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for x in links if None not in x and x[0] != x[1] for n in x}
    assert got == {(n, find(n)) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


SCHEMA = "doc_id long, text string, __tag int, name string, bin int, root long, c long"


def test_one_of_each_group_stays(spark):
    r = random.Random(3)
    base = [" ".join(f"w{r.randint(0, 999)}" for _ in range(60)) for _ in range(6)]
    near = lambda t, k: t + f" tail{k}"
    rows = [
        (1, base[0]), (1, near(base[0], 1)),  # one doc_id, near texts
        (None, base[1]), (None, near(base[1], 1)),  # no doc_id
        (5, base[2]), (5, base[2]), (6, near(base[2], 1)),  # rows that repeat
        (9, base[3]), (8, near(base[3], 1)), (7, near(base[3], 2)),
        (20, None), (21, ""), (22, " \n"), (23, base[4]),
        (30, "one two three"), (31, "One  two\tthree"), (31, "other words"),
    ]
    docs = spark.createDataFrame([(i, t, k, "n", 1, 2, 3) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = jaccard.drop_near(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect())
    assert kept == sorted([(False, 1), (True, 0), (False, 5), (False, 7), (False, 20), (False, 21), (False, 22), (False, 23), (False, 30), (False, 31)])
    assert jaccard.drop_near(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(25_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w1", "x1", 200)), (3, "y" * 1_000_000), (4, "z" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[3][0] == 1
    assert got[1][0] == len({tuple(long.split()[i : i + 4]) for i in range(24_997)})
