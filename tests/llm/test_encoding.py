"""Token ids as the library gives them, whatever the texts."""

import random
import zlib

import numpy as np
import pytest
from test_links import complementary
from tokenizers import Tokenizer

from lekhani.llm import encoding, packing, token_files
from lekhani.llm.queries import tokenizer

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def _texts():
    r = random.Random(11)
    out = []
    for n in (1024, 2048, 4096):
        a, b = complementary(n)
        out += [a, b, f"{a} {b}", f"{b}\n{a}!"]
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "12", "<|endoftext|>", "\x00", "x" * 7, "y" * 8, "z" * 9, "w" * 31, "w" * 32, "w" * 33, "w" * 40 + "q"]
    out += ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(2000)]
    return [*out, "".join(r.choice("abcdefgh") for _ in range(1_000_000)), " ".join(str(r.random()) for _ in range(20_000)), ""]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name):
    fresh, texts = Tokenizer.from_file(tokenizer(name)), _texts()
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    e = encoding.Encoder(tokenizer(name), keep=3000)  # emptied on the way
    got = [x.tolist() for i in range(0, len(texts), 100) for x in e.batch(texts[i : i + 100])]
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_chunks_with_one_fingerprint_are_told_apart(name, monkeypatch):
    real = encoding._lanes

    def weak(*args):
        lanes, names = real(*args)
        return lanes, names % np.uint64(5)

    monkeypatch.setattr(encoding, "_lanes", weak)
    texts = _texts()[12:400]
    e = encoding.Encoder(tokenizer(name))
    want = [x.ids for x in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.batch(texts)] == want
    assert [x.tolist() for x in e.batch(texts[::-1])] == want[::-1]


ROWS = [(3, "one <|endoftext|> two"), (1, None), (2, ""), (3, "other text"), (None, "lost"), (5, "word " * 25_000), (4, complementary(2048)[0]), (6, complementary(2048)[1]), (7, "x" * 1_000_000), (3, "one <|endoftext|> two")]


def _docs(spark):
    return spark.createDataFrame([(i, t, 1, "p", 2, 3) for i, t in ROWS], "doc_id long, text string, length int, name string, part int, offset int")


def test_packed_pieces_are_the_librarys_ids(spark):
    fresh = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = [(i, np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t in ROWS]
    want = sorted(((i, a, min(1024, len(x) - a), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for i, x in ids for a in range(0, len(x), 1024)), key=repr)
    got = packing.pack(_docs(spark), tokenizer("byte_bpe_50k.json")).collect()
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=repr) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(_docs(spark).limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_files_hold_the_librarys_ids(spark):
    fresh = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids = [(i, np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in ROWS]
    got = sorted(token_files.round_trip(_docs(spark), tokenizer("word_bpe_49k.json")).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids), key=repr)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    assert token_files.round_trip(_docs(spark).limit(0), tokenizer("word_bpe_49k.json")).count() == 0
