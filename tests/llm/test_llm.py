"""The corpus operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhani.llm import dedup_blocks, jaccard, langid, mixing, packing, sharding, token_files, url_templates
from lekhani.llm.encoding import Encoder
from lekhani.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, bin int, name string"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota", "zeta", "mu", "nu"]


def _rows():
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = [(i, t, "en", "s1", 1) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "\n ", 3), "en", None, 1) for i, t in enumerate(base[:3])]
    rows += [(200 + i, t + " tail", "en", "s2", 1) for i, t in enumerate(base[:4])]
    rows += [(300, None, None, None, None), (301, "", "en", "s3", 0), (302, " \t\n", "en", "s3", 0), (303, "one two", "en", "s1", 1), (304, "One two", "de", "s1", 1)]
    rows += [(305, text(3000), "en", "s2", 1), (0, base[0], "en", "s1", 1), (None, "lost id", "en", "s1", 1)]
    return [(*x, "h", 5, "n") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for x in _rows():
        want.setdefault(norm(x[1]), []).append(x[0])
    for bucket in (F.xxhash64, lambda u: F.pmod(F.xxhash64(u), F.lit(3))):
        got = dedup_blocks.exact_dedup(docs, block_bytes=64, bucket=bucket).collect()
        assert len(got) == len(_rows())
        by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
        for r in got:
            ids = by[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in got) == len(want)
    assert dedup_blocks.drop_exact(docs).count() == len(want)
    assert dedup_blocks.exact_dedup(none).count() == 0


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(_rows())
    assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) <= mine[0]["target"] + 1e-6 <= 3 * mine[0]["source_size"] + 1e-5
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_shards(docs, none):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(_rows())
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))
    assert all(r["size"] == len(next(x[1] or "" for x in _rows() if x[0] == r["doc_id"]).encode()) + 1 for r in got if r["doc_id"])
    assert sharding.shard(none).count() == 0


def test_shards_tell_sources_with_one_prefix_apart(spark):
    rows = [(i, f"text {i:04d}", "en", f"commoncrawl-{2023 + i % 2}") for i in range(64)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], set()).add(r["doc_id"] % 2)
    assert sorted(map(len, by.values())) == [1, 1, 1, 1]


@pytest.mark.parametrize("share", [80, 85])
def test_signatures_lose_no_link(share):
    plan, rng, r = jaccard.Plan(share), np.random.default_rng(2), random.Random(2)
    for _ in range(1500):
        s = r.choice([1, 5, 6, 7, 9, 12, 13, 14, 16, 20, 33, 60, 150])
        u = np.unique(rng.integers(0, 2**64, 2 * s + 4, dtype=np.uint64))
        rng.shuffle(u)
        a, b = u[:s], np.concatenate([u[r.randint(0, s // 6) : s], u[s : s + r.randint(0, max(1, s // 6))]])
        a, b = np.sort(a), np.sort(b)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= share * (len(a) + len(b) - both):
            x, y = plan.signatures(a), plan.signatures(b)
            assert any(c == d and len(np.intersect1d(p, q)) >= max(m, n) for c, m, p in x for d, n, q in y)


def _near(rows, n, share):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets, root = [sh(x[1]) for x in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(rows):
        k = find(i)
        least[k] = min([v for v in (least.get(k), x[0]) if v is not None], default=None)
    return sorted(((x[0], len(sets[i]), least[find(i)]) for i, x in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard(docs, none, block):
    got = jaccard.jaccard_components(docs, few=2 if block == 2 else 16, block=block, leaders=1)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == _near(_rows(), 4, 85)
    assert jaccard.jaccard_components(none).count() == 0


def test_encoder_is_exact():
    r = random.Random(3)
    parts = ["a", "B", "é", "́", " ", "  ", "\n", "\t", "\xa0", "!", "'s", "'", "12", "ß", "中", "\x1c", "<|endoftext|>", "  \n", "word", "***"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(tokenizer(name))
        want = e.tok.encode_batch(texts, add_special_tokens=False)
        assert all(list(a) == b.ids for a, b in zip(e.batch(texts), want, strict=True))


@pytest.mark.parametrize(("name", "ids"), [("byte_bpe_50k.json", [505, 220, 50256, 734]), ("word_bpe_49k.json", [637, 49407, 1237])])
def test_added_tokens_are_the_librarys(name, ids):
    from tokenizers import Tokenizer

    fresh, r = Tokenizer.from_file(tokenizer(name)), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "<|EndOfText|>", " ", "\n", "a", "word", "é", "'s", "!"]
    texts = ["one <|endoftext|> two", *["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)]]
    got = [x.tolist() for x in Encoder(tokenizer(name)).batch(texts)]
    assert got[0] == ids
    assert got == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


def test_token_files(docs, none):
    e = Encoder(tokenizer("word_bpe_49k.json"))
    got = sorted(token_files.round_trip(docs, tokenizer("word_bpe_49k.json")).collect(), key=lambda r: r["start"])
    assert len(got) == len(_rows())
    assert [r["doc_id"] for r in got] == sorted((x[0] for x in _rows()), key=lambda i: (i is not None, i))
    at, text = 0, {x[0]: x[1] or "" for x in _rows()}
    for r in got:
        ids = np.append(e.batch([text[r["doc_id"]]])[0], 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.round_trip(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_language(spark, none):
    r = random.Random(6)
    text = {"aa": "the of and to in that with", "bb": "der die und nicht ein ist mit"}
    rows = [(i, " ".join(r.choice(text[k].split()) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "12 !", None), (902, "", "bb")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(x["lang_pred"] == x["lang"] for x in got if x["doc_id"] < 900)
    assert all(x["lang_pred"] == "und" and x["score"] == 0 for x in got if x["doc_id"] >= 900)
    assert all(0 <= x["score"] <= 1 for x in got)
    assert langid.identify(none).count() == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://blog.example.com/en/2", "http://x.com", "http://a.net/es/3?q", "http://org.org/p/9#x", None, "nothing", "http://b.net/fr", "http://a.net/es/3?q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(9, False)], "label_id long, good boolean")
    got = {r["page_id"]: r for r in url_templates.filter_urls(pages, labels).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["www.example.com/en/", "example.com/en/", None, "net/es/", None, None, None, None, "net/es/"]
    assert [got[i]["verdict"] for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[5]["host"], got[5]["path"], got[0]["host"]) == ("", "", "www.example.com")
    assert url_templates.filter_urls(pages.where("page_id < 0"), labels).count() == 0
