"""Beam decoding of roman queries into native words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..plans.runtime import cut, spread
from .em import MOST_ROWS, small


@dataclass(frozen=True)
class Config:
    beam: int = 64
    heaviest: float = 8.0  # emissions from here on are noise
    per_chunk: int = 16
    lm_weight: float = 1.0
    rounds: int = 32


def reverse_index(emission: DataFrame, config: Config = Config()) -> DataFrame:
    """chunk -> its lightest syllables: chunk, a, w, rank."""
    w = emission.select("chunk", "a", (-F.log("p")).alias("w")).where(F.col("w") < config.heaviest)
    order = Window.partitionBy("chunk").orderBy("w", "a")
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.per_chunk)


def lattice_chunks(queries: DataFrame) -> DataFrame:
    """roman, pos, len, chunk: every chunk of up to five letters."""
    at = queries.select("roman", F.explode(F.sequence(F.lit(0), F.length("roman") - 1)).alias("pos"))
    at = at.select("roman", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(5), F.length("roman") - F.col("pos")))).alias("len"))
    return at.withColumn("chunk", F.substring("roman", F.col("pos") + 1, F.col("len")))


def lattice(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Edges: roman, pos, len, a, w for every chunk of up to five letters."""
    return lattice_chunks(queries).join(index, "chunk").select("roman", "pos", "len", "a", "w")


class Model:
    """What a task needs to decode, as arrays: syllables by number in code point order, weights by sorted number."""

    def __init__(self, reverse: dict, start: dict, unigram: dict, backoff: dict, bigram: dict, trigram: dict, trigram_backoff: dict):
        """reverse: chunk -> [(syllable, weight), ...], lightest first; the others by syllable, or tuple of syllables."""
        every = {a for x in reverse.values() for a, _ in x} | {*start, *unigram, *backoff}
        every |= {a for x in (bigram, trigram, trigram_backoff) for k in x for a in k}
        self.syllables = sorted(every)
        at = {a: i for i, a in enumerate(self.syllables)}
        self.reverse = {c: (np.array([at[a] for a, _ in x], np.int64), np.array([w for _, w in x])) for c, x in reverse.items()}
        one = lambda d, other: np.array([d.get(a, other) for a in self.syllables], float)
        self.start, self.unigram, self.backoff = one(start, 12.0), one(unigram, np.nan), one(backoff, np.nan)
        n = len(self.syllables)
        pair = lambda d: np.array([at[k[0]] * n + at[k[1]] for k in d], np.int64)
        two, three, back = pair(bigram), pair(trigram), pair(trigram_backoff)
        self.pairs = np.unique(np.concatenate([two, three, back]))
        self.bigram, self.context = np.full(len(self.pairs), np.nan), np.zeros(len(self.pairs))
        self.bigram[np.searchsorted(self.pairs, two)] = list(bigram.values())
        self.context[np.searchsorted(self.pairs, back)] = list(trigram_backoff.values())
        key = np.searchsorted(self.pairs, three) * n + np.array([at[k[2]] for k in trigram], np.int64)
        order = np.argsort(key)
        self.triples, self.trigram = key[order], np.array(list(trigram.values()), float)[order]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 where it isn't."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def fluency(self, before: np.ndarray, last: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Weights of syllables ``a`` after ``last`` after ``before`` (-1: none), with back-off and bounds."""
        n = len(self.syllables)
        two = self._find(self.pairs, last * n + a)
        w = np.where(two >= 0, self.bigram[two] if len(self.pairs) else np.nan, np.nan)
        two_w = np.where(np.isnan(w), self.backoff[last] + self.unigram[a], w)
        context = self._find(self.pairs, before * n + last)
        back = np.where(context >= 0, self.context[context] if len(self.pairs) else 0.0, 0.0)
        three = self._find(self.triples, np.where(context >= 0, context * n + a, -1))
        three_w = np.where(three >= 0, self.trigram[three] if len(self.triples) else np.nan, back + two_w)
        out = np.where(before < 0, np.minimum(two_w, 25.0), np.minimum(three_w, 30.0))
        out = np.where(np.isnan(self.unigram[a]) | np.isnan(self.backoff[last]), 15.0, out)
        return np.where(last < 0, self.start[a], out)


def _reachable(queries: DataFrame, emission: DataFrame, lm: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The part of a model that ``queries`` can use: chunks that they hold, and syllables of those."""
    chunks = lattice_chunks(queries).select("chunk").distinct()
    emission = cut(emission.join(chunks, "chunk", "left_semi"))
    known = cut(emission.select("a").distinct())
    out = {}
    for k, t in lm.items():
        for c in [c for c in ("a", "b", "c") if c in t.columns]:
            t = t.join(known.select(F.col("a").alias(c)), c, "left_semi")
        out[k] = cut(t)
    return emission, out


def load(spark: SparkSession, emission: DataFrame, lm: dict[str, DataFrame], config: Config = Config(), queries: DataFrame | None = None) -> Model:
    """Model tables as arrays. lm: start, unigram, backoff, bigram, trigram, trigram_backoff.

    Tables are checked for size before they come to the driver. Of a larger model only what ``queries`` can reach is
    taken; if that is still over ``MOST_ROWS`` rows a table, decode fewer queries at a time.
    """
    if not all(small(t) for t in (emission, *lm.values())):
        if queries is None:
            raise ValueError(f"a model table has over {MOST_ROWS} rows: give the queries to decode, for the part they use")
        emission, lm = _reachable(queries, emission, lm)
        if not all(small(t) for t in (emission, *lm.values())):
            raise ValueError(f"what these queries reach is over {MOST_ROWS} rows: decode fewer at a time")
    reverse: dict = {}
    index = reverse_index(emission, config).withColumn("w", F.round("w", 6))  # as precise as the language model's
    rows = index.toArrow().to_pylist()
    for r in sorted(rows, key=lambda r: (r["chunk"], r["rank"])):
        reverse.setdefault(r["chunk"], []).append((r["a"], r["w"]))
    names = {"start": 1, "unigram": 1, "backoff": 1, "bigram": 2, "trigram": 3, "trigram_backoff": 2}
    got = {}
    for k, n in names.items():
        t = lm[k].toArrow()
        keys = [t[c].to_pylist() for c in "abc"[:n]]
        got[k] = dict(zip(keys[0] if n == 1 else zip(*keys, strict=True), t["w"].to_pylist(), strict=True))
    return Model(reverse, **got)


def decode(romans: list[str], k: int, model: Model, config: Config = Config()) -> list[list[tuple[str, float, float, int]]]:
    """The ``k`` best (dev, emit, lm, syllables) of each query; none for one that isn't ASCII.

    States advance by one syllable a round; the best ``beam`` of a query's round go on, those that have read the whole
    query among them, which are taken out a round later. Ties by path. All queries advance together as arrays: paths of
    a round are numbered in order, by the number of the path before and the last syllable, so equal numbers are equal
    paths and their order is that of the syllables.
    """
    lower = [r.translate({c: c + 32 for c in range(65, 91)}) if r and r.isascii() else "" for r in romans]
    n, size = np.array([len(r) for r in lower], np.int64), len(model.syllables)
    # Edges of each place of each query, by length of the chunk, lightest first.
    offset = np.concatenate([[0], np.cumsum(n)])
    to, syllable, weight, many = [], [], [], np.zeros(int(offset[-1]) + 1, np.int64)
    none = (np.empty(0, np.int64), np.empty(0))
    for i, r in enumerate(lower):
        for at in range(len(r)):
            for end in range(at + 1, min(len(r), at + 5) + 1):
                a, w = model.reverse.get(r[at:end], none)
                if len(a):
                    to.append(np.full(len(a), end, np.int64))
                    syllable.append(a)
                    weight.append(w)
                    many[offset[i] + at + 1] += len(a)
    edge = np.cumsum(many)
    to, syllable, weight = (np.concatenate([z, *x]) for z, x in ((none[0], to), (none[0], syllable), (none[1], weight)))

    q = np.flatnonzero(n > 0)
    at, path, emit, lm, score = np.zeros(len(q), np.int64), q.copy(), np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    before, last = np.full(len(q), -1), np.full(len(q), -1)
    links: list[tuple[np.ndarray, np.ndarray]] = []  # of each round's paths: the path before, the last syllable
    best: list[dict[str, tuple]] = [{} for _ in romans]
    for _ in range(config.rounds):
        done = np.flatnonzero(at == n[q])
        if len(done):
            some, back = np.unique(path[done], return_inverse=True)
            parts, here = [], some
            for up, a in reversed(links):
                parts.append(a[here])
                here = up[here]
            text = ["".join(model.syllables[a] for a in x) for x in zip(*[p.tolist() for p in parts[::-1]], strict=True)]
            for i, b in zip(done.tolist(), back.tolist(), strict=True):
                got, dev = best[q[i]], text[b]
                if dev not in got or score[i] < got[dev][0]:
                    got[dev] = (float(score[i]), float(emit[i]), float(lm[i]), len(links))
        go = np.flatnonzero(at < n[q])
        place = offset[q[go]] + at[go]
        count = edge[place + 1] - edge[place]
        if not count.sum():
            break
        by = np.repeat(go, count)
        ends = np.cumsum(count)
        e = np.arange(int(ends[-1])) + np.repeat(edge[place] - (ends - count), count)
        a = syllable[e]
        new_emit, new_lm = emit[by] + weight[e], lm[by] + model.fluency(before[by], last[by], a)
        s = new_emit + config.lm_weight * new_lm
        keys, number = np.unique(path[by] * size + a, return_inverse=True)
        links.append((keys // size, keys % size))
        order = np.lexsort((np.arange(len(by)), s, to[e], number))
        first = np.ones(len(order), bool)
        x, y = number[order], to[e][order]
        first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        stay = order[first]
        whose = q[by][stay]
        order = np.lexsort((new_lm[stay], new_emit[stay], to[e][stay], number[stay], s[stay], whose))
        stay, whose = stay[order], whose[order]
        rank = np.arange(len(whose)) - np.searchsorted(whose, whose)
        stay = stay[rank < config.beam]
        before, last = last[by][stay], a[stay]
        q, at, path, emit, lm, score = q[by][stay], to[e][stay], number[stay], new_emit[stay], new_lm[stay], s[stay]
    out = []
    for got in best:
        found = sorted((x, dev, e, f, m) for dev, (x, e, f, m) in got.items())
        out.append([(dev, e, f, m) for _, dev, e, f, m in found[: max(1, k)]])
    return out


def decode_all(queries: DataFrame, model: Model, k: int = 8, config: Config = Config(), together: int = 256) -> DataFrame:
    """roman -> roman, dev, emit, lm, syllables, rank; ``together`` queries at a time as arrays."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in range(0, len(f), together):
                some = f["roman"].iloc[x : x + together].tolist()
                rows = [(q, *c, i) for q, found in zip(some, decode(some, k, shared.value, config), strict=True) for i, c in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=["roman", "dev", "emit", "lm", "syllables", "rank"])

    dealt = spread(queries.select("roman").distinct(), "roman")
    return dealt.mapInPandas(run, "roman string, dev string, emit double, lm double, syllables int, rank int")


def featured(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates with ``f``: -emit, -lm, -syllables, in lexicon."""
    known = lexicon.select(ascii_lower(F.col("roman")).alias("low"), "dev").distinct().withColumn("known", F.lit(1.0))
    x = candidates.withColumn("low", ascii_lower(F.col("roman"))).join(known, ["low", "dev"], "left").drop("low")
    return x.withColumn("f", F.array(-F.col("emit"), -F.col("lm"), -F.col("syllables").cast("double"), F.coalesce("known", F.lit(0.0)))).drop("known")


def rerank(candidates: DataFrame, lexicon: DataFrame, weights: tuple = (1.0, 1.0, 0.0, 0.0)) -> DataFrame:
    """Candidates in order of their weighted features: with rscore and new rank."""
    x = featured(candidates, lexicon)
    score = sum((F.col("f")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))
    x = x.withColumn("rscore", score)
    order = Window.partitionBy("roman").orderBy(F.col("rscore").desc(), F.col("rank"))
    return x.withColumn("new_rank", F.row_number().over(order)).select("roman", "dev", "rscore", F.col("new_rank").alias("rank"))

