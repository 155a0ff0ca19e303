"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter (general category L)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """All runs of one to three characters of the lower-cased words, a space at each end of a word, as numbers."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.concatenate([[32], np.where(_letters()[c], c, 32), [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.concatenate([c[c != 32], two, three])


def ranked(g: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by their number."""
    u, n = np.unique(g, return_counts=True)
    return u[np.lexsort((u, -n))[:size]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def profiles(docs: DataFrame, *, size: int = 300, docs_per_lang: int = 400, broadcast_rows: int = 200_000) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, from at most ``docs_per_lang`` labelled documents that aren't held out.

    The documents are those with the smallest hash of doc_id; each counts with its whole text. What comes to the
    driver is ``size`` numbers a language.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = own.select("doc_id", "lang").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= docs_per_lang).select(F.col("doc_id").alias("_i"), F.col("lang").alias("_l")).distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen
    train = own.join(chosen, own["doc_id"].eqNullSafe(F.col("_i")) & (F.col("lang") == F.col("_l")), "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, texts in f.groupby("lang")["text"]:
                u, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": u, "n": n})

    counts = train.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for r in top.collect():
        out.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: [g for _, g in sorted(rows)] for lang, rows in sorted(out.items())}


class Model:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, known: dict[str, list[int]], size: int):
        self.langs, self.size = list(known), size
        self.grams = np.unique(np.concatenate([np.array(x, np.int64) for x in known.values()])) if known else np.empty(0, np.int64)
        self.ranks = np.full((len(known), len(self.grams) + 1), -1, np.int64)
        for i, x in enumerate(known.values()):
            self.ranks[i, np.searchsorted(self.grams, x)] = np.arange(len(x))

    def __call__(self, text: str | None) -> tuple[str, float]:
        top = ranked(grams(text), self.size)
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        r = self.ranks[:, at]
        off = np.where(r < 0, self.size, np.minimum(np.abs(r - np.arange(len(top))), self.size)).sum(axis=1)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (len(top) * self.size))


def _judged(docs: DataFrame, size: int, docs_per_lang: int) -> DataFrame:
    model = Model(profiles(docs, size=size, docs_per_lang=docs_per_lang), size)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([model(x) for x in t], columns=["lang_pred", "score"])

    return docs.withColumn("__lekhani_g", F.pandas_udf(judge, "lang_pred string, score double")(F.col("text").cast("string")))


def identify(docs: DataFrame, *, size: int = 300, docs_per_lang: int = 400) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language whose profile is nearest to that of the whole text.

    A text's n-grams by frequency are compared with a language's: each adds the difference of its ranks, or ``size``
    if the language hasn't it. score is 1 less the sum's share of the largest possible. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text if no language has been learnt. Ties go to the first language by
    name; rows that repeat are judged each; an empty table gives no rows; other columns pass
    through, but for columns named as the two results, which are replaced.
    """
    g = "__lekhani_g"
    return _judged(docs, size, docs_per_lang).withColumns({"lang_pred": F.col(f"{g}.lang_pred"), "score": F.col(f"{g}.score")}).drop(g)


def keep_identified(docs: DataFrame, *, least: float = 0.15) -> DataFrame:
    """``docs`` without those whose language isn't known: ``und``, or farther from all profiles than any prose is.

    Null texts, texts without a letter, and texts with a score under ``least`` go; of the documents of the test tables no
    text with ten words of prose has so low a score. Rows that repeat stay or go alike, null doc_ids count for nothing, an
    empty table gives no rows, and all columns stay as they are.
    """
    g = "__lekhani_g"
    return _judged(docs, 300, 400).where((F.col(f"{g}.lang_pred") != "und") & (F.col(f"{g}.score") >= least)).drop(g)
