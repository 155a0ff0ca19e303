"""Letters to code points: minimum-cost alignment by lengths, and what each syllable is written as."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BARE, CLEAN, syllables

# Costs of one letter for one code point, a letter alone, a code point alone, two letters for one.
SUBSTITUTE, DELETE, INSERT, MERGE = 1.0, 1.5, 1.5, 1.3
CHUNK = 5


@cache
def _best(i: int, j: int) -> tuple[float, int, int]:
    """Least cost of i letters and j code points, and what the last step takes of each."""
    ways = []
    if i and j:
        ways.append((_best(i - 1, j - 1)[0] + SUBSTITUTE, 1, 1))
    if i:
        ways.append((_best(i - 1, j)[0] + DELETE, 1, 0))
    if j:
        ways.append((_best(i, j - 1)[0] + INSERT, 0, 1))
    if i > 1 and j:
        ways.append((_best(i - 2, j - 1)[0] + MERGE, 2, 1))
    return min(ways, key=lambda w: w[0]) if ways else (0.0, 0, 0)


def least_cost(m: int, n: int) -> float:
    return _best(m, n)[0]


def spans(m: int, n: int) -> list[tuple[int, int]]:
    """(offset, length) in a word of ``m`` letters for each of ``n`` code points, by least cost; ties as the costs stand.

    Costs don't depend on the characters, so the lengths decide.
    """
    out: list[tuple[int, int]] = []
    i, j = m, n
    while i or j:
        _, a, b = _best(i, j)
        if b:
            out.append((i - a, a))
        i, j = i - a, j - b
    return out[::-1]


def table(spark: SparkSession, letters: int = 24, points: int = 64) -> DataFrame:
    """One row for each pair of lengths: m, n, spans, cost; letters * points rows."""
    rows = [(m, n, spans(m, n), least_cost(m, n)) for m in range(1, letters + 1) for n in range(1, points + 1)]
    return spark.createDataFrame(rows, "m int, n int, spans array<struct<off: int, len: int>>, cost double")


def aligned(pairs: DataFrame) -> DataFrame:
    """roman, dev -> with ``parts``, the letters of each code point, '' where it has none, and the cost. Words of clean pairs only."""
    longest = pairs.agg(F.max(F.length("dev"))).first()[0] or 0
    t = table(pairs.sparkSession, points=max(64, longest))
    if longest <= 4096:  # 24 times so many rows can be sent to every task
        t = F.broadcast(t)
    x = pairs.join(t, (F.length("roman") == F.col("m")) & (F.length("dev") == F.col("n")))
    return x.select("roman", "dev", F.transform("spans", lambda s: F.substring(F.col("roman"), s["off"] + 1, s["len"])).alias("parts"), "cost")


def clean(pairs: DataFrame) -> DataFrame:
    """Pairs that training takes, with their syllables."""
    x = pairs.where("roman <> '' AND dev <> ''").withColumn("aks", syllables(F.col("dev")))
    return x.where(F.col("roman").rlike(CLEAN) & (F.size("aks") <= 12))


def seeds(pairs: DataFrame) -> DataFrame:
    """Counts of (a, chunk): letters dealt to syllables by their number of code points, after empty parts are left out.

    A bare consonant also counts with its inherent vowel added and, if it ends in that, without.
    """
    x = aligned(clean(pairs).select("roman", "dev")).select(F.filter("parts", lambda p: p != "").alias("p"), syllables(F.col("dev")).alias("aks"))
    lens = x.withColumn("lens", F.transform("aks", F.length))
    chunk = lambda i: F.array_join(F.slice("p", F.least(F.aggregate(F.slice("lens", F.lit(1), i), F.lit(0), lambda s, v: s + v), F.size("p")) + 1, F.get("lens", i)), "")
    each = lens.select(F.explode(F.transform("aks", lambda a, i: F.struct(a.alias("a"), chunk(i).alias("c")))).alias("s")).select("s.a", "s.c")
    each = each.where((F.length("c") > 0) & (F.length("c") <= CHUNK))
    bare = F.col("a").rlike(f"[{BARE}]\\z")
    forms = F.array(F.col("c"), F.when(bare & (F.length("c") < CHUNK), F.concat("c", F.lit("a"))), F.when(bare & F.col("c").endswith("a") & (F.length("c") > 1), F.expr("substring(c, 1, length(c) - 1)")))
    return each.select("a", F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("chunk")).groupBy("a", "chunk").agg(F.count(F.lit(1)).alias("n"))


def seed_emissions(counts: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Shares within each syllable, with a floor: a, chunk, p."""
    total = counts.groupBy("a").agg(F.sum("n").alias("t"))
    return counts.join(total, "a").select("a", "chunk", F.greatest(F.col("n") / F.col("t"), F.lit(floor)).alias("p"))
