"""Views of a trained model: its sizes, the likeliest spellings of syllables, chunks as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters a code holds, where its length stands, and the code of what isn't a-z.
MOST_LETTERS = 5
LENGTH_BIT = 26
OTHER = 26


def top_emissions(emission: DataFrame, k: int = 5) -> DataFrame:
    """a, chunk, w, rank: the ``k`` likeliest chunks of each syllable; ties by chunk."""
    order = Window.partitionBy("a").orderBy(F.col("p").desc(), "chunk")
    x = emission.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return x.select("a", "chunk", (-F.log("p")).alias("w"), "rank")


def model_summary(emission: DataFrame, segs: DataFrame) -> DataFrame:
    """name, value: how many syllables, emissions, bigrams, trigrams and trigram contexts, and the most emissions of one."""
    kinds = segs.agg(F.count_distinct("a").alias("syllables"), F.count_distinct("a", "b").alias("bigrams"), F.count_distinct("a", "b", "c").alias("trigrams"), F.count_distinct(F.when(F.col("c").isNotNull(), F.struct("a", "b"))).alias("trigram_contexts"))
    sizes = emission.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("emissions"), F.max("n").alias("most_emissions"))
    names = ["syllables", "emissions", "most_emissions", "bigrams", "trigrams", "trigram_contexts"]
    row = kinds.crossJoin(sizes)  # one row by one row
    return row.unpivot([], names, "name", "value")


def widest(emission: DataFrame, k: int = 10) -> DataFrame:
    """a, n: the ``k`` syllables with the most emissions; ties by syllable."""
    return emission.groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "a").limit(k)


def probability(wanted: DataFrame, emission: DataFrame) -> DataFrame:
    """wanted (a, chunk) -> a, chunk, w, p: weight and share of the emission; no weight and 0 where there is none."""
    x = wanted.join(emission.select("a", "chunk", (-F.log("p")).alias("w")), ["a", "chunk"], "left")
    return x.select("a", "chunk", "w", F.coalesce(F.exp(-F.col("w")), F.lit(0.0)).alias("p"))


def valid(emission: DataFrame, lm: dict[str, DataFrame]) -> bool:
    """Whether a model has syllables, and each of them what the decoder reads: a start, a unigram, a back-off weight.

    lm: as ``decode.load``. Syllables of emissions and of bigrams must be among those of the unigrams.
    """
    known = lm["unigram"].select("a")
    if known.isEmpty() or known.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    for other in (lm["start"], lm["backoff"]):
        if known.join(other, "a", "left_anti").limit(1).count() or other.join(known, "a", "left_anti").limit(1).count():
            return False
    used = emission.select("a").unionByName(lm["bigram"].select("a")).unionByName(lm["bigram"].select(F.col("b").alias("a")))
    return not used.distinct().join(known, "a", "left_anti").limit(1).count()


def pack_chunk(chunk: Column) -> Column:
    """A chunk as an integer: five bits a byte from the lowest, the number of bytes from bit 26; bytes but a-z are 26.

    Bytes after the fifth are left out, so only chunks of up to five letters come back.
    """
    b = F.decode(chunk.cast("binary"), "ISO-8859-1")  # a character a byte
    n = F.least(F.length(b), F.lit(MOST_LETTERS))
    code = lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).otherwise(OTHER)
    bits = [F.when(n > i, F.shiftleft(code(F.substring(b, i + 1, 1)), 5 * i)).otherwise(0) for i in range(MOST_LETTERS)]
    total = F.shiftleft(n, LENGTH_BIT)
    for x in bits:
        total = total.bitwiseOR(x)
    return total


def unpack_chunk(packed: Column) -> Column:
    n = F.shiftright(packed, LENGTH_BIT).bitwiseAND(15)
    letter = lambda i: F.when((n > i) & (F.shiftright(packed, 5 * i).bitwiseAND(31) < 26), F.char(F.shiftright(packed, 5 * i).bitwiseAND(31) + 97)).otherwise("")
    return F.concat(*[letter(i) for i in range(MOST_LETTERS)])
