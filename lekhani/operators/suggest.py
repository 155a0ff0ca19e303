"""Ranked suggestions: evidence of the decoder, the lexicon, learned words and near spellings, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from . import fuzzy
from .decode import Model, decode_all, rerank
from .variants import expand


def suggest(queries: DataFrame, *, lexicon: DataFrame, learned: DataFrame, learned_prefixes: DataFrame, model: Model | None, count: int = 8, weights: tuple = (1.0, 1.0, 0.0, 0.0), context: DataFrame | None = None) -> DataFrame:
    """roman -> roman, rank, dev, score: the ``count`` best.

    lexicon (roman, dev), learned (variant, dev: all confirmed spellings), learned_prefixes (prefix, dev, frequency).
    The query itself is decoded; all its variants look up the lexicon (300 less their penalty; case doesn't count there,
    nor for the decoder), learned words that start
    so (180 and their frequency, the 3 * ``count`` most frequent) and near spellings (50 less 12 an edit). A word keeps
    its best score; ``context`` (dev, boost), if given, adds to those of learned words. Ties by dev.
    """
    forms = expand(queries.select("roman").distinct()).select("roman", "variant", "penalty")
    found = []
    if model is not None:
        best = rerank(decode_all(queries, model, 4 * count), lexicon, weights)
        fresh = F.greatest(F.lit(1), F.round(800 / (1 + F.greatest(F.lit(0.0), -F.col("rscore")))))
        found.append(best.select("roman", "dev", fresh.cast("long").alias("score")))
    known = lexicon.select(ascii_lower(F.col("roman")).alias("low"), "dev").distinct()
    exact = forms.withColumn("low", ascii_lower(F.col("variant"))).join(known, "low")
    found.append(exact.select("roman", "dev", F.greatest(F.lit(0), 300 - F.col("penalty")).cast("long").alias("score")))
    top = Window.partitionBy("roman", "variant").orderBy(F.col("frequency").desc(), "dev")
    starts = forms.join(learned_prefixes.select(F.col("prefix").alias("variant"), "dev", "frequency").distinct(), "variant")
    starts = starts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= 3 * count)
    found.append(starts.select("roman", "dev", (180 + F.col("frequency")).cast("long").alias("score")))
    near = fuzzy.match(forms.select(F.col("variant").alias("roman")), learned)
    near = forms.join(near.select(F.col("roman").alias("variant"), "dev", "distance"), "variant")
    found.append(near.select("roman", "dev", F.greatest(F.lit(0), 50 - 12 * F.col("distance")).cast("long").alias("score")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    fused = every.groupBy("roman", "dev").agg(F.max("score").alias("score"))
    if context is not None:
        fused = fused.join(context, "dev", "left").select("roman", "dev", (F.col("score") + F.coalesce("boost", F.lit(0))).alias("score"))
    order = Window.partitionBy("roman").orderBy(F.col("score").desc(), "dev")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("roman", "rank", "dev", "score")


def as_json(suggestions: DataFrame) -> DataFrame:
    """One row a query: its words in order as a JSON array."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dev"))), lambda x: x["dev"])
    return suggestions.groupBy("roman").agg(F.to_json(words).alias("suggestions"))
