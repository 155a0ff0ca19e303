"""Learning from a stream of confirmations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fuzzy import add_variants
from ..plans.runtime import cut
from ..sources import state

SCHEMA = "uid long, turn long, pos int, roman string, dev string"


TABLES = {"words": "dev string, roman string, n long", "index": "del string, dev string", "batch": "id long"}


def learn(spark: SparkSession, folder: str, checkpoint: str) -> dict[str, DataFrame]:
    """Read confirmations that are in ``folder`` as a stream until none is left: the tables learned so far.

    words: each word's spellings and how often each was confirmed; index: what deletions leave of spellings, and of the
    native form of each word, kept up with each batch. Both are snapshots in ``checkpoint``; a batch that is given again
    after a failure is known by its number and changes nothing.
    """
    store = f"{checkpoint}/tables"

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        kept = state.load(s, store, TABLES)
        if kept and (kept["batch"].first() or [-1])[0] >= number:
            return
        kept = kept or {k: s.createDataFrame([], v) for k, v in TABLES.items()}
        known = kept["words"].select(F.col("roman").alias("variant"), "dev")
        rows = cut(batch.where("roman <> '' AND dev <> ''").select(F.col("roman").alias("variant"), "dev"))
        more, _ = add_variants(kept["index"], known, rows)
        counts = rows.groupBy("dev", F.col("variant").alias("roman")).agg(F.count(F.lit(1)).alias("n"))
        words = kept["words"].unionByName(counts).groupBy("dev", "roman").agg(F.sum("n").alias("n"))
        state.save(s, store, {"words": words, "index": kept["index"].unionByName(more), "batch": s.createDataFrame([(number,)], TABLES["batch"])})

    events = spark.readStream.schema(SCHEMA).parquet(folder)
    q = events.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return state.load(spark, store, TABLES) or {k: spark.createDataFrame([], v) for k, v in TABLES.items()}


def word_counts(words: DataFrame) -> DataFrame:
    """dev, frequency, variants of the words learned."""
    return words.groupBy("dev").agg(F.sum("n").alias("frequency"), F.array_sort(F.collect_set("roman")).alias("variants"))


def _followers(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's pairs of words in a row, counted; the state is the user's last word."""
    last, found = (state.get[0] if state.exists else None), Counter()
    for _, _, dev in sorted((t, p, d) for f in frames for t, p, d in zip(f["turn"], f["pos"], f["dev"], strict=True)):
        if last is not None:
            found[last, dev] += 1
        last = dev
    if last is not None:
        state.update((last,))
    yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["prev", "dev", "n"])


def learn_context(spark: SparkSession, folder: str, checkpoint: str, out: str) -> DataFrame:
    """Read confirmations in ``folder`` that no run before has read, append their counts to ``out``: all so far as prev, dev, n.

    A user's rows of one run are ordered by (turn, pos); later runs must bring later rows. The word before the first of a
    run comes from the state in ``checkpoint``.
    """
    events = spark.readStream.schema(SCHEMA).parquet(folder).where("dev is not null")
    pairs = events.groupBy("uid").applyInPandasWithState(_followers, "prev string, dev string, n long", "last string", "append", GroupStateTimeout.NoTimeout)
    q = pairs.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("prev string, dev string, n long").parquet(out).groupBy("prev", "dev").agg(F.sum("n").alias("n"))
