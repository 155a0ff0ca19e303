"""One user's engine: suggestions, confirmations, and what was learned kept between sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.decode import Model
from .operators.suggest import as_json, suggest
from .plans.runtime import cut
from .sources import state
from .sources.corpus import prefixes_of

_EMPTY = {"pairs": "roman string, dev string, n long, last long", "context": "prev string, dev string, n long"}


class Engine:
    """``lexicon`` (roman, dev), ``model`` of the decoder or None, ``path`` of the state or None.

    State: ``pairs``, each confirmed spelling of a word with its count and the number of its last confirmation, and
    ``context``, counts of words in a row. A path without a readable snapshot starts empty.
    """

    def __init__(self, spark: SparkSession, *, lexicon: DataFrame, model: Model | None = None, path: str | None = None, weights: tuple = (1.0, 1.0, 0.0, 0.0)) -> None:
        self.spark, self.lexicon, self.model, self.path, self.weights = spark, lexicon, model, path, weights
        kept = state.load(spark, path, _EMPTY) if path else None
        self.tables = kept or {k: spark.createDataFrame([], s) for k, s in _EMPTY.items()}
        self.last: str | None = None

    def confirm(self, words: list[tuple[str, str]]) -> None:
        """(roman, dev) in the order of confirmation; empty ones are left out."""
        words = [w for w in words if w[0] and w[1]]
        if not words:
            return
        pairs = self.tables["pairs"]
        first = (pairs.agg(F.max("last")).first()[0] or 0) + 1
        new = self.spark.createDataFrame([(*w, 1, first + i) for i, w in enumerate(words)], _EMPTY["pairs"])
        self.tables["pairs"] = cut(pairs.unionByName(new).groupBy("roman", "dev").agg(F.sum("n").alias("n"), F.max("last").alias("last")))
        devs = ([self.last] if self.last else []) + [dev for _, dev in words]
        if len(devs) > 1:
            rows = self.spark.createDataFrame([(a, b, 1) for a, b in zip(devs, devs[1:], strict=False)], _EMPTY["context"])
            self.tables["context"] = cut(self.tables["context"].unionByName(rows).groupBy("prev", "dev").agg(F.sum("n").alias("n")))
        self.last = devs[-1]

    def suggest(self, romans: list[str], count: int = 8) -> DataFrame:
        """roman, rank, dev, score; none for empty queries."""
        queries = self.spark.createDataFrame([(r,) for r in romans if r], "roman string")
        pairs = self.tables["pairs"]
        frequency = pairs.groupBy("dev").agg(F.sum("n").alias("frequency"))
        last = pairs.groupBy("roman").agg(F.max_by("dev", "last").alias("dev"))
        boost = None
        if self.last:
            after = self.tables["context"].where(F.col("prev") == self.last)
            boost = after.select("dev", F.floor(F.log2("n") * 10).alias("boost")).join(frequency.select("dev"), "dev")
        return suggest(queries, lexicon=self.lexicon, learned=pairs.select(F.col("roman").alias("variant"), "dev"), learned_prefixes=prefixes_of(last.join(frequency, "dev"), "dev", "frequency").drop("roman"), model=self.model, count=max(1, count), weights=self.weights, context=boost)

    def suggest_json(self, roman: str) -> str:
        """The best eight as a JSON array; ``[]`` where there are none."""
        row = as_json(self.suggest([roman])).first() if roman else None
        return row["suggestions"] if row else "[]"

    def save(self) -> None:
        """Keep the state as a new snapshot; without a path nothing is done."""
        if self.path:
            state.save(self.spark, self.path, self.tables)
