"""Models and lexicons as snapshots of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..operators.decode import Config, Model
from ..operators.decode import load as arrays
from ..operators.summary import valid
from . import state

LM = ("start", "unigram", "backoff", "bigram", "trigram", "trigram_backoff")
MOST_BYTES = 65535  # fixed value: of a word in the lexicon


def lexicon_of(pairs: DataFrame) -> DataFrame:
    """Distinct (roman, dev), lower-cased, of letters a-z only, with words of at most 65,535 bytes."""
    x = pairs.select(ascii_lower(F.col("roman")).alias("roman"), "dev")
    return x.where(F.col("roman").rlike("\\A[a-z]+\\z") & (F.octet_length("dev") <= MOST_BYTES)).distinct()


def save_lexicon(spark: SparkSession, path: str, pairs: DataFrame) -> int:
    """Keep the lexicon of ``pairs``, sorted as a whole, so that reads of some spellings skip files and row groups."""
    return state.save(spark, path, {"pairs": lexicon_of(pairs).orderBy("roman", "dev")})


def load_lexicon(spark: SparkSession, path: str) -> DataFrame | None:
    """The lexicon; None where there is none that can be read."""
    found = state.load(spark, path, ["pairs"])
    return found and found["pairs"]


def save_model(spark: SparkSession, path: str, emission: DataFrame, lm: dict[str, DataFrame]) -> int:
    """Keep emissions (a, chunk, p) and the six tables of the language model; raises for a model that isn't ``valid``."""
    if not valid(emission, lm):
        raise ValueError("the model is empty, or its tables don't have the same syllables")
    return state.save(spark, path, {"emission": emission, **{k: lm[k] for k in LM}})


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]] | None:
    """Emissions and language model; None where there is no snapshot that can be read and is ``valid``."""
    found = state.load(spark, path, ["emission", *LM])
    if not found:
        return None
    emission = found.pop("emission")
    return (emission, found) if valid(emission, found) else None


def load_model(spark: SparkSession, path: str, config: Config = Config(), queries: DataFrame | None = None) -> Model | None:
    """The model as the decoder takes it; None as ``load_tables``. ``queries``: as ``decode.load``."""
    found = load_tables(spark, path)
    return found and arrays(spark, *found, config, queries)
