"""Typo-tolerant matches by symmetric deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_distance, collapse_vowels, deletes


def delete_index(words: DataFrame, column: str = "roman") -> DataFrame:
    """Each word with each string that two deletions at most leave of it."""
    return words.select(F.explode(deletes(F.col(column))).alias("del"), "*")


def match(queries: DataFrame, words: DataFrame, *, most: int = 2) -> DataFrame:
    """(roman) ⋈ (variant, dev) -> roman, dev, distance: words within ``most`` edits of a query by their best variant.

    A word is found by any of its variants or by its native form; then all its variants are measured. Distances are the
    smaller of those between the strings and between the strings with vowel runs collapsed.
    """
    words = words.select("variant", "dev").distinct()
    native = words.select(F.col("dev").alias("form"), "dev").distinct()
    index = delete_index(words.select(F.col("variant").alias("form"), "dev").unionByName(native), "form").select("del", "dev").distinct()
    asked = delete_index(queries.select("roman").distinct())
    found = asked.join(index, "del").select("roman", "dev").distinct()
    near = found.join(words, "dev")
    plain = bounded_distance(F.col("roman"), F.col("variant"), most)
    short = bounded_distance(collapse_vowels(F.col("roman")), collapse_vowels(F.col("variant")), most)
    return near.withColumn("d", F.least(plain, short)).where("d is not null").groupBy("roman", "dev").agg(F.min("d").alias("distance"))


def add_variants(index: DataFrame | None, known: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upkeep: the rows that a batch (variant, dev) of confirmations adds to the index (del, dev) and to the variants.

    Only variants that are not known yet add rows, and a word's native form is added with its first variant only.
    """
    fresh = batch.select("variant", "dev").distinct()
    first = fresh.select("dev").distinct()
    if known is not None:
        fresh = fresh.join(known, ["variant", "dev"], "left_anti")
        first = first.join(known, "dev", "left_anti")
    forms = fresh.select(F.col("variant").alias("form"), "dev").unionByName(first.select(F.col("dev").alias("form"), "dev"))
    rows = delete_index(forms, "form").select("del", "dev").distinct()
    return (rows if index is None else rows.join(index, ["del", "dev"], "left_anti")), fresh
