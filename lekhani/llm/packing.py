"""Packing documents into sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .encoding import encode

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def patterns(histogram: dict[int, int], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of lengths and how many packs have each: [([(length, times), ...], packs), ...].

    Lengths go longest first, each into the shortest pack that has room, all packs of a pattern at once.
    """
    room: dict[int, list] = {}
    full = []

    def put(space: int, pattern: list, packs: int) -> None:
        if packs:
            (room.setdefault(space, []) if space else full).append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s >= length), default=0)
            if not space:
                times = most // length
                packs, rest = divmod(left, times)
                put(most - times * length, [(length, times)], packs)
                put(most - rest * length, [(length, rest)], 1 if rest else 0)
                break
            pattern, packs = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(left, packs)
            *head, last = pattern
            grown = [*head, (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)]
            put(space - length, grown, used)
            put(space, pattern, packs - used)
            left -= used
    return full + [x for s in sorted(room) for x in room[s]]


def pack(docs: DataFrame, tokenizer: str, *, most: int = 1024, end_id: int = 0, piece: int = 4096, broadcast_rows: int = 100_000) -> DataFrame:
    """Encode every text, end it with ``end_id``, cut it into pieces of at most ``most`` ids and pack the pieces.

    Full pieces are sequences of their own. The others are packed as lengths: the driver sees only the histogram, at
    most ``most`` counts, and returns patterns; pieces take places in patterns by their rank within their length.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece. Null text is empty, so
    one piece with only ``end_id``; rows that repeat are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, x in zip(f["doc_id"], encode(f["text"], tokenizer), strict=True):
                x = np.append(x, end_id).astype("<u4")
                doc = None if pd.isna(i) else int(i)
                rows += [(doc, a, min(most, len(x) - a), zlib.crc32(x[a : a + most].tobytes()), len(x)) for a in range(0, len(x), most)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(cut_up, PIECES))

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    full = counts.pop(most, 0)
    places, taken, sequences = [], dict.fromkeys(counts, 0), full
    for pattern, packs in patterns(counts, most):
        offset = 0
        for length, times in pattern:
            places.append((length, taken[length], taken[length] + times * packs, packs, sequences, offset))
            taken[length] += times * packs
            offset += times * length
        sequences += packs
    places.append((most, 0, full, max(1, full), 0, 0))

    n = full + sum(counts.values())
    parts = max(1, -(-n // (16 * piece)))
    ranked = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    sums = ranked.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = ranked.join(base, ["length", "_b"]).withColumn("_r", F.col("_base") + F.row_number().over(own) - 1)

    table = spark.createDataFrame(places, "_l long, _from long, _to long, _packs long, _first long, _offset long")
    if len(places) <= broadcast_rows:
        table = F.broadcast(table)
    at = F.col("_r") - F.col("_from")
    out = ranked.join(table, (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + at % F.col("_packs")).alias("sequence_id"), (F.col("_offset") + F.floor(at / F.col("_packs")) * F.col("length")).cast("long").alias("offset"))
