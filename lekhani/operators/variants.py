"""Spelling variants of queries: a weighted rewrite of each word, expanded position by position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.runtime import spread

# Fixed values: (from, to, cost) of the rewrite rules.
RULES = [
    ("ee", "ii", 1), ("oo", "uu", 1), ("ou", "au", 1), ("ae", "ai", 1), ("w", "v", 1), ("W", "V", 1),
    ("-", "", 1), ("_", "", 1), ("'", "", 1), (" ", "", 1),
    ("aaa", "aa", 1), ("eee", "ee", 1), ("iii", "ii", 1), ("ooo", "oo", 1), ("uuu", "uu", 1),
    ("a", "aa", 2), ("i", "ii", 2), ("u", "uu", 2), ("aa", "a", 2), ("ii", "i", 2), ("uu", "u", 2),
]
#: Rules that words of up to two letters don't take.
NOT_SHORT = ("a", "i", "u")


def rewrites(roman: str, most: int) -> list[tuple[str, int]]:
    """The ``most`` cheapest rewrites of a word with their costs. Ties: longer, then by letters.

    One pass over the letters: at each place a letter is copied, or a rule that fits there is applied at its cost, to the
    word, never to what rules wrote. Of what has been written up to a place only the ``most`` best are kept: each rewrite
    of the rest keeps their order, so none beyond them can be among the best of the whole.
    """
    size = len(roman)
    reached: list[dict[str, int]] = [{} for _ in range(size + 1)]
    reached[0][""] = 0
    rules = [r for r in RULES if size > 2 or r[0] not in NOT_SHORT]
    order = lambda x: (x[1], -len(x[0].encode("utf-8", "surrogatepass")), x[0])
    for at in range(size + 1):
        best = sorted(reached[at].items(), key=order)[:most]
        if at == size:
            return best
        steps = [(1, roman[at], 0), *((len(a), b, c) for a, b, c in rules if roman.startswith(a, at))]
        for written, cost in best:
            for n, more, extra in steps:
                there, out = reached[at + n], written + more
                if cost + extra < there.get(out, cost + extra + 1):
                    there[out] = cost + extra
    return []


def expand(queries: DataFrame, *, most: int = 6) -> DataFrame:
    """roman -> (roman, variant, penalty, rank): the ``most`` cheapest rewrites of each query, itself first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, v, c, i) for r in f["roman"] for i, (v, c) in enumerate(rewrites(r, most), 1)]
            yield pd.DataFrame(rows, columns=["roman", "variant", "penalty", "rank"])

    words = queries.select("roman").where("roman is not null").distinct()
    return spread(words, "roman").mapInPandas(run, "roman string, variant string, penalty int, rank int")
