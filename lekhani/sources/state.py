"""Snapshots of named tables (models, lexicons, what users have confirmed), and where to look for them."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_DONE = "_COMPLETE"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of all snapshots in ``path``, and of those that are complete, in order."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return [], []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    every = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return every, [v for v in every if fs.exists(_folder(spark, f"{path}/v{v}/{_DONE}")[0])]


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    """Write the tables as a new snapshot in ``path`` and give its number.

    The mark that makes it count is created last, so a reader never sees half a snapshot, and a run that dies leaves the
    one before. The snapshot before stays for readers that have begun; older ones go.
    """
    every, complete = _versions(spark, path)
    now = max(every, default=0) + 1
    for name, table in tables.items():
        table.write.parquet(f"{path}/v{now}/{name}")
    mark, fs = _folder(spark, f"{path}/v{now}/{_DONE}")
    fs.create(mark).close()
    for old in [v for v in every if v not in complete[-1:]]:
        fs.delete(_folder(spark, f"{path}/v{old}")[0], True)
    return now


def load(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame] | None:
    """The tables of the newest complete snapshot; None where there is none or one of its tables can't be read."""
    _, complete = _versions(spark, path)
    if not complete:
        return None
    from pyspark.errors import AnalysisException

    try:
        return {name: spark.read.parquet(f"{path}/v{complete[-1]}/{name}") for name in names}
    except AnalysisException:
        return None


def resolve(name: str, *, folder: str | None = None, places: Iterable[str] = ("data", "~/.local/share/lekhani", "/usr/share/lekhani")) -> str:
    """The first place that has ``name``: ``folder`` (else LEKHANI_DATA_DIR), then ``places``; the last where none has."""
    found = ""
    for place in [p for p in (folder or os.environ.get("LEKHANI_DATA_DIR"), *places) if p]:
        found = os.path.join(os.path.expanduser(place), name)
        if os.path.exists(found):
            break
    return found
