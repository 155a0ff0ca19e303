"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made if all runs in one process (``local``, as in tests); on a
    cluster, whose machines don't share such a folder, it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lekhani-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Loop:
    """The state of a loop as tables in the shared folder, one a round, and rows that are finished.

    Unlike checkpoints, which keep the planner's estimate of their size, written tables have their own: in a loop with
    joins estimates would double their digits each round, until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.last, self.n = spark, f"{shared_dir(spark)}/loop-{uuid.uuid4().hex}", None, 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write the state of the next round; the one before is deleted, since ``df`` was all that needed it."""
        self.n += 1
        path, before = f"{self.folder}/{self.n}", self.last
        df.write.parquet(path)
        self.last = path
        if before:
            self._delete(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame) -> None:
        """Write rows that are finished."""
        df.write.mode("append").parquet(f"{self.folder}/done")

    def done(self, df: DataFrame) -> DataFrame:
        """All finished rows, with the columns of ``df``; the last state is deleted."""
        self.add(df.limit(0))  # so that there is a table
        if self.last:
            self._delete(self.last)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/done")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` by (``bucket``, ``order``), as column ``out``.

    ``bucket`` splits each key into many ordered pieces, so that no task holds a whole key: sums of pieces are
    accumulated first, and only rows of one piece are ordered together.
    """
    part = [*keys, bucket]
    sums = df.groupBy(*part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)], "_base")
    on = [df[k].eqNullSafe(base[f"_k{i}"]) for i, k in enumerate(part)]
    own = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(base, on).drop(*[f"_k{i}" for i in range(len(part))])
    return joined.withColumn(out, F.col("_base") + F.sum(value).over(own)).drop("_base")


def attach(rows: DataFrame, table: DataFrame, keys: dict[str, str], count: str, total: int, *, most: int = 100_000) -> DataFrame:
    """``rows`` joined with the columns of ``table``, which has one row a key; rows without one go. Nulls match.

    keys: column of ``rows`` -> column of ``table``, whose column ``count`` says how many rows a key has, of ``total``.
    Keys with over total / ``most`` rows, which are fewer than ``most``, are sent to every task, so that no task gets
    all rows of a hot key; only rows of the others are shuffled. A table of at most ``most`` rows is sent whole, in a
    plan of a third of the size. ``rows`` and ``table`` are read several times: cut them before.
    """
    limit = max(1000, -(-total // most))
    names = [f"__lekhani_a{i}" for i in range(len(keys))]
    rest = [c for c in table.columns if c not in keys.values() and c != count]
    t = table.select(*[F.col(k).alias(n) for k, n in zip(keys.values(), names, strict=True)], *rest, F.col(count).alias("__lekhani_n"))
    hot, cold = (t.where(F.col("__lekhani_n") > limit), t.where(F.col("__lekhani_n") <= limit))

    def on(right: DataFrame) -> Column:
        return reduce(and_, [rows[k].eqNullSafe(right[n]) for k, n in zip(keys, names, strict=True)])

    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(t), on(t)).drop("__lekhani_n", *names)
    one = rows.join(F.broadcast(hot), on(hot))
    left = rows.join(F.broadcast(hot.select(*names)), on(hot), "left_anti")
    two = left.join(cold, reduce(and_, [left[k].eqNullSafe(cold[n]) for k, n in zip(keys, names, strict=True)]))
    return one.unionByName(two).drop("__lekhani_n", *names)


def ranks(units: DataFrame, order: list[str], times: str | None = None) -> DataFrame:
    """Distinct ``units`` with ``name``: their place from 0 in ``order``, by a range sort and prefix sums of partitions.

    With ``times`` a unit takes so many places. The window over partitions sees one row a partition.
    """
    n = F.lit(1).cast("long") if times is None else F.col(times)
    dealt = cut(units.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", n))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(ahead), F.lit(0)))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = dealt.join(F.broadcast(base.select("_part", "_base")), "_part")
    return x.withColumn("name", F.col("_base") + F.sum("_n").over(own) - F.col("_n")).drop("_part", "_n", "_base")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what Python workers hold at once, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to any more; it waits for collections else."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
