"""Checkpoints for loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Go on from the shared checkpoint folder, so that loops don't grow their plan.

    Where ``spark.checkpoint.dir`` is absent a temporary folder is made if all runs in one process (``local``); on a
    cluster it raises.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lekhani-"))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to all cores: adaptive execution packs few bytes into one task, however much work a row is."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Rows with their place by ``order`` from 0, as column ``out``: range partitions are counted, then numbered each by itself."""
    dealt = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_part").count().withColumn("_base", F.coalesce(F.sum("count").over(ahead), F.lit(0)))  # a row a partition
    own = Window.partitionBy("_part").orderBy(order)
    x = dealt.join(F.broadcast(base.select("_part", "_base")), "_part")
    return x.withColumn(out, F.col("_base") + F.row_number().over(own) - 1).drop("_part", "_base")
