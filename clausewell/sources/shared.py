"""Parquet tables in the folder that the driver and all executors share: what several steps read is made once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a session that runs in one process (local
    mode, as in tests) gets a temporary folder; on a cluster that is an error, as executors do not share such a folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


_tables: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, which ``drop_stored`` removes."""
    _tables.append(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    return _tables[-1]


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as a Parquet table, in the shared folder if no path is given, and read again: a lost executor costs no earlier step."""
    own = path or new_path(df.sparkSession)
    df.write.parquet(own)
    return df.sparkSession.read.schema(df.schema).parquet(own)


def drop_stored(spark: SparkSession) -> None:
    """Removes the tables of the shared folder: to be called when the results made of them are stored."""
    sc = spark.sparkContext
    while _tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """rows with ``place``, the rank from 1 among rows of equal keys (none of them null), when a key may hold any share of them.

    Rows are dealt by ranges of (keys, order) and stored; a window holds one key's part of one range, and counts of the ranges before,
    a row for each key and range, are added."""
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    dealt = dealt.withColumn(place, F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    return dealt.join(parts, [*keys, "_part"]).withColumn(place, F.col(place) + F.col("_before")).drop("_part", "_before")
