"""What several operators share: reading, Arrow passes over texts, tables that cut lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """The column of this name, dots and blanks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(taken: list[str], name: str) -> str:
    """name, with underscores before it while ``taken`` has it in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet, in any case."""
    return free(df.columns, f"_{stem}")


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


#: Spark drops the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a Parquet table in the shared folder. The shuffles behind it go once it is written."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables that ``written`` left: to be called when the results made of them are stored."""
    sc = spark.sparkContext
    while _tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def bounded(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices whose values of a binary column have about ``limit`` bytes at most, one row at least each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(
    docs: DataFrame, text: str, keep: list[str], fields: str, make: Callable[[], Callable[[list[bytes | None]], list[pa.Array]]]
) -> DataFrame:
    """One Arrow pass over a text column, without a shuffle.

    ``keep`` columns pass through. ``make`` runs once in each task; the function that it returns turns some
    texts (UTF-8 bytes or None) into one array for each of ``fields`` (a DDL string), whose names are new.
    """
    rows = docs.select(*[col(c) for c in keep], col(text).cast("binary").alias(fresh(docs, "raw")))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(fields).fields])
    names = schema.fieldNames()

    def run(batches):
        step = make()
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 1):
                made = step(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)

    return rows.mapInArrow(run, schema)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root), root being the smallest node reachable; only nodes of some edge appear.

    Alternates large-star and small-star steps until the edges no longer change. Each step sends a node's
    neighbours to the smallest of them, so a hub of any degree is one aggregated minimum and one join of
    its edges with that single row, which adaptive execution splits where it is skewed. Edges with a null
    end are ignored. Raises when ``max_rounds`` do not suffice.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(col(a).isNotNull() & col(b).isNotNull())
    pairs = written(pairs.distinct())
    seen = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        pairs = written(small)
        now = pairs.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(roots) if pairs.columns else spark.createDataFrame([], found.schema)
