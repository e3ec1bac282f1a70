"""Places and running hashes in an order, and digests of ordered pieces, when one key may hold any share of the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, written


def _changes(batch: pa.RecordBatch, keys: list[int], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row's key is not that of the row before it, ``last`` being the key before the batch; and the batch's last key."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    new[0] = tuple(batch.column(k)[0].as_py() for k in keys) != last
    return new, tuple(batch.column(k)[n - 1].as_py() for k in keys)


def placed(rows: DataFrame, keys: list[str], order: list[Column], lanes: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """rows with ``place``, their rank from 0 among the rows of equal ``keys`` by ``order`` (null keys are a key), and for each
    bigint column of ``lanes`` the exclusive or of all values up to and with the row, in the column's place.

    Rows are dealt by ranges of (keys, order), so a key of any size is split; each task ranks what it holds, and where a
    key goes on from the ranges before, a table of one row a range adds what came there. rows are read twice (bounds of
    the ranges, then the rows), so they should be cheap to make. New names must not be columns of rows.
    """
    at, part, head = (fresh(rows, n) for n in ("at", "part", "head"))
    by = [*[col(k).asc_nulls_first() for k in keys], *order]
    dealt = (rows.repartitionByRange(*by) if by else rows).sortWithinPartitions(*by)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"`{place}` bigint, `{part}` int, `{at}` bigint, `{head}` boolean").fields])
    own, lane = [rows.columns.index(k) for k in keys], [rows.columns.index(x) for x in lanes]

    def run(batches):
        task, last, seen, count, groups = TaskContext.get().partitionId(), None, 0, 0, 0
        sums = np.zeros(len(lane), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, last = _changes(batch, own, last)
            i = np.arange(n)
            start = np.maximum.accumulate(np.where(new, i, -1))
            ranks = np.where(start < 0, count + i, i - start)
            columns = list(batch.columns)
            for j, k in enumerate(lane):
                v = batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.bitwise_xor.accumulate(v)
                before = np.where(start < 0, sums[j], (upto ^ v)[start])
                columns[k] = pa.array(upto ^ before)
                sums[j] = columns[k][n - 1].as_py()
            heads = groups + np.cumsum(new) == 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ranks), pa.array(np.full(n, task, np.int32)), pa.array(seen + i), pa.array(heads)], names=schema.fieldNames())
            seen, count, groups = seen + n, int(ranks[-1]) + 1, groups + int(new.sum())

    dealt = written(dealt.mapInArrow(run, schema))
    key = F.struct(F.lit(0), *[col(k) for k in keys])
    tail = F.struct(key.alias("key"), col(place).alias("place"), col(head).alias("head"), *[col(x).alias(f"x{j}") for j, x in enumerate(lanes)])
    ends = dealt.groupBy(part).agg(F.min_by(key, at).alias("first"), F.max_by(tail, at).alias("tail")).orderBy(part).collect()  # a row a range
    more, last, count, sums = [], None, 0, [0] * len(lanes)
    for r in ends:
        on = r["first"] == last
        if on:
            more.append((r[part], count, *sums))
        whole = on and r["tail"].head
        count = r["tail"].place + 1 + (count if whole else 0)
        sums = [r["tail"][f"x{j}"] ^ (sums[j] if whole else 0) for j in range(len(lanes))]
        last = r["tail"].key
    names = [fresh(dealt, f"m{j}") for j in range(len(lanes) + 1)]
    to = fresh(dealt, "to")
    offsets = dealt.sparkSession.createDataFrame(more, f"`{to}` int, " + ", ".join(f"`{n}` bigint" for n in names))
    joined = dealt.join(F.broadcast(offsets), col(part) == col(to), "left")  # at most a row a range
    add = lambda n: F.when(col(head), F.coalesce(col(n), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    fixed = {place: col(place) + add(names[0])} | {x: col(x).bitwiseXOR(add(n)) for x, n in zip(lanes, names[1:], strict=True)}
    return joined.select(*[fixed.get(c, col(c)).alias(c) for c in [*rows.columns, place]])


def streamed(rows: DataFrame, key: str, order: list[str], fields: str, make: Callable) -> DataFrame:
    """One row for each key: ``key`` and ``fields``, made of its rows in order.

    ``make()`` gives an object with ``add(row: dict)`` and ``done() -> tuple``. A key's rows go past its object one after another
    in the task that holds the key, sorted by Spark (which spills); only the object's state is kept. What is inherently
    sequential, as a hash of a whole sequence, needs that; rows should be few and large pieces.
    """
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(fields).fields])

    def run(batches):
        last, held = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is None or row[key] != last:
                    if held is not None:
                        out.append((last, *held.done()))
                    last, held = row[key], make()
                held.add(row)
            if out:
                yield _batch(out, schema)
        if held is not None:
            yield _batch([(last, *held.done())], schema)

    return rows.repartition(col(key)).sortWithinPartitions(col(key), *[col(c) for c in order]).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=arrow.names)


class Joined:
    """SHA-256 of the pieces of a key, a comma between two of them."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        if self.some:
            self.sha.update(b",")
        self.sha.update(row["piece"].encode())
        self.some = True

    def done(self) -> tuple:
        return (self.sha.hexdigest(),)
