"""Rolling hashes of substrings of given lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Distinct hashes that tasks filter by at most; with more, all hashes go to the join.
SENT = 1_000_000


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** i modulo prime for i below n."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class Roller:
    """Hashes of all substrings of a length: sums of characters times powers, of two primes, 62 bits together."""

    def __init__(self):
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1024)
            self.up = [_powers(b, p, self.n) for b, p in zip(BASES, PRIMES, strict=True)]
            self.down = [_powers(pow(b, -1, p), p, self.n) for b, p in zip(BASES, PRIMES, strict=True)]

    def sums(self, text: str) -> tuple[int, list[np.ndarray]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self._grow(len(codes) + 1)
        n = len(codes)
        return n, [np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:n] % np.uint64(p), dtype=np.uint64)]) for up, p in zip(self.up, PRIMES, strict=True)]

    def hashes(self, n: int, sums: list[np.ndarray], size: int) -> np.ndarray:
        """Of the n - size + 1 substrings of ``size`` characters, in order."""
        out = np.zeros(n - size + 1, np.uint64)
        for total, down, p in zip(sums, self.down, PRIMES, strict=True):
            part = (total[size:] - total[: n - size + 1]) % np.uint64(p) * down[: n - size + 1] % np.uint64(p)
            out = out << np.uint64(31) | part
        return out.astype(np.int64)


def hashed(texts: DataFrame, text: str, lengths: list[int], whole: bool = False, own: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """texts with n, h and at: a row for each distinct substring of each of ``lengths``, and where it first starts (from 0).

    whole: only the text itself; own: only the length in that column; among(n, h): only hashes that are there, which is
    checked in the tasks where SENT rows suffice and else left to the join that follows. A null text has none."""
    schema = T.StructType([*texts.schema.fields, *T.StructType.fromDDL("n int, h bigint, at int").fields])
    k, of = texts.columns.index(text), texts.columns.index(own) if own else None
    sent = None
    if among is not None:
        kept = among.select("n", "h").distinct()
        if kept.limit(SENT + 1).count() <= SENT:
            rows = kept.toPandas()  # SENT rows at most
            sent = texts.sparkSession.sparkContext.broadcast({int(n): np.sort(x["h"].to_numpy()) for n, x in rows.groupby("n")})

    def run(batches):
        roller = Roller()
        for batch in batches:
            row, n, h, at, count = [], [], [], [], 0
            sizes = batch.column(of).to_pylist() if own else None
            for i, value in enumerate(batch.column(k).to_pylist()):
                if value is None:
                    continue
                m, sums = roller.sums(value)
                for size in (m,) if whole else (sizes[i],) if own else lengths:
                    if not 0 < size <= m:
                        continue
                    found, first = np.unique(roller.hashes(m, sums, size), return_index=True)
                    if sent is not None:
                        wanted = sent.value.get(size, np.empty(0, np.int64))
                        place = np.minimum(np.searchsorted(wanted, found), max(0, len(wanted) - 1))
                        keep = wanted[place] == found if len(wanted) else np.zeros(len(found), bool)
                        found, first = found[keep], first[keep]
                    row.append(np.full(len(found), i)), n.append(np.full(len(found), size, np.int32)), h.append(found), at.append(first.astype(np.int32))
                    count += len(found)
                if count > 1 << 20:
                    yield _made(batch, row, n, h, at, schema)
                    row, n, h, at, count = [], [], [], [], 0
            if count:
                yield _made(batch, row, n, h, at, schema)

    return texts.mapInArrow(run, schema)


def _made(batch: pa.RecordBatch, row: list, n: list, h: list, at: list, schema: T.StructType) -> pa.RecordBatch:
    picked = batch.take(pa.array(np.concatenate(row)))
    return pa.RecordBatch.from_arrays([*picked.columns, *[pa.array(np.concatenate(x)) for x in (n, h, at)]], names=schema.fieldNames())
