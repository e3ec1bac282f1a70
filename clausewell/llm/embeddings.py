"""Embedding near-duplicates with randomised-rotation binary codes.

Every distinct vector gets, once, a code: the signs of its unit vector under a random rotation (one bit a dimension), with a
correction factor, the inner product of the code with what it stands for; and for its turn as the other of a pair
its rotated components in ``LEVELS`` steps, kept as bit planes. The inner product of one vector's code with another's
planes is a few ANDs and bit counts; over the factor it is an unbiased estimate of the cosine. Its error for a
pair at the threshold has standard deviation sqrt(1 - t^2) sqrt((1 - f^2) / f^2) / sqrt(d - 1), to which the steps add theirs;
only pairs whose estimate plus ``sigmas`` of them reaches the threshold are computed in double precision.

Labels of any size are cut into blocks of about ``block`` vectors; a tile of two blocks is first judged on
codes and planes alone, and only the vectors with a pair that the estimates leave open go to the tile a second time, as
vectors. So a task holds two blocks, and a label of a third of all rows is many tasks. The comparisons of a label grow
with the square of its distinct vectors, as the contract (all pairs of equal label) asks; copies collapse before. A tile
returns a row for each linked vector (how many links, and its root in the tile's spanning forest), never its pairs.

Defined results: vectors that are null, zero, hold null or non-finite components, or have a null label link
with nothing, likewise rows with a null id; vectors of different lengths do not link; repeated rows count
as vectors of their own; an empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, components, table, written


def rotation(d: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


#: Steps of the rotated components of the second of a pair, two to the power of the planes.
PLANES = 4
LEVELS = 1 << PLANES
CODE = "code binary, factor double, planes binary, low double, step double, total double"


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, zeros at the end."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """The fields of CODE for rows of unit vectors: packed signs, the factors <code, rotated>, and the rotated components as
    bit planes of low + step * level, with their sum."""
    turned = unit @ turn.T
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum((high - low) / (LEVELS - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    planes = np.concatenate([packed((level >> k & 1).astype(np.uint8)) for k in range(PLANES)], axis=1)
    total = low * unit.shape[1] + step * level.sum(axis=1)
    return packed((turned >= 0).astype(np.uint8)), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1]), planes, low, step, total


class Codes:
    """The fields of CODE of some vectors of ``dims`` components, as arrays."""

    def __init__(self, rows: pd.DataFrame, dims: int):
        words = -(-dims // 64)
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(-1, words)
        self.planes = np.frombuffer(b"".join(rows["planes"]), np.uint64).reshape(-1, PLANES, words)
        self.low, self.step, self.total = (rows[n].to_numpy() for n in ("low", "step", "total"))
        self.ones, self.dims = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64), dims
        self.factor = np.minimum(rows["factor"].to_numpy(), 1.0)

    def open_pairs(self, own: np.ndarray, first: int, least: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one of ``own`` and one from ``first`` on whose cosine the estimate does not put under ``least``."""
        level = np.zeros((len(own), len(self.code) - first), np.int32)
        for k in range(PLANES):
            for w in range(self.code.shape[1]):
                level += np.bitwise_count(self.code[own, None, w] & self.planes[None, first:, k, w]).astype(np.int32) << k
        f, d = self.factor[own, None], self.dims
        inner = 2 * (self.low[first:] * self.ones[own, None] + self.step[first:] * level) - self.total[first:]
        spread = max(0.0, 1 - least**2) * (1 - f * f) / max(1, d - 1) + self.step[first:] ** 2 / 12
        x, y = np.nonzero(inner / np.sqrt(d) + sigmas * np.sqrt(spread) + 1e-4 >= least * f)
        return own[x], y + first


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # norms of extreme components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def distinct_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(label, dims, node, n, vector) and CODE: one row for each distinct vector that may link."""
    e = col(embedding)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(col(vec_id).isNotNull() & col(label).isNotNull() & e.isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.groupBy(col(label).alias("label"), e.alias("vector")).agg(F.min(col(vec_id)).alias("node"), F.count("*").alias("n"))
    rows = rows.select("label", F.size("vector").alias("dims"), "node", "n", "vector")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(CODE).fields])

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            made: list[list] = [[None] * batch.num_rows for _ in range(6)]
            dims = batch.column(1).to_numpy()
            flat = [np.asarray(v.values, np.float64) for v in batch.column(4)]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in turns:
                    turns[d] = rotation(d)
                fields = encode(units(np.stack([flat[i] for i in at])), turns[d])
                for field, values in zip(made, fields, strict=True):
                    for i, v in zip(at.tolist(), values, strict=True):
                        field[i] = v.tobytes() if values.ndim > 1 else float(v)
            kinds = [f.dataType == T.BinaryType() for f in schema.fields[-6:]]
            arrays = [pa.array(x, pa.binary() if b else pa.float64()) for x, b in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a[i] with b[i]: least roots spread along the links, then along themselves, until nothing moves."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(n: int, split: int | None):
    """(numbers of the first of a pair, from where on the second may be): 256 at a time of one block, or of the first of two."""
    for i in range(0, n if split is None else split, 256):
        yield np.arange(i, min(i + 256, n if split is None else split)), (i if split is None else split)


def undecided(rows: pd.DataFrame, dims: int, split: int | None, least: float, sigmas: float) -> np.ndarray:
    """Whether each row, the vectors of one block or (first ``split``) of two, has a pair that the estimates leave open."""
    codes, met = Codes(rows, dims), np.zeros(len(rows), bool)
    for own, first in _blocks(len(rows), split):
        x, y = codes.open_pairs(own, first, least, sigmas)
        apart = x != y
        met[x[apart]] = met[y[apart]] = True
    return met


def compare(rows: pd.DataFrame, dims: int, split: int | None, least: float, sigmas: float) -> pd.DataFrame:
    """Links among the rows as in ``undecided``, open pairs in double precision: node, links (copies counted), root."""
    unit, codes = units(np.stack(rows["vector"].to_list()).astype(np.float64)), Codes(rows, dims)
    weight, count = rows["n"].to_numpy(), np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))
    for own, first in _blocks(len(rows), split):
        x, y = codes.open_pairs(own, first, least, sigmas)
        x, y = x[y > x], y[y > x]
        linked = [np.einsum("ij,ij->i", unit[x[k : k + 50_000]], unit[y[k : k + 50_000]]) >= least for k in range(0, len(x), 50_000)]
        keep = np.concatenate(linked) if linked else np.zeros(0, bool)
        x, y = x[keep], y[keep]
        count += np.bincount(x, weights=weight[y], minlength=len(rows)).astype(np.int64) + np.bincount(y, weights=weight[x], minlength=len(rows)).astype(np.int64)
        if len(x):
            root = merge(root, x, y)
    at = np.flatnonzero(count)
    node = rows["node"].to_numpy()
    return pd.DataFrame({"node": node[at], "links": count[at], "root": node[root[at]]})


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, sigmas: float = 6.0, block: int = 2048
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    rows = written(distinct_vectors(vectors, vec_id, embedding, label))
    coded = ["node", "n", *T.StructType.fromDDL(CODE).fieldNames()]
    sizes = rows.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    tiled = rows.select("label", "dims", *coded).join(sizes, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["label", "dims", "i", "j"]
    tiled = tiled.select("label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *coded)

    def laid_out(key, pdf):
        """The rows of a tile with the first block's before the second's, and how many those are (None: one block)."""
        pdf = pdf.assign(_second=pdf["own"] != key[2]).sort_values(["_second", "node"], kind="stable")
        return pdf, None if key[2] == key[3] else int((~pdf["_second"]).sum())

    def probe(key, pdf):
        pdf, split = laid_out(key, pdf)
        return pdf.loc[undecided(pdf, int(key[1]), split, least, sigmas), ["label", "dims", "own", "node"]].assign(i=key[2], j=key[3])[[*names]]

    def verify(key, pdf):
        pdf, split = laid_out(key, pdf)
        return compare(pdf, int(key[1]), split, least, sigmas)

    names = ["label", "dims", "i", "j", "own", "node"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    open_ = tiled.groupBy(*key).applyInPandas(probe, f"label {kinds['label']}, dims int, i int, j int, own int, node {kinds['node']}")
    open_ = open_.join(rows.select("label", "dims", "vector", *coded), ["label", "dims", "node"])
    ids = kinds["node"]
    found = written(open_.groupBy(*key).applyInPandas(verify, f"node {ids}, links bigint, root {ids}"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root"), "node", "root").withColumnRenamed("node", "linked")
    known = rows.select("label", "dims", "node", "n", "vector").join(links, "node", "left")
    known = known.join(roots, known["node"] == roots["linked"], "left")
    known = known.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component"))
    all_ = vectors.select(col(vec_id).alias("vec_id"), col(embedding).alias("v"), col(label).alias("l"))
    out = all_.join(known, ["l", "v"], "left")
    one = F.when(F.col("vec_id").isNotNull(), F.col("component"))
    out = out.select("vec_id", F.when(one.isNotNull(), F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"), F.coalesce(one, F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector of ``embeddings``: its links at cosine 0.93 within its label, and its component."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
