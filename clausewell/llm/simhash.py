"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, components.

A fingerprint has 64 bits; two that differ in at most ``max_bits`` agree on at least ``keep`` whole blocks
when the bits are cut into max_bits + keep blocks, so they meet in the bucket of those blocks' bits.
``keep`` grows with the number of distinct fingerprints, so that a bucket of unrelated fingerprints stays
small at every size; the links found are the same for each choice.

Groups stay bounded and linear. Copies collapse first (one row per fingerprint). Buckets with one member go.
A bucket of up to ``max_bucket`` fingerprints is compared in numpy inside its task, which returns a spanning
forest of its links and not its pairs. Fingerprints of a larger bucket meet instead through every point within
max_bits / 2 bits of them (two fingerprints are within max_bits exactly if they share such a point), which
costs the same number of rows for each, whatever the bucket's size: no bucket is capped.

Defined results: a null text counts as an empty one, whose fingerprint is zero; rows with a null doc_id get a
fingerprint, and the smallest id of their component (null if it has none); repeated rows are each returned; an empty table
gives an empty result; other columns pass through under any name.

Known limit: near copies whose fingerprints differ in over max_bits bits are not linked; a few changed words in a short
text are enough for that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, components, fresh, map_text, table, written

#: A-Z to a-z, all white space to blanks, the rest as it is.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
TILE = 255


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash; a bit is 1 if it is set in over half of the shingles' hashes."""
    parts = [p for p in (text or b"").translate(PLAIN).split(b" ") if p]
    if not parts:
        return 0
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - shingle + 1)
    last = ends[shingle - 1 :] if len(parts) >= shingle else ends[-1:]
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    hashes = np.array([digest(whole[a:b], 42) for a, b in zip(starts.tolist(), last.tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, TILE * 64):
        bits = np.unpackbits(hashes[k : k + TILE * 64].view(np.uint8)).reshape(-1, 64)
        bits = np.concatenate([bits, np.zeros((-len(bits) % TILE, 64), np.uint8)]).reshape(-1, TILE, 64)
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp", shingle: int = 4) -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long."""
    step = lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]
    return map_text(docs, text, keep, f"`{name}` bigint", lambda: step)


def blocks_kept(distinct: int, max_bits: int, most: int = 8, unrelated: float = 1.0) -> int:
    """The least number of agreeing blocks whose buckets hold under ``unrelated`` unrelated fingerprints each on average,
    ``most`` beyond that: fewer blocks are fewer rows for a fingerprint, and a small bucket is quickly compared. The links
    found are the same for each choice."""
    return next((k for k in range(1, most) if distinct / 2 ** (64 * k / (max_bits + k)) < unrelated), most)


def masks(max_bits: int, keep: int) -> list[int]:
    """Signed 64-bit masks of every choice of ``keep`` among max_bits + keep blocks."""
    n = max_bits + keep
    cuts = [64 * i // n for i in range(n + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [signed(sum(c)) for c in combinations(own, keep)]


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for members of fps that are linked within it: as many edges as a spanning forest has."""
    n = len(fps)
    root, bits = np.arange(n), fps.view(np.uint64)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= max_bits) + i + 1
        if len(near):
            met = np.unique(root[np.append(near, i)])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    moved = root != np.arange(n)
    return fps[moved], fps[root[moved]]


def links(fps: DataFrame, max_bits: int = 4, max_bucket: int = 4096) -> DataFrame:
    """fps: distinct non-null longs ``fp`` -> edges (a, b) that connect whatever links of at most max_bits (an even number)
    differing bits connect."""
    if max_bits % 2:
        raise ValueError("max_bits has to be even, for the fingerprints of large buckets")
    keep = blocks_kept(fps.count(), max_bits)
    options = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks(max_bits, keep))]
    met = fps.select("fp", F.explode(F.array(*options)).alias("key")).select("fp", "key.k", "key.bits")
    counts = written(met.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    members = met.join(counts, ["k", "bits"])
    small = members.where(F.col("n") <= max_bucket).groupBy("k", "bits").agg(F.collect_list("fp").alias("fps"))

    def compare(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own in batch.column(0):
                x, y = _forest(np.sort(own.values.to_numpy(zero_copy_only=False)), max_bits)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    near = small.select("fps").mapInArrow(compare, "a bigint, b bigint").distinct()
    hot = written(members.where(F.col("n") > max_bucket).select("fp").distinct())
    if hot.isEmpty():
        return near
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    flips = [signed(sum(1 << i for i in c)) for k in range(max_bits // 2 + 1) for c in combinations(range(64), k)]
    flip = F.from_json(F.lit("[" + ",".join(map(str, flips)) + "]"), "array<bigint>")
    ball = hot.select("fp", F.explode(flip).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    centre = ball.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).where("b <> c").select("point", "b")
    return near.union(ball.join(centre, "point").select(F.col("fp").alias("a"), "b").where("a <> b").distinct())


def classes(rows: DataFrame, doc_id: str, fp: str, max_bits: int = 4, **options) -> DataFrame:
    """(fp, component, root): for each fingerprint the smallest doc_id reachable by links, and the fingerprint that stands for what is linked."""
    own = written(rows.groupBy(col(fp).alias("fp")).agg(F.min(col(doc_id)).alias("least")))
    roots = components(links(own.select("fp"), max_bits, **options), "a", "b")
    rooted = written(own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("fp", "component", "root")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each component, that of smallest id, and one of its rows where rows repeat. Rows that share an id but
    not a fingerprint are documents of their own, of which a component keeps that of smallest fingerprint; documents with a
    null id stay. Columns are left as they are."""
    fp, key, kept, root = (fresh(docs, n) for n in ("fp", "key", "kept", "root"))
    rows = written(fingerprints(docs.where(col(doc_id).isNotNull()), docs.columns, text, fp))
    found = classes(rows, doc_id, fp, **options).select(F.col("fp").alias(fp), F.col("component").alias(kept), F.col("root").alias(root))
    least = rows.groupBy(fp).agg(F.min(col(doc_id)).alias(key)).join(found, fp).where(F.col(key) == F.col(kept))
    least = least.groupBy(root, kept).agg(F.min(fp).alias(key)).drop(root)
    rows = rows.join(least, (col(doc_id) == F.col(kept)) & (F.col(fp) == F.col(key)), "left_semi").dropDuplicates([doc_id, fp])
    return rows.select(*[col(c) for c in docs.columns]).unionByName(docs.where(col(doc_id).isNull()))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its fingerprint and the smallest doc_id of its component."""
    rows = written(fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]))
    found = classes(rows, "doc_id", "fp")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, "fp").select("doc_id", hex_.alias("fingerprint"), F.col("component").alias("component_id"))
