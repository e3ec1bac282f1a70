"""Importance resampling of documents towards a target text distribution, by hashed n-grams.

A 256-byte table lower-cases A-Z and turns every ASCII byte that is no digit or letter into a blank, so ``bytes.split`` gives the words
of UTF-8 text; crc32 of an n-gram is crc32 of a blank and its last word, seeded with the crc32 of the n-gram before it. Counters of
each task's buckets reduce to the two distributions, whose log ratio is a bucket's gain; a document's weight is the sum over its
features, and Gumbel noise keyed by its id turns the best weights into a draw without replacement.

Scale: texts are read twice and never shuffled. The first pass leaves at most ``buckets`` rows a task; sums of
``buckets`` rows reach the driver and every task of the second pass (80 kB each at 10,000). Ranks come from ranges of the
scores of drawn candidates, so no task sorts them all. A text is cut at blanks into pieces of PIECE bytes, of which
one is split at a time (a word longer than that is one piece).

Defined results: a null or empty text has no words, no features and weight 0, but a score; a null id is noise of the empty id and comes last
among ties; equal rows are ranked in any order, all of them; an empty table draws nothing; an empty target has every t = T = 0.
Only the columns named are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, col, map_text, table, written
from .ordered import placed

#: Lower case for A-Z; blanks for ASCII other than digits and letters; all else as it is.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def words(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    start = 0
    while start < len(text):
        end = start + piece
        if end < len(text):
            part = text[start:end].translate(LETTERS)
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # one word reaches beyond the piece
                more = text[end : end + piece].translate(LETTERS)
                cut = more.find(b" ")
                cut = cut if cut < 0 else len(part) + cut
                part, end = part + more, end + piece
            end = start + cut + 1 if cut >= 0 else len(text)
        yield text[start:end].translate(LETTERS).split()
        start = end


def features(text: bytes | None, n: int = 3, piece: int = PIECE) -> Iterator[list[int]]:
    """crc32 of all runs of 1 to n consecutive words, repeats kept, some at a time."""
    tail: list[bytes] = []
    for new in words(text or b"", piece):
        own = tail + new
        hashes = list(map(crc32, own))
        yield hashes[len(tail) :]
        blank = [b" " + w for w in own]
        for k in range(2, n + 1):
            hashes = list(map(crc32, blank[k - 1 :], hashes))
            yield hashes[max(0, len(tail) - k + 1) :]
        tail = own[-(n - 1) :] if n > 1 else []


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000, n: int = 3) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket; buckets without any are absent."""

    def run(batches):
        counts = Counter()
        for batch in batches:
            for part in bounded(batch, 0):
                for value in part.column(0).to_pylist():
                    for some in features(value, n):
                        counts.update((np.array(some, np.int64) % buckets).tolist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], names=["bucket", "n"])

    parts = texts.select(col(text).cast("binary").alias("raw")).mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str = "text", buckets: int = 10_000, n: int = 3) -> np.ndarray:
    """The gain of each bucket in thousandths, from add-one smoothed counts of both tables."""
    both = [bucket_counts(d, text, buckets, n).select(F.lit(k).alias("side"), "bucket", "n") for k, d in enumerate((raw, target))]
    counts = np.zeros((2, buckets), np.int64)
    for r in both[0].union(both[1]).collect():  # 2 * buckets rows at most
        counts[r.side, r.bucket] = r.n
    (s, t), (whole_s, whole_t) = counts.tolist(), counts.sum(1).tolist()
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(whole_s + buckets) / (float(a + 1) * float(whole_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text", n: int = 3) -> DataFrame:
    """keep columns, n_words, n_features, weight: the gains of a text's features added."""

    def make():
        def step(values):
            found = []
            for value in values:
                n_words = n_features = weight = 0
                for k, some in enumerate(features(value, n)):
                    n_words += len(some) if k % n == 0 else 0
                    n_features += len(some)
                    weight += int(gain[np.array(some, np.int64) % len(gain)].sum())
                found.append((n_words, n_features, weight))
            return [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]

        return step

    return map_text(docs, text, keep, "n_words bigint, n_features bigint, weight bigint", make)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise in thousandths, a function of the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 5, least: int = 20, buckets: int = 10_000, n: int = 3, seed: int = 42
) -> DataFrame:
    """doc_id, n_features, weight, score and rank: of the documents of ``least`` words or more, ``percent`` in a hundred are drawn."""
    given = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    rows = weighed(given, gains(given, target.select(col(text).alias("text")), "text", buckets, n), ["doc_id"], "text", n)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))  # narrow; the second and last pass over the texts
    able = F.col("n_words") >= least
    drawn = rows.where(able).count() * percent // 100
    ranked = placed(rows.where(able), [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    ranked = ranked.withColumn("rank", rank).drop("place")
    return ranked.union(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).drop("n_words")


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose ids are drawn."""
    ids = resample(docs, target, doc_id=doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, col(doc_id).eqNullSafe(F.col("_drawn")), "left_semi")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards ``benchmark``, its score, and its rank if it is drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
