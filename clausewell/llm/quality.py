"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters of ``WIDTH`` bytes slide over them in steps of ``STRIDE``, and each filter's
largest response is kept for every chunk of ``CHUNK`` bytes (chunks overlap by half and cover the whole
text). A dense layer turns a chunk's pooled responses into a logit; a document's probability is that of
the mean over its chunks.

Training is on the driver, on the whole texts of at most ``per_class`` labelled documents of each class (those of lowest
hash), and the network is a few thousand numbers; scoring is one Arrow pass over all whole texts, without a
shuffle, text by text and ``SLICE`` bytes at a time, so a score depends on nothing but the text.

Defined results: a null or empty text is scored as one chunk without bytes; rows without label, or with
labels that contradict each other, train nothing; without labelled rows of both classes the score is the
share of ones (0.5 without any); equal texts get equal scores, in repeated rows and under a null id as well; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free, fresh, map_text, table

WIDTH, STRIDE, DIMS, FILTERS, HALF = 8, 4, 8, 24, 512
CHUNK = 2 * HALF
#: Bytes that are worked on at once.
SLICE = 1 << 19


def padded(text: bytes) -> np.ndarray:
    """Symbols 1..256 of the bytes, then zeros up to a whole number of half chunks, two at least."""
    n = max(2, -(-len(text) // HALF)) * HALF
    out = np.zeros(n, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    out[: len(text)] += 1
    return out


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": (rng.standard_normal((257, DIMS)) * 0.3).astype(np.float32),
            "w": (rng.standard_normal((WIDTH * DIMS, FILTERS)) / np.sqrt(WIDTH * DIMS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": (rng.standard_normal(FILTERS) * 0.1).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["e"][0] = 0
        self.constant: float | None = None

    def responses(self, symbols: np.ndarray) -> np.ndarray:
        """(positions, FILTERS) before pooling; symbols in whole half chunks, windows past the end see zeros."""
        x = np.concatenate([self.p["e"][symbols], np.zeros((WIDTH, DIMS), np.float32)])
        n = len(symbols) // WIDTH
        out = np.empty((n, WIDTH // STRIDE, FILTERS), np.float32)
        for k in range(WIDTH // STRIDE):
            out[:, k] = x[k * STRIDE : k * STRIDE + n * WIDTH].reshape(n, WIDTH * DIMS) @ self.p["w"]
        return out.reshape(-1, FILTERS) + self.p["b"]

    def half_maxima(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each half chunk's largest responses, over all windows that begin in it and over those that also end in it."""
        every, inner = [], []
        for a in range(0, len(symbols), SLICE):
            more = symbols[a : a + SLICE + WIDTH]
            n = min(SLICE, len(symbols) - a) // STRIDE
            r = self.responses(more)[:n].reshape(-1, HALF // STRIDE, FILTERS)
            inner.append(r[:, : 1 - WIDTH // STRIDE].max(axis=1))
            every.append(np.maximum(inner[-1], r[:, 1 - WIDTH // STRIDE :].max(axis=1)))
        return np.concatenate(every), np.concatenate(inner)

    def score(self, text: bytes) -> float:
        """Of one text, so that its score is a function of it alone. A chunk's windows end in it, as in training."""
        if self.constant is not None:
            return self.constant
        every, inner = self.half_maxima(padded(text))
        pooled = np.maximum(np.maximum(every[:-1], inner[1:]), 0)
        logit = float((pooled @ self.p["v"] + self.p["c"]).astype(np.float64).mean())
        return 1 / (1 + float(np.exp(-min(50.0, max(-50.0, logit)))))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.score, texts), np.float64, len(texts))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, draws: int = 4, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> None:
        """Adam on the logistic loss of chunks, classes weighed equally. Texts are padded symbols; each epoch takes up to
        ``draws`` chunks of each, drawn anew from its whole length, so long texts weigh no more than short ones."""
        rng = np.random.default_rng(seed)
        labels_of, weight_of = labels, np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, per = 0, CHUNK // STRIDE
        sizes = np.array([len(x) // HALF - 1 for x in texts])
        for _ in range(epochs):
            drawn = [(i, HALF * int(k)) for i, n in enumerate(sizes.tolist()) for k in (range(n) if n <= draws else rng.choice(n, draws, replace=False))]
            chunks = np.stack([texts[i][k : k + CHUNK] for i, k in drawn])
            labels, weight = (x[[i for i, _ in drawn]] for x in (labels_of, weight_of))
            order = rng.permutation(len(chunks))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                symbols = chunks[rows]
                r = self.responses(symbols.reshape(-1)).reshape(len(rows), per, FILTERS)
                r[:, -(WIDTH // STRIDE - 1) :] = -1e9  # windows that would see the next chunk
                at = r.argmax(axis=1)
                top = np.take_along_axis(r, at[:, None], 1)[:, 0]
                pooled = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.p["v"] + self.p["c"], -50, 50)))
                d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g = {"v": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
                dr = np.where(top > 0, d[:, None] * self.p["v"], 0)  # (rows, FILTERS)
                g["b"] = dr.sum(axis=0)
                places = at[:, :, None] * STRIDE + np.arange(WIDTH)  # (rows, FILTERS, WIDTH)
                seen = symbols[np.arange(len(rows))[:, None, None], places]
                x = self.p["e"][seen].reshape(len(rows), FILTERS, WIDTH * DIMS)
                g["w"] = np.einsum("rf,rfk->kf", dr, x)
                dx = (dr[:, :, None] * self.p["w"].T[None]).reshape(-1, DIMS)
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], seen.reshape(-1), dx)
                g["e"][0] = 0
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def trainable(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(id, y): labels of 0 or 1 that do not contradict each other, outside the held-out fifth (crc32 of the id as
    text, modulo 5, is 0)."""
    given = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return given.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, y, t): ``per_class`` labelled documents of each class, those of lowest hash, and their whole texts."""
    given = trainable(labels, label, doc_id)
    few = [given.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(per_class) for y in (0, 1)]
    chosen = few[0].union(few[1]).select("id", "y")
    texts = docs.select(col(doc_id).alias("id"), F.coalesce(col(text), F.lit("")).cast("binary").alias("t"))
    return texts.join(F.broadcast(chosen), "id")  # at most 2 x per_class rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000) -> Network:
    """A network for ``label``, fitted on the whole texts of at most ``per_class`` labelled documents of each class."""
    rows = sorted((r.id, r.y, bytes(r.t)) for r in labelled(docs, labels, label, per_class).select("id", "y", "t").distinct().collect())
    y = np.array([r[1] for r in rows], np.float32)
    net = Network()
    if not 0 < y.sum() < len(y):
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    net.fit([padded(text) for _, _, text in rows], y)
    return net


def score(docs: DataFrame, net: Network, keep: list[str], name: str = "score", text: str = "text") -> DataFrame:
    """``keep`` columns and the probability of label 1, for every whole text; ``name`` gets underscores where it is kept already."""
    shared, name = docs.sparkSession.sparkContext.broadcast(net), free(keep, name)
    return map_text(docs, text, keep, f"`{name}` double", lambda: lambda texts: [pa.array(shared.value.scores([t or b"" for t in texts]))])


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """docs whose score is ``least`` or more, all their columns as they were."""
    name = fresh(docs, "score")
    return score(docs, train(docs, labels, **options), docs.columns, name).where(col(name) >= least).drop(name)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: the probability that labels.quality is 1."""
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
