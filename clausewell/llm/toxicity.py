"""Toxicity: a linear-chain conditional random field over words, in numpy.

A word's features are the hashed character n-grams (``SIZES`` bytes, lower case) that start in it; a chain is
a sentence or line, and of a longer one each ``CHAIN`` words. The two-state field (toxic or not) is trained on labelled words:
a word of a toxic document that holds an n-gram far more frequent in toxic documents than in others is
toxic, every other word is not. Forward-backward marginals of the words aggregate to a document's score
(a logistic function of their expected count, share and maximum, fitted on labelled documents that did
not choose the n-grams) and give the offending places.

Training is on the driver, on the whole texts of at most ``per_class`` labelled documents of each class (lowest hash,
outside the held-out fifth, whose labels are not read at all); the model is at most ``max_features`` weights. Scoring is
one Arrow pass over all whole texts without a shuffle; a long text goes by pieces of about ``SLICE`` bytes, cut at places
that depend on nothing but the text, so memory does not grow with it.

Defined results: a null or empty text has no words and the score of no evidence; without labelled rows of
both classes the score is the share of ones (0 without any); equal texts get equal scores, in repeated rows and under a
null id as well; an empty table gives an empty result; the columns kept pass through, and new columns get underscores
where their names are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, map_text, table
from .quality import labelled, trainable

SIZES, BITS, CHAIN, SLICE = (4, 5, 6, 8), 22, 512, 1 << 19
#: Of a byte: its lower case if it is in a word, 10 if a chain ends there, else 32.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 10 if b in b".!?\n\r" else 32 for b in range(256)], np.uint8)
MASKS = [np.uint64((1 << (8 * n)) - 1) for n in SIZES]
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(text: np.ndarray) -> list[np.ndarray]:
    """For each size the bucket of the n-gram at each byte of a folded text."""
    wide = np.concatenate([np.where(text == 10, 32, text).astype(np.uint8), np.full(8, 32, np.uint8)])
    at = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[: len(text)]).view(np.uint64).reshape(-1)
    return [((at & m) * k >> np.uint64(64 - BITS)).astype(np.int64) for m, k in zip(MASKS, MULTIPLIERS, strict=True)]


def tokens(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words of a folded text, and how many ends of chains come before each."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (text > 32).view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.cumsum(text == 10)[starts] if len(starts) else starts


def chains(chain: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of words of equal chain, longest first; of at most ``most`` words, if given."""
    at = np.flatnonzero(np.diff(chain, prepend=-1))
    n = np.diff(np.append(at, len(chain)))
    most = most or max(1, len(chain))
    parts = -(-n // most)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(at, parts) + k * most
    sizes = np.minimum(most, np.repeat(n, parts) - k * most)
    order = np.argsort(-sizes, kind="stable")
    return starts[order], sizes[order]


def marginals(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the toxic state: forward (with the word), backward, and both together. e: emission log-odds, t: 2 x 2 transitions."""
    x = np.exp(t)
    f, b = e.copy(), np.zeros_like(e)
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -k, "left")) for k in range(longest + 1)]  # chains longer than k
    for k in range(1, longest):
        i = starts[: active[k]] + k
        odds = np.exp(np.clip(f[i - 1], -30, 30))
        f[i] += np.log((x[0, 1] + odds * x[1, 1]) / (x[0, 0] + odds * x[1, 0]))
    for k in range(longest - 2, -1, -1):
        i = starts[: active[k + 1]] + k
        odds = np.exp(np.clip(e[i + 1] + b[i + 1], -30, 30))
        b[i] = np.log((x[1, 0] + odds * x[1, 1]) / (x[0, 0] + odds * x[0, 1]))
    return f, b, f + b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Field:
    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets  # sorted pairs size * 2^BITS + bucket
        self.w = np.zeros(len(buckets))
        self.bias, self.t = -3.0, np.zeros((2, 2))
        self.doc = np.zeros(4)
        self.constant: float | None = None
        self._dense = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def features(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) of every chosen n-gram in a word."""
        inside = text > 32
        word = np.cumsum(np.bincount(starts, minlength=len(text))[: len(text)]) - 1
        found = []
        for k, g in enumerate(grams(text)):
            key = g + (k << BITS)
            at = np.searchsorted(self.buckets, key)
            at[at == len(self.buckets)] = 0
            hit = np.flatnonzero(inside & (self.buckets[at] == key))
            found.append((word[hit], at[hit]))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def emissions(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros((len(SIZES), 1 << BITS), np.float32)
            self._dense.reshape(-1)[self.buckets] = self.w
        total = np.zeros(len(text) + 1)
        for k, g in enumerate(grams(text)):
            total[:-1] += self._dense[k][g]
        return self.bias + np.add.reduceat(total, np.stack([starts, ends], 1).reshape(-1))[::2]  # word by word

    def logits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of a folded text and their marginal log-odds.

        Emissions are taken from pieces of SLICE bytes that end between words, with the bytes after them that their n-grams reach into;
        chains run over all pieces, so a piece's end changes nothing. Beyond a piece only numbers a word are held."""
        held, a, ended = [], 0, 0
        while a < len(text):
            b = a + SLICE
            if b < len(text):
                stops = np.flatnonzero(text[a:b] <= 32)
                if not len(stops):  # one word reaches beyond the piece
                    while b < len(text) and text[b] > 32:
                        more = np.flatnonzero(text[b : b + SLICE] <= 32)
                        b = b + int(more[0]) if len(more) else b + SLICE
                    b = min(b, len(text))
                else:
                    b = a + int(stops[-1]) + 1
            b = min(b, len(text))
            starts, ends, chain = tokens(text[a:b])
            if len(starts):
                held.append((starts + a, ends + a, chain + ended, self.emissions(text[a : b + max(SIZES)], starts, ends)))
            ended += int(np.count_nonzero(text[a:b] == 10))
            a = b
        if not held:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        starts, ends, chain, e = (np.concatenate(x) for x in zip(*held, strict=True))
        return starts, ends, marginals(e, *chains(chain), self.t)[2]

    def evidence(self, logit: np.ndarray, n: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
        """(docs, 4): 1, log of the expected number of toxic words, their share, and the largest log-odds."""
        p = sigmoid(logit)
        p = np.where(p > 0.05, p, 0)
        count = np.bincount(of, weights=p, minlength=docs)
        top = np.full(docs, -6.0)
        np.maximum.at(top, of, np.clip(logit, -6, 6))
        return np.stack([np.ones(docs), np.log1p(count), np.sqrt(count / np.maximum(n, 1)) * 10, top], axis=1)

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the byte spans of toxic words."""
        scores, spans = [], []
        for held in slices(texts):
            folded = [FOLD[np.frombuffer(t, np.uint8)] for t in held]
            cuts = np.cumsum([0, *(len(t) + 1 for t in folded)])
            s, e, logit = self.logits(np.concatenate([np.append(t, np.uint8(10)) for t in folded]))
            doc = np.searchsorted(cuts, s, "right") - 1
            marks: list[list[tuple[int, int]]] = [[] for _ in held]
            for i in np.flatnonzero(logit > 0).tolist():
                d = int(doc[i])
                marks[d].append((int(s[i] - cuts[d]), int(e[i] - cuts[d])))
            x = self.evidence(logit, np.bincount(doc, minlength=len(held)).astype(float), doc, len(held))
            # the last bits of a float sum can depend on the shape of an array, that is on the texts beside this one
            scores.append(np.round(sigmoid((x * self.doc).sum(axis=1)), 9) if self.constant is None else np.full(len(held), self.constant))
            spans += marks
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def slices(texts: list[bytes]):
    """Lists of texts of about SLICE bytes; a text of more is alone in its list."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def choose(texts: list[bytes], y: np.ndarray, max_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n-grams that tell toxic from other documents, sorted, and whether each is toxic."""
    counts = np.zeros((2, len(SIZES) << BITS), np.int32)
    for t, one in zip(texts, y, strict=True):
        folded = FOLD[np.frombuffer(t, np.uint8)]
        inside = folded > 32
        for k, g in enumerate(grams(folded)):
            counts[int(one)][np.unique(g[inside]) + (k << BITS)] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    least = max(3, n1 // 60)
    some = np.flatnonzero((counts[1] >= least) | (counts[0] >= max(least, n0 // 60)))
    odds = np.log((counts[1][some] + 0.5) / (n1 + 1)) - np.log((counts[0][some] + 0.5) / (n0 + 1))
    strength = np.abs(odds) * np.sqrt(counts[0][some] + counts[1][some])
    best = np.argsort(-strength, kind="stable")[:max_features]
    best = best[np.argsort(some[best])]
    return some[best], (odds[best] > 2.5) & (counts[1][some[best]] >= least)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1000, max_features: int = 8000, steps: int = 60) -> Field:
    """A field for ``label``, learned from the whole texts of the sampled documents."""
    rows = sorted((r.id, r.y, bytes(r.t)) for r in labelled(docs, labels, label, per_class).select("id", "y", "t").distinct().collect())
    y = np.array([r[1] for r in rows])
    if not 0 < y.sum() < len(y):
        field = Field(np.zeros(1, np.int64))
        field.constant = float(y.mean()) if len(y) else 0.0
        return field
    pick = np.random.default_rng(5).permutation(len(rows))
    cut = len(rows) * 3 // 5
    fit, rest = sorted(pick[:cut].tolist()), sorted(pick[cut:].tolist())
    buckets, toxic = choose([rows[i][2] for i in fit], y[fit], max_features)
    field = Field(buckets if len(buckets) else np.zeros(1, np.int64))
    toxic = toxic if len(buckets) else np.zeros(1, bool)
    flat = np.concatenate([np.append(FOLD[np.frombuffer(rows[i][2], np.uint8)], np.uint8(10)) for i in fit])
    cuts = np.cumsum([0, *(len(rows[i][2]) + 1 for i in fit)])
    starts, _, chain = tokens(flat)
    word, feature = field.features(flat, starts)
    own = y[fit][np.searchsorted(cuts, starts, "right") - 1]
    truth = ((np.bincount(word, weights=toxic[feature], minlength=len(starts)) > 0) & (own == 1)).astype(float)
    field.bias = float(np.log(max(1.0, truth.sum()) / max(1.0, len(truth) - truth.sum())))
    _learn(field, word, feature, truth, *chains(chain, CHAIN), steps)
    _calibrate(field, [rows[i][2] for i in rest], y[rest], _share(labels, label))
    return field


def _share(labels: DataFrame, label: str) -> float:
    """The share of ones among the labels that may be learned from."""
    r = trainable(labels, label).agg(F.avg("y")).first()[0]
    return min(0.999, max(0.001, r or 0.0))


def _learn(field: Field, word, feature, truth, starts, sizes, steps: int, rate: float = 0.05, decay: float = 1e-3) -> None:
    """Adam on the conditional log-likelihood: observed minus expected features and transitions."""
    n, weight = len(truth), 1.0 + 4.0 * truth
    last = np.zeros(n, bool)
    last[starts + sizes - 1] = True
    pair = np.flatnonzero(~last[:-1]) if n else np.zeros(0, int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[pair].astype(int), truth[pair + 1].astype(int)), 1)
    p = [field.w, np.array([field.bias]), field.t]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    scale = 1.0 / max(1.0, truth.sum())
    for step in range(1, steps + 1):
        e = p[1][0] + np.bincount(word, weights=p[0][feature], minlength=n)
        f, b, logit = marginals(e, starts, sizes, p[2])
        d = (sigmoid(logit) - truth) * weight
        i = pair
        joint = np.stack([p[2][0, 0] + 0 * i, p[2][0, 1] + e[i + 1] + b[i + 1], f[i] + p[2][1, 0], f[i] + p[2][1, 1] + e[i + 1] + b[i + 1]])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(i) else seen
        g = [np.bincount(feature, weights=d[word], minlength=len(p[0])) * scale + decay * p[0], np.array([d.sum() * scale]), (expected - seen) * scale + decay * p[2]]
        for k, x in enumerate(g):
            m[k] = 0.9 * m[k] + 0.1 * x
            s[k] = 0.999 * s[k] + 0.001 * x * x
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-9)
    field.w, field.bias, field.t = p[0], float(p[1][0]), p[2]


def _calibrate(field: Field, texts: list[bytes], y: np.ndarray, share: float) -> None:
    """Ridge logistic regression of documents on their evidence, by Newton steps, then moved to the share of toxic labels."""
    x = []
    for held in slices(texts):
        for t in held:
            _, _, logit = field.logits(FOLD[np.frombuffer(t, np.uint8)])
            x.append(field.evidence(logit, np.array([len(logit)]), np.zeros(len(logit), int), 1)[0])
    x, w = np.array(x), np.zeros(4)
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        w -= np.linalg.solve(h, g)
    own = min(0.999, max(0.001, float(y.mean())))
    w[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    field.doc = w


def tag(docs: DataFrame, field: Field, keep: list[str], text: str = "text", names: tuple[str, str] = ("score", "toxic_spans")) -> DataFrame:
    """``keep`` columns, the probability of toxicity, and the spans (code points) of toxic words."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = tuple(free(keep, n) for n in names)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def step(texts):
        given = [t or b"" for t in texts]
        scores, spans = shared.value.judged(given)
        points = []
        for t, own in zip(given, spans, strict=True):
            if own:
                before = np.concatenate(([0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)))
                own = [{"start": int(before[a]), "end": int(before[b])} for a, b in own]
            points.append(own)
        return [pa.array(scores), pa.array(points, kind)]

    return map_text(docs, text, keep, f"`{names[0]}` double, `{names[1]}` array<struct<start:int,end:int>>", lambda: step)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: the probability that labels.toxic is 1, and the places of toxic words."""
    docs = table(spark, sf_dir, "documents")
    rows = tag(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
