"""Paragraph near-duplicates: MinHash banding tuned for recall, exact Jaccard, components, removals.

Two kinds of unit are compared, over whole texts and all documents:

* each line that has a word. Equal lines collapse first; lines of ``shingle`` words or more are then banded by MinHash
  over their ``shingle``-word shingles, those that share a bucket are compared by exact Jaccard similarity, and
  linked lines form components. ``tuned`` picks as many rows a band as the number of hashes allows, and the bands that
  recall of a pair at the threshold then takes;
* segments of longer lines, for passages inside them: a line is cut before each word whose three-word hash is the
  least within ``reach`` words, so a passage is cut alike wherever it stands (segments have about 2 ``reach`` words).
  Segments are equal or not, which is similarity 1, so they need no bands.

Of each component, and of each set of equal segments, the first occurrence (smallest doc_id, then place) stays.
Further occurrences are marked; marks that touch (nothing but blanks and punctuation between them) make a run, and a run of
``least_run`` words or more is cut. A shorter run stays: single short lines and formulas repeat in clean text as well.

A bucket's lines meet in tasks of at most two blocks of ``block`` of them, and a task returns a spanning forest
of the links, not the pairs: groups are split and never capped. The same lines meet once, however many bands they share.
Texts are read again rather than kept in tables of units: units take more room than the texts, and are cheap to find.

Defined results: a null text has no paragraphs and stays null; documents with a null id are left as they are;
rows that repeat an id with the same text are cut alike; an empty table gives an empty result; columns of the documents
pass through under any name, and new columns get underscores where their names are taken.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, col, components, free, fresh, table, written
from .decontaminate import WORDS

#: WORDS, but line ends stay.
FOLDED = WORDS[:10] + b"\n" + WORDS[11:]
SLICE = 1 << 20
WORD_BASE, RANGE_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so powers have inverses modulo 2^64
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def tuned(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(rows a band, bands): the most rows whose bands reach the recall at the similarity within ``hashes``."""
    fits = [(r, max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**r)))) for r in range(1, hashes + 1)]
    return max((x for x in fits if x[0] * x[1] <= hashes), default=fits[0])


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((31, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


class Ranges:
    """Hashes of ranges of a sequence of values, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, n = base, len(values)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers(base, n), dtype=np.uint64) if n else np.zeros(0, np.uint64)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        back = powers(pow(self.base, -1, 1 << 64), len(self.sums))
        return mixed((self.sums[b] - self.sums[a]) * back[a])


class Words:
    """The words of texts laid end to end, a line end after each: places, line numbers and hashes of word ranges."""

    def __init__(self, flat: bytes):
        data, self.size = np.frombuffer(flat.translate(FOLDED), np.uint8), len(flat)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (data > 32).view(np.int8), [0]))))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.breaks = np.flatnonzero(data == 10)
        self.line = np.searchsorted(self.breaks, self.starts)
        self.hash = Ranges(Ranges(BYTES[data], WORD_BASE)(self.starts, self.ends), RANGE_BASE)
        self.first = np.flatnonzero(np.diff(self.line, prepend=-1))  # the first word of each line that has one
        self.count = np.diff(np.append(self.first, len(self.line)))

    def line_places(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes, of the lines with words."""
        line = self.line[self.first]
        return np.append(0, self.breaks + 1)[line], np.append(self.breaks, self.size)[line]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of shingles of ``size`` words, and the line (its number among lines with words) of each."""
        n = len(self.line) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.line[:n] == self.line[size - 1 :])
        return self.hash(at, at + size), np.searchsorted(self.first, at, "right") - 1

    def segments(self, reach: int, least: int, gram: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last word of the segments, of ``least`` words or more, of lines that are cut."""
        n = len(self.line)
        low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at = np.flatnonzero(self.line[: max(0, n - gram + 1)] == self.line[gram - 1 :])
        low[at] = self.hash(at, at + gram)
        cut = np.zeros(n, bool)
        cut[at] = True
        for k in range(1, min(reach, n - 1) + 1):
            same = self.line[k:] == self.line[:-k]
            cut[k:] &= ~same | (low[k:] < low[:-k])
            cut[:-k] &= ~same | (low[:-k] < low[k:])
        inner = cut.copy()
        inner[self.first] = False
        some = np.add.reduceat(inner, self.first) > 0 if n else np.zeros(0, bool)
        cut[self.first] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], n)
        keep = (b - a >= least) & some[np.searchsorted(self.first, a, "right") - 1]
        return a[keep], b[keep]


def bands(hashes: np.ndarray, at: np.ndarray, rows: int, n: int, seed: int = 29) -> np.ndarray:
    """(sets, n): a hash for each band of ``rows`` least hashes of the sets that start at ``at`` in ``hashes``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(at), n), np.uint64)
    for k in range(n if len(at) else 0):
        key = np.full(len(at), k + 1, np.uint64)
        for _ in range(rows):
            a, b = (np.uint64(x) for x in rng.integers(1, 1 << 63, 2))
            key = mixed(key ^ np.minimum.reduceat(hashes * (a | np.uint64(1)) + b, at))
        out[:, k] = key
    return out


def _forest(names: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets of distinct numbers."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(names[1]), int(names[0]))] if shared >= similarity * (sizes.sum() - shared) - 1e-9 else []
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    of, root, width = np.repeat(np.arange(n), sizes), np.arange(n), int(item.max()) + 1
    order = np.argsort(item, kind="stable")
    holders, first = of[order], np.concatenate(([0], np.cumsum(np.bincount(item))))
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    small = n * width <= 1 << 22
    if small:
        held = np.zeros((n, width), np.float32)
        held[of, item] = 1
    for i in range(n - 1):
        if small:
            if not i % 64:
                block = held[i : i + 64] @ held.T
            shared = block[i % 64]
        else:
            shared = np.zeros(n, np.int64)
            for s in item[cuts[i] : cuts[i + 1]].tolist():
                shared[holders[first[s] : first[s + 1]]] += 1
        near = np.flatnonzero(shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
        near = near[near > i]
        if len(near):
            met = np.unique(root[np.append(near, i)])
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    return [(int(names[i]), int(names[root[i]])) for i in range(n) if root[i] != i]


def _pieces(texts: list[bytes | None]):
    """Lists of (row, offset, bytes) of about SLICE bytes; longer texts are cut at line ends."""
    held, size = [], 0
    for i, text in enumerate(texts):
        a = 0
        while text and a < len(text):
            b = len(text)
            if b - a > SLICE:
                b = text.rfind(b"\n", a, a + SLICE) + 1 or text.find(b"\n", a + SLICE) + 1 or len(text)
            held.append((i, a, text[a:b]))
            size += b - a
            a = b
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


UNIT = "start int, end int, hash bigint, whole boolean"


def _passed(docs: DataFrame, fields: str, found) -> DataFrame:
    """docs (doc, text) -> doc and ``fields``. found(words) has the fields of the units of texts laid end to end, the first two
    being their places, in bytes; these become places in the texts."""
    schema = T.StructType([docs.schema["doc"], *T.StructType.fromDDL(fields).fields])

    def run(batches):
        for batch in batches:
            for part in bounded(batch, 1):
                for held in _pieces(part.column(1).to_pylist()):
                    start, end, *more = found(Words(b"\n".join(p for _, _, p in held)))
                    own = np.cumsum([0, *(len(p) + 1 for _, _, p in held[:-1])])
                    row, base = np.array([x[0] for x in held]), np.array([x[1] for x in held])
                    piece = np.searchsorted(own, start, "right") - 1
                    shift = base[piece] - own[piece]
                    places = [pa.array((x + shift).astype(np.int32)) for x in (start, end)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[piece])), *places, *more], names=schema.fieldNames())

    return docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, schema)


def _units(docs: DataFrame, shingle: int, reach: int, lines: bool = True) -> DataFrame:
    """docs (doc, text) -> doc and UNIT: segments, and lines (whole) as well unless left out."""

    def found(w: Words):
        a, b = w.segments(reach, shingle)
        start, end = w.line_places() if lines else (np.zeros(0, np.int64),) * 2
        first = w.first[: len(start)]
        hash_ = np.concatenate([w.hash(first, first + w.count[: len(start)]), w.hash(a, b)]).view(np.int64)
        whole = np.arange(len(hash_)) < len(start)
        return np.concatenate([start, w.starts[a]]), np.concatenate([end, w.ends[b - 1]]), pa.array(hash_), pa.array(whole)

    return _passed(docs, UNIT, found)


def _banded(docs: DataFrame, shingle: int, rows: int, n: int) -> DataFrame:
    """docs (doc, text) -> doc, start, end, hash, bands of each line; lines of less than a shingle have no bands."""

    def found(w: Words):
        hashes, of = w.shingles(shingle)
        at = np.flatnonzero(np.diff(of, prepend=-1))
        sizes = np.zeros(len(w.first) + 1, np.int64)
        sizes[of[at] + 1] = n
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(bands(hashes, at, rows, n).view(np.int64).reshape(-1)))
        return *w.line_places(), pa.array(w.hash(w.first, w.first + w.count).view(np.int64)), lists

    return _passed(docs, "start int, end int, hash bigint, bands array<bigint>", found)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (text, asked: places of lines) -> hash, shingles (distinct, sorted) of the lines asked for."""

    def run(batches):
        for batch in batches:
            for part in bounded(batch, 0):
                lines = [t[p["start"] : p["end"]] for t, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for p in asked]
                for k in range(0, len(lines), 1024):
                    w = Words(b"\n".join(lines[k : k + 1024]))
                    hashes, of = w.shingles(shingle)
                    order = np.lexsort([hashes, of])
                    hashes, of = hashes[order], of[order]
                    new = np.ones(len(of), bool)
                    new[1:] = (np.diff(of) != 0) | (hashes[1:] != hashes[:-1])
                    hashes, of = hashes[new], of[new]
                    cuts = np.flatnonzero(np.diff(of, prepend=-1))
                    own = of[cuts]
                    sets = [x.tobytes() for x in np.split(hashes, cuts[1:])] if len(cuts) else []
                    name = w.hash(w.first[own], w.first[own] + w.count[own]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(sets, pa.binary())], names=["hash", "shingles"])

    return docs.select(F.col("text").cast("binary"), "asked").mapInArrow(run, "hash bigint, shingles binary")


def _line_roots(given: DataFrame, similarity: float, shingle: int, rows: int, n: int, block: int) -> DataFrame:
    """(hash, first): for each line that occurs again or is linked, the first place (doc, start) of its component."""
    lines = _banded(given, shingle, rows, n)
    reps = written(lines.groupBy("hash").agg(F.first("bands").alias("bands"), F.min(F.struct("doc", "start", "end")).alias("first"), F.count("*").alias("times")))
    met = reps.select("hash", F.explode("bands").alias("band"))
    counts = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = met.join(counts, "band").select("band", "hash", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    tiled = members.withColumn("own", F.pmod(F.xxhash64("hash"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.groupBy("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.array_sort(F.collect_list("hash")).alias("own"))
    # two lines that are near meet in most bands: each set of lines is compared once
    tiled = written(tiled.where(F.size("own") > 1).select("own").distinct())
    each = tiled.select(F.xxhash64("own").alias("tile"), F.explode("own").alias("hash"))
    asked = reps.join(each.select("hash").distinct(), "hash", "left_semi")
    asked = asked.groupBy("first.doc").agg(F.collect_list(F.struct("first.start", "first.end")).alias("asked"))
    needed = _sets(given.join(asked, "doc").select("text", "asked"), shingle).groupBy("hash").agg(F.first("shingles").alias("shingles"))
    tiles = each.join(needed, "hash").groupBy("tile").agg(F.collect_list(F.struct("hash", "shingles")).alias("own")).select("own")

    def compare(batches):
        for batch in batches:
            edges = []
            for own in batch.column(0):
                inner = own.values
                names = inner.field(0).to_numpy()
                if len(names) > 1:
                    edges += _forest(names, [np.frombuffer(b, np.uint64) for b in inner.field(1).to_pylist()], similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    roots = components(tiles.mapInArrow(compare, "a bigint, b bigint"), "a", "b")
    rooted = reps.select("hash", "first", "times").join(roots, reps["hash"] == roots["node"], "left")
    rooted = written(rooted.where("times > 1 or root is not null").select("hash", F.struct("first.doc", "first.start").alias("first"), "root"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root", "left").select("hash", F.coalesce("least", "first").alias("first"))


def repeated_units(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, reach: int = 5, recall: float = 0.9995, hashes: int = 36, block: int = 1024
) -> DataFrame:
    """(doc, start, end): places, in bytes, of lines and segments that are not the first of their kind."""
    given = docs.select(col(doc_id).alias("doc"), col(text).alias("text")).where("doc is not null")
    lines = _line_roots(given, similarity, shingle, *tuned(similarity, recall, hashes), block)
    segments = _units(given, shingle, reach, lines=False).groupBy("hash").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = lines.withColumn("whole", F.lit(True)).union(segments.select("hash", "first", F.lit(False)))
    marked = _units(given, shingle, reach).join(first, ["hash", "whole"])
    return marked.where(F.struct("doc", "start") > F.col("first")).select("doc", "start", "end")


def runs(text: bytes, marks: list[tuple[int, int]], least_run: int) -> list[tuple[int, int]]:
    """Spans to cut: marks merged where only blanks and punctuation lie between, of ``least_run`` words or more; a span of
    whole lines takes its last line end along."""
    plain, out = text.translate(WORDS), []
    for a, b in sorted(marks):
        if out and (a <= out[-1][1] or not plain[out[-1][1] : a].strip()):
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    kept = [(a, b) for a, b in out if len(plain[a:b].split()) >= least_run]
    whole = lambda a, b: (a == 0 or text[a - 1 : a] == b"\n") and text[b : b + 1] == b"\n"
    return [(a, b + 1) if whole(a, b) else (a, b) for a, b in kept]


def without_repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = 20, **options) -> DataFrame:
    """docs with the repeated passages cut out of the text, and n_removed, n_paragraphs (lines), n_words_removed
    and removed (their places in the text given, in code points)."""
    found = repeated_units(docs, doc_id, text, **options)
    key, marks, raw = (fresh(docs, n) for n in ("paragraph_doc", "marks", "raw"))
    found = found.groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(marks))
    rows = docs.join(found, col(doc_id) == col(key), "left")
    rows = rows.select(*[col(c) for c in docs.columns], col(text).cast("binary").alias(raw), col(marks))
    names = [free(docs.columns, n) for n in ("n_removed", "n_paragraphs", "n_words_removed", "removed")]
    more = T.StructType.fromDDL(f"`{names[0]}` bigint, `{names[1]}` bigint, `{names[2]}` bigint, `{names[3]}` array<struct<start:int,end:int>>")
    schema = T.StructType([*docs.schema.fields, *more.fields])
    place, kinds = docs.columns.index(text), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def cut(t: bytes | None, own) -> tuple:
        if t is None:
            return None, 0, 0, 0, []
        spans = runs(t, [(m["start"], m["end"]) for m in own], least_run) if own else []
        if not spans:
            return t.decode(), 0, t.count(b"\n") + 1, 0, []
        cuts = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
        points = np.concatenate(([0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)))
        words = sum(len(t[a:b].translate(WORDS).split()) for a, b in spans)
        return kept.decode(), len(spans), t.count(b"\n") + 1, words, [{"start": int(points[a]), "end": int(points[b])} for a, b in spans]

    def run(batches):
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 2):
                made = list(zip(*map(cut, part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()), strict=True))
                made = [pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                own = [made[0] if k == place else c for k, c in enumerate(part.columns[:-2])]
                yield pa.RecordBatch.from_arrays([*own, *made[1:]], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: how many repeated passages and words went, its lines, and its text without them."""
    rows = without_repeated_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_removed", "n_words_removed", "n_paragraphs", "removed", "text")
