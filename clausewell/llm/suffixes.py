"""Suffix-array removal of repeated byte strings, exact over all documents.

A string of ``length`` bytes is hit if it also starts earlier (smaller doc_id, or earlier in the same document).
1. Anchors: every string of ``length`` bytes holds the position of its smallest hash of ``GRAM``-byte grams, so equal
   strings have equal anchors in equal places. One Arrow pass gives each anchor's hash, a hash of its context
   (all bytes of strings through it), hashes of the bytes just left and right of it, and its place; about one anchor every
   35 bytes is shuffled, no text.
   The rows of very frequent anchors, by counts over a sample of all documents, are dealt by their contexts as well,
   not by their hash alone.
2. Occurrences of a context that are not its first are hit as a whole. What is left are anchors with
   several contexts; only their first occurrences matter. A string common to two contexts of an anchor takes at least half
   of its other bytes on one side, so contexts that share neither side with another one drop out, and only the
   bytes of the rest are fetched.
3. Contexts with an anchor in common meet, a block of whole anchors at a time, in a suffix array made by
   two-stage sorting: suffixes smaller than their successors are sorted directly, the others induced by a
   scan over the buckets of first bytes. Adjacent common prefixes of ``length`` bytes give equal strings.
   An anchor with more than ``max_contexts`` contexts (a very common line) leaves this step: its strings are
   grouped by a 128-bit hash instead, a row for each, so no task holds an unbounded group.
4. Spans are gathered for each document and cut out of its bytes.

Contexts are the same if the hashes of their anchor (64 bits), of all their bytes (64 bits, random tables) and of the bytes
left and right of the anchor (32 bits each) are; strings of different contexts are compared by their bytes.

Defined results: a null text is empty; documents with a null id neither hit nor are hit, and lose nothing; rows that repeat
an id with the same text are judged alike and do not hit each other; rows that share an id must share the text; an empty
table gives an empty result; columns kept pass through under any name, and new columns get underscores where their names
are taken.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, col, free, fresh, table, written
from .paragraphs import BYTES, WORD_BASE, Ranges

GRAM = 32
#: Longest strings that are looked for: an anchor's row holds its distance to the end of its strings in one byte.
LONGEST = 255
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def slide(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes (never 0) of the grams that are smallest in some string of ``length`` bytes within one of the
    texts laid end to end in data (ends: where each ends)."""
    m, width = len(data) - GRAM + 1, length - GRAM + 1
    if m < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).reshape(-1) * MIX[4]
    at ^= at >> np.uint64(29)
    h = at[:m] * MIX[0] + at[8 : 8 + m] * MIX[1] + at[16 : 16 + m] * MIX[2] + at[24 : 24 + m] * MIX[3]
    h ^= h >> np.uint64(32)
    h *= MIX[4]
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    across = np.zeros(len(data) + 1, np.int32)  # where strings begin that would reach into the next text
    np.add.at(across, np.maximum(np.append(0, ends[:-1]), ends - length + 1), 1)
    np.add.at(across, ends, -1)
    low = slide(np.minimum, h, width)
    low[np.cumsum(across)[: len(low)] > 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    found = np.flatnonzero(h == slide(np.maximum, np.concatenate([pad, low, pad]), width))
    return found, h[found]


def laid_end_to_end(batch: pa.RecordBatch, column: int, least: int):
    """Of slices of a batch: its rows with texts of ``least`` bytes or more, these as one array, and where each ends.
    Slices are small, so that what is worked out over them stays in the processor's caches."""
    for part in bounded(batch, column, 1 << 17):
        texts = part.column(column).to_pylist()
        rows = [i for i, t in enumerate(texts) if t and len(t) >= least]
        if rows:
            yield part.take(pa.array(rows)), np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), np.cumsum([len(texts[i]) for i in rows])


def with_doc(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("doc", kind), *T.StructType.fromDDL(ddl).fields])


#: Beside key and ctx: the hashes of the bytes left and right of the anchor, 32 bits each (0: too few bytes), and its
#: place, with the bytes from there to the end of its strings in the lowest byte.
ANCHOR = "key bigint, ctx bigint, sides bigint, place bigint"


def _heavy_keys(docs: DataFrame, length: int, often: int = 4, most: int = 4096, share: int = 16) -> np.ndarray:
    """Anchor hashes that occur ``often`` or more in one document of ``share`` (by hash of the id), the ``most`` frequent of
    them: their rows are to be dealt by more than their hash. Counts are sums over the whole sample, so a line that stands
    once in each of a few documents of a hundred is found too. Which keys they are changes no result."""

    def run(batches):
        for batch in batches:
            for _, data, ends in laid_end_to_end(batch, 0, length):
                key, n = np.unique(anchors(data, ends, length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).select(F.col("text").cast("binary"))
    found = some.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    return np.sort(np.array([r.key for r in found.orderBy(F.desc("n"), "key").limit(most).collect()], np.int64))


def _anchor_rows(docs: DataFrame, length: int, heavy: np.ndarray, inside: bool) -> DataFrame:
    """docs (doc, text) -> doc and ANCHOR, for the anchors whose hash is among ``heavy``, or is not."""
    schema = with_doc(docs.schema["doc"].dataType, ANCHOR)
    reach, half = length - GRAM, (length - GRAM + 1) // 2

    def run(batches):
        for batch in batches:
            for rows, data, ends in laid_end_to_end(batch, 1, length):
                pos, key = anchors(data, ends, length)
                if len(heavy):
                    mine = np.isin(key.view(np.int64), heavy) == inside
                    pos, key = pos[mine], key[mine]
                if len(pos):
                    row = np.searchsorted(ends, pos, "right")
                    made = fields(data, pos, np.append(0, ends[:-1])[row], ends[row])
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(key.view(np.int64)), *map(pa.array, made)], names=schema.fieldNames())

    def fields(data, pos, first, last):
        hashed = Ranges(BYTES[data], WORD_BASE)
        start, stop, end = np.maximum(first, pos - reach), np.minimum(last, pos + length), pos + GRAM
        ctx = hashed(start, stop) ^ (((pos - start) << 32 | (stop - pos)).astype(np.uint64) * MIX[1])
        side = lambda there, a, b: np.where(there, hashed(a, b) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        left, right = side(pos - half >= first, np.maximum(first, pos - half), pos), side(end + half <= last, end, np.minimum(last, end + half))
        return ctx.view(np.int64), (left << np.uint64(32) | right).view(np.int64), (pos - first) << 8 | (stop - pos)

    return docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, schema)


def by_lanes(at: np.ndarray, lanes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes, eight at a time: after the first only those that are still tied."""
    order = at[np.argsort(lanes[at], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = np.diff(lanes[order]) != 0
    for o in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        group, key = np.cumsum(new)[some], lanes[order[some] + o]
        turn = np.lexsort([key, group])
        order[some], key = order[some][turn], key[turn]
        new[some[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    return order


def two_stage(data: np.ndarray, ends: np.ndarray, length: int = 1) -> np.ndarray:
    """Suffix array of texts laid end to end in data (ends: where each ends), right to a depth of 104 bytes or ``length``.

    All suffixes of ``length`` bytes or more are in it. Of the shorter ones of a text, which cannot hold a string
    of that length, only those up to the first that is sorted directly take part, as the others are induced from it.
    """
    n = len(data)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[last] = -1  # the end of a text is smaller than any byte
    known = np.flatnonzero(step)
    smaller = step[known[np.searchsorted(known, np.arange(n))]] > 0  # than their successors
    depth = max(104, -(-length // 8) * 8)
    wide = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8").reshape(-1).astype(np.uint64)
    direct = np.flatnonzero(smaller)
    at = np.searchsorted(direct, np.maximum(ends - length, np.append(0, ends[:-1])))
    bound = np.minimum(np.append(direct, n)[at], ends - 1)  # the last suffix of each text that takes part
    direct = direct[direct <= bound[np.searchsorted(ends, direct, side="right")]]
    direct = by_lanes(direct, lanes, depth)
    cut = np.searchsorted(data[direct], np.arange(257))
    incoming: dict[int, list[np.ndarray]] = defaultdict(list)
    end = bound[last[bound]]
    order = np.argsort(data[end], kind="stable")
    for c in np.unique(data[end]).tolist():  # induced by the ends, the smallest of all
        incoming[c].append(end[order][data[end][order] == c])
    out = []

    def send(found: np.ndarray, c: int) -> np.ndarray:
        """Induces the larger predecessors of found; those in the same bucket are returned."""
        before = found[found > 0] - 1
        before = before[~smaller[before] & ~last[before]]
        first = data[before]
        rest = before[first > c]
        if len(rest):
            turn = rest[np.argsort(data[rest], kind="stable")]
            heads = data[turn]
            for part in np.split(turn, np.flatnonzero(np.diff(heads)) + 1):
                incoming[int(data[part[0]])].append(part)
        return before[first == c]

    for c in range(256):
        now = np.concatenate(incoming[c]) if c in incoming else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = send(now, c)
        own = direct[cut[c] : cut[c + 1]]
        if len(own):
            out.append(own)
            send(own, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeats(texts: list[bytes], order: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of merged spans covered by strings that start earlier: order ranks the texts'
    documents, starts are the texts' places in them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)
    sa = two_stage(data, ends, length)
    sa = sa[ends[of[sa]] - sa >= length]
    if len(sa) < 2:
        return (np.zeros(0, np.int64),) * 3
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(np.uint64).reshape(-1)
    same = np.ones(len(sa) - 1, bool)  # the adjacent common prefix has ``length`` bytes
    for o in [*range(0, length - 8, 8), length - 8]:
        same &= lanes[sa[1:] + o] == lanes[sa[:-1] + o]
    text = of[sa]
    place = starts[text] + sa - (ends - sizes)[text]
    rank = order[text].astype(np.int64) << 32 | place
    group = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.repeat(np.minimum.reduceat(rank, group), np.diff(np.append(group, len(sa))))
    hit = np.flatnonzero(rank > least)
    turn = hit[np.lexsort([place[hit], text[hit]])]
    t, p = text[turn], place[turn]
    if not len(t):
        return (np.zeros(0, np.int64),) * 3
    first = np.concatenate(([True], (np.diff(t) != 0) | (np.diff(p) > length)))
    at = np.flatnonzero(first)
    return t[at], p[at], p[np.append(at[1:], len(p)) - 1] + length


def _compare(schema, length: int):
    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = held.column("key").to_numpy()
            stop = int(np.searchsorted(key == key[-1], True)) if len(key) else 0  # rows are sorted by key
            if stop:
                yield from block(held.slice(0, stop))
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield from block(held)

    def block(rows):
        docs = rows.column("doc").to_pylist()
        rank = {d: i for i, d in enumerate(sorted(set(docs)))}
        text, a, b = repeats(rows.column("bytes").to_pylist(), np.array([rank[d] for d in docs]), rows.column("start").to_numpy().astype(np.int64), length)
        if len(text):
            yield pa.RecordBatch.from_arrays([rows.column("doc").take(pa.array(text)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=schema.fieldNames())

    return run


def _strings(schema, length: int):
    def run(batches):
        for batch in batches:
            rows, place, a, b = [], [], [], []
            for i, (text, start) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                for k in range(len(text) - length + 1):
                    h = xxhash.xxh3_128_intdigest(text[k : k + length])
                    rows.append(i)
                    place.append(start + k)
                    a.append((h >> 64) - (1 << 63))
                    b.append((h & (1 << 64) - 1) - (1 << 63))
            own = batch.column("doc").take(pa.array(rows, pa.int64()))
            made = [pa.array(place, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            yield pa.RecordBatch.from_arrays([own, *made], names=schema.fieldNames())

    return run


def _sides(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"l": F.shiftrightunsigned("sides", 32), "r": F.col("sides").bitwiseAND(0xFFFFFFFF)})


def _by_windows(rows: DataFrame) -> DataFrame:
    """ANCHOR rows -> doc, place, key, later: occurrences of a context that are not its first, and those of contexts that share
    a side with another one of their anchor. One shuffle, by anchor."""
    own, all_ = W.partitionBy("key", "ctx", "sides"), W.partitionBy("key")
    rows = rows.withColumn("first", F.min(F.struct("doc", "place")).over(own))
    rows = rows.withColumns({"least": F.min("ctx").over(all_), "most": F.max("ctx").over(all_)})
    later = F.struct("doc", "place") > F.col("first")
    rows = _sides(rows.where(later | (F.col("least") != F.col("most"))).withColumn("later", later))
    met = F.lit(False)
    for side in ("l", "r"):  # within a key, so nothing is shuffled again
        same = W.partitionBy("key", side)
        rows = rows.withColumns({f"least_{side}": F.min("ctx").over(same), f"most_{side}": F.max("ctx").over(same)})
        met = met | ((F.col(side) != 0) & (F.col(f"least_{side}") != F.col(f"most_{side}")))
    return rows.where(F.col("later") | met).select("doc", "place", "key", "later")


def _by_joins(rows: DataFrame) -> DataFrame:
    """The same for anchors that many rows share: first occurrences and shared sides are sums within tasks first, and
    come back by joins whose large keys are split."""
    contexts = written(_sides(rows.groupBy("key", "ctx", "sides").agg(F.min(F.struct("doc", "place")).alias("first"))))
    later = rows.join(contexts.select("key", "ctx", "sides", "first"), ["key", "ctx", "sides"]).where(F.struct("doc", "place") > F.col("first"))
    out = later.select("doc", "place", "key", F.lit(True).alias("later"))
    for side in ("l", "r"):
        shared = contexts.where(F.col(side) != 0).groupBy("key", side).agg(F.count("*").alias("n")).where("n > 1")
        met = contexts.join(shared, ["key", side], "left_semi")
        out = out.union(met.select("first.doc", "first.place", "key", F.lit(False)))
    return out


def hit_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, max_contexts: int = 20_000) -> DataFrame:
    """(doc, a, b): spans of bytes, which may overlap, of strings of ``length`` bytes that also start earlier."""
    kind = docs.schema[doc_id].dataType
    given = docs.select(col(doc_id).alias("doc"), col(text).alias("text")).where("doc is not null")
    reach = length - GRAM
    if not GRAM < length <= LONGEST:
        raise ValueError(f"length has to be over {GRAM} and at most {LONGEST}")
    heavy = _heavy_keys(given, length)
    rows = _by_windows(_anchor_rows(given, length, heavy, False))
    if len(heavy):
        rows = rows.union(_by_joins(written(_anchor_rows(given, length, heavy, True))))
    pos = F.shiftright("place", 8).cast("int")
    rows = written(rows.select("doc", pos.alias("pos"), F.col("place").bitwiseAND(255).cast("int").alias("ahead"), "key", "later"))
    whole = rows.where("later").select("doc", F.greatest(F.lit(0), F.col("pos") - reach).alias("a"), (F.col("pos") + F.col("ahead")).alias("b"))
    asked = rows.where("not later").select("doc", "pos", "key").distinct()
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("pos", "key")).alias("asked"))
    schema = with_doc(kind, "key bigint, start int, bytes binary")

    def fetch(batches):
        for batch in (part for whole_batch in batches for part in bounded(whole_batch, 1)):
            rows_, keys, starts, found = [], [], [], []
            for i, (t, places) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for p in places:
                    a = max(0, p["pos"] - reach)
                    rows_.append(i)
                    keys.append(p["key"])
                    starts.append(a)
                    found.append(t[a : p["pos"] + length])
            own = batch.column(0).take(pa.array(rows_, pa.int64()))
            made = [pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([own, *made], names=schema.fieldNames())

    contexts = given.select("doc", F.col("text").cast("binary").alias("text")).join(asked, "doc").select("doc", "text", "asked").mapInArrow(fetch, schema)
    hot = rows.where("not later").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_contexts).select("key")
    hot = written(hot)
    spans = with_doc(kind, "a int, b int")
    if not hot.isEmpty():
        contexts = written(contexts)
        places = with_doc(kind, "start int, x bigint, y bigint")
        strings = contexts.join(hot, "key", "left_semi").select("doc", "key", "start", "bytes").mapInArrow(_strings(places, length), places)
        least = strings.groupBy("x", "y").agg(F.min(F.struct("doc", "start")).alias("first"))
        strings = strings.join(least, ["x", "y"]).where(F.struct("doc", "start") > F.col("first"))
        whole = whole.union(strings.select("doc", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
        contexts = contexts.join(hot, "key", "left_anti").select("doc", "key", "start", "bytes")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = contexts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compare(spans, length), spans)
    return whole.union(some)


def without_repeats(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = True, **options) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the bytes that stay as ``kept``."""
    key, marks, raw = (fresh(docs, n) for n in ("suffix_doc", "marks", "raw"))
    found = hit_spans(docs, doc_id, text, length, **options).groupBy(F.col("doc").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(marks))
    held = docs.join(found, col(doc_id) == col(key), "left").select(*[col(c) for c in keep], col(text).cast("binary").alias(raw), col(marks))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    kinds = {n: k for n, k in kinds.items() if with_text or n != "kept"}
    fields = [f"`{free(keep, n)}` {'bigint' if k == pa.int64() else k}" for n, k in kinds.items()]
    schema = T.StructType([*held.schema.fields[:-2], *T.StructType.fromDDL(", ".join(fields)).fields])

    def cut(t, own):
        t, pieces, at, removed, n = t or b"", [], 0, 0, 0
        for a, b in sorted((s["a"], s["b"]) for s in own or ()):
            if b <= at and n:
                continue
            if not n or a > at:
                pieces.append(t[at:a])
                n += 1
                removed += b - a
            else:
                removed += b - at
            at = b
        left = b"".join([*pieces, t[at:]])
        return (len(t), removed, n, hashlib.sha256(left).hexdigest(), left)[: len(kinds)]

    def run(batches):
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 2):
                made = zip(*map(cut, part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()), strict=True)
                arrays = [pa.array(x, k) for x, k in zip(made, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *arrays], names=schema.fieldNames())

    return held.mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: bytes, bytes and runs removed, and a digest of what stays."""
    return without_repeats(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)
