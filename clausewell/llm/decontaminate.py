"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

The automaton is built on the driver from at most ``max_chars`` characters of items and broadcast; a
larger benchmark is cut by hash into as many automata as that bound asks for, and the documents are
streamed once by each. Documents are never shuffled: a task turns a text into word numbers, and follows
the automaton over every run of known words that is long enough to hold a window (an unknown word sets
the matching length to zero, so nothing is lost by skipping the rest).

Defined results: a null or empty text has no words and no hit; items without words or without an id are
ignored; an item given twice counts once; an empty benchmark hits nothing; repeated documents are each
judged alone; an empty table gives an empty result. Columns of the documents pass through under any name, and new ones get
underscores where their names are taken.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free, fresh, map_text, table

#: Bytes to bytes: A-Z to a-z; digits, letters and all of code points above 127 stay; the rest are blanks.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
TOKEN = re.compile(rb"[^ ]+")
SPANS = "array<struct<start:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton of items (id, words), with what each state says about windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, own in items:
            if own:
                coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own]))
        for _, own in coded:
            last = 0
            for w in own:
                last = self._extend(last, w)
        #: The state of each state's suffix of ``window`` words, and the items that own that window.
        self.top = [-1] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= window:
                up = self.link[v]
                self.top[v] = v if self.length[up] < window else self.top[up]
        self.owners: dict[int, set[str]] = {}
        whole: dict[int, dict[int, set[str]]] = {}
        for name, own in coded:
            v = 0
            for i, w in enumerate(own, 1):
                v = self.next[v][w]
                if i >= window:
                    self.owners.setdefault(self.top[v], set()).add(name)
            if len(own) < window:
                whole.setdefault(v, {}).setdefault(len(own), set()).add(name)
        #: Short items that end where a state ends: its own and those of the states on its links.
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        if whole:
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if found := self.short.get(self.link[v], []) + list(whole.get(v, {}).items()):
                    self.short[v] = found
        self.least = min((min(len(own), window) for _, own in coded), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def matches(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words hit by windows, and the items whose windows occur."""
        if not self.least or len(own) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int64, len(own))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        spans: list[list[int]] = []
        items: set[str] = set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            self._follow(ids[a:b].tolist(), a, spans, items)
        return [(a, b) for a, b in spans], items

    def _follow(self, ids: list[int], at: int, spans: list[list[int]], items: set[str]) -> None:
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        v = matched = 0
        for i, w in enumerate(ids, at + 1):
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            size = 0
            if matched >= window:
                size = window
                items |= self.owners[self.top[v]]
            if short:
                for n, names in short.get(v, ()):
                    if n <= matched:
                        size = max(size, n)
                        items |= names
            if size:
                while spans and spans[-1][0] >= i - size:
                    spans.pop()
                if spans and spans[-1][1] >= i - size:
                    spans[-1][1] = i
                else:
                    spans.append([i - size, i])


def automata(items: DataFrame, item_id: str, text: str, window: int, max_chars: int):
    """Automata of at most about ``max_chars`` characters of items each."""
    rows = items.select(col(item_id).cast("string").alias("id"), col(text).cast("binary").alias("t")).dropna().distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // max_chars)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.expr(f"pmod(xxhash64(id, t), {n}) = {k}"))
        yield Automaton([(r.id, words(bytes(r.t))) for r in part.collect()], window)


def scan(
    docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, max_chars: int = 2_000_000, names: tuple[str, str, str, str] = ("n_words", "n_hit", "hit_spans", "items"),
) -> DataFrame:
    """``keep`` and four columns: words, words hit, merged spans of words hit, and the items found."""
    spark = docs.sparkSession
    names = tuple(free(keep, n) for n in names)
    found, shared = docs, []
    for auto in automata(items, item_id, item_text, window, max_chars):
        shared.append(spark.sparkContext.broadcast(auto))
    if not shared:
        shared.append(spark.sparkContext.broadcast(Automaton([], window)))
    held = [*keep] if len(shared) == 1 else [*dict.fromkeys([*keep, text])]
    parts = []
    for k, auto in enumerate(shared):
        parts.append(tuple(fresh(found, f"{n}{k}") for n in ("words", "hit", "spans", "items")))
        n, h, s, i = parts[-1]
        found = map_text(found, text, held, f"`{n}` bigint, `{h}` bigint, `{s}` {SPANS}, `{i}` array<string>", lambda auto=auto: _scanner(auto))
        held += parts[-1]
    if len(parts) == 1:
        return found.select(*[col(c) for c in keep], *[col(a).alias(b) for a, b in zip(parts[0], names, strict=True)])
    every = F.array_sort(F.concat(*[col(p[2]) for p in parts]))
    last = lambda spans: F.element_at(spans, -1)

    def merge(spans, s):
        joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last(spans).start.alias("start"), F.greatest(last(spans).end, s.end).alias("end"))))
        return F.when(F.size(spans) == 0, F.array(s)).when(s.start <= last(spans).end, joined).otherwise(F.concat(spans, F.array(s)))

    spans = F.aggregate(every, F.array().cast(SPANS), merge)
    found = found.select(*[col(c) for c in keep], col(parts[0][0]).alias(names[0]), spans.alias(names[2]), F.array_distinct(F.concat(*[col(p[3]) for p in parts])).alias(names[3]))
    size = F.aggregate(col(names[2]), F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return found.select(*[col(c) for c in keep], col(names[0]), size.alias(names[1]), col(names[2]), col(names[3]))


def _scanner(auto):
    auto = auto.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def step(texts):
        counts, hits, spans, items = [], [], [], []
        for text in texts:
            own = words(text)
            s, i = auto.matches(own)
            counts.append(len(own))
            hits.append(sum(b - a for a, b in s))
            spans.append([{"start": a, "end": b} for a, b in s])
            items.append(sorted(i))
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

    return step


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in TOKEN.finditer(text.translate(WORDS))]
    out, at = [], 0
    for a, b in sorted(spans):
        start, end = places[a][0], places[b - 1][1]
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return b"".join([*out, text[at:]])


def _cutter(min_span: int):
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None else cut_words(t.encode(), [(p["start"], p["end"]) for p in s if p["end"] - p["start"] >= min_span]).decode()
            for t, s in zip(texts, spans, strict=True)
        ])

    return F.pandas_udf(cut, "string")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5, min_span: int = 1, **options
) -> DataFrame:
    """docs without test passages: hit spans of ``min_span`` words or more are cut out of the text, and a
    document of whose words more than ``max_coverage`` are hit goes as a whole. Other rows and columns stay
    as they are, a null text included."""
    names = tuple(fresh(docs, n) for n in ("n_words", "n_hit", "hit_spans", "items"))
    found = scan(docs, items, docs.columns, text, window=window, names=names, **options)
    found = found.where(col(names[1]) <= max_coverage * col(names[0]))

    cut = _cutter(min_span)
    new = F.when(col(names[1]) > 0, cut(col(text), col(names[2]))).otherwise(col(text))
    return found.select(*[new.alias(c) if c == text else col(c) for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: words, words inside benchmark windows, and a digest of the items."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
