"""Repeated paragraphs and passages, held against a plain model over all pairs of lines and all segments."""

import random

import pytest

from clausewell.llm import paragraphs, queries
from clausewell.llm.decontaminate import words

VOCABULARY = [f"word{i}" for i in range(400)]
REACH, GRAM, SHINGLE, LEAST_RUN = 5, 3, 5, 20  # what the query takes


def value(part):
    w = paragraphs.Words(b" ".join(part))
    return int(w.hash([0], [len(part)])[0])


def segments(line):
    """Cut before each word whose three-word hash is the least within REACH words."""
    n = len(line)
    low = [value(line[i : i + GRAM]) if i + GRAM <= n else 1 << 64 for i in range(n)]
    cuts = [i for i in range(1, n - GRAM + 1) if all(low[i] < low[j] for j in range(max(0, i - REACH), min(n, i + REACH + 1)) if j != i)]
    ends = [0, *cuts, n]
    return [(a, b) for a, b in zip(ends, ends[1:]) if b - a >= SHINGLE] if cuts else []


def model(texts):
    """For each id the places of the words that go: marked as later copies and in a run of LEAST_RUN or more."""
    lines = [(i, k, words(line)) for i, t in texts for k, line in enumerate((t or "").encode().split(b"\n"))]
    lines = [x for x in lines if x[2]]
    sets = [frozenset(tuple(w[j : j + SHINGLE]) for j in range(len(w) - SHINGLE + 1)) for _, _, w in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            near = lines[a][2] == lines[b][2] or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
            if root[a] != root[b] and near:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    seen, marked, at = set(), {i: [] for i, _ in texts}, {}
    for n, (i, _, w) in enumerate(lines):
        start = at.get(i, 0)
        at[i] = start + len(w)
        own = [root[n] != n] * len(w)
        for a, b in segments(w):
            if tuple(w[a:b]) in seen:
                own[a:b] = [True] * (b - a)
            seen.add(tuple(w[a:b]))
        marked[i] += own
    gone = {}
    for i, own in marked.items():
        gone[i], a = set(), 0
        while a < len(own):
            b = a
            while b < len(own) and own[b]:
                b += 1
            if b - a >= LEAST_RUN:
                gone[i] |= set(range(a, b))
            a = b + 1
    return gone


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    base = [rng.choices(VOCABULARY, k=k) for k in (60, 60, 60, 30, 25, 20, 12, 9, 4, 1)]
    passage = rng.choices(VOCABULARY, k=55)
    rows = []
    for i in range(40):
        parts = []
        for _ in range(4):
            own = list(rng.choice(base)) if rng.random() < 0.5 else rng.choices(VOCABULARY, k=rng.randrange(1, 70))
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "changed"
            parts.append(" ".join(own))
        if i % 5 == 0:
            parts.append(" ".join(rng.choices(VOCABULARY, k=40) + passage + rng.choices(VOCABULARY, k=30)))
        rows.append((i, "\n\n".join(parts)))
    short = [" ".join(rng.choices(VOCABULARY, k=8)) for _ in range(5)]
    rows += [(40, "\n".join(short)), (41, "own\n" + "\n".join(short) + "\nline"), (42, short[0]), (43, None), (44, ""), (45, "\n \n"), (46, "é " * 30), (47, "é " * 30)]
    return [*rows, (48, ". ".join(" ".join(rng.choices(VOCABULARY, k=15)) for _ in range(4000)))]


def test_against_the_model(spark, texts, tmp_path):
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op10_paragraphs"](spark, str(tmp_path)).collect()}
    gone, caught = model(texts), 0
    for i, t in texts:
        own = words((t or "").encode())
        assert got[i].n_words_removed == len(gone[i]) and (got[i].n_removed > 0) == bool(gone[i])
        assert words((got[i].text or "").encode()) == [w for k, w in enumerate(own) if k not in gone[i]]
        assert sum(len(words(t[s.start : s.end].encode())) for s in got[i].removed) == len(gone[i])
        caught += bool(gone[i])
    assert caught > 20 and got[41].n_removed == 1 and got[42].n_removed == 0 and got[47].n_removed == 1
    assert got[41].text == "own\nline" and got[43].text is None and got[44].text == "" and got[48].n_removed == 0
    assert all(got[i].n_removed == 1 for i in range(5, 40, 5) if len(gone[i]) < 60 and gone[i])


def test_small_blocks_find_the_same(spark, texts):
    docs = spark.createDataFrame(texts[:48], "doc_id bigint, text string")
    of = lambda block: {r.doc_id: r.text for r in paragraphs.without_repeated_paragraphs(docs, block=block).collect()}
    assert of(2) == of(1024)


def test_names_nulls_and_repeated_rows(spark):
    line = " ".join(VOCABULARY[:30])
    kind = "doc_id bigint, text string, doc string, removed string, n_removed int, start int, hash string, N_Paragraphs string"
    rows = [(i, t, "d", "r", 1, 2, "h", "p") for i, t in ((1, line), (2, line), (2, line), (None, line), (3, None))]
    out = paragraphs.without_repeated_paragraphs(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if r.text is not None) == [(0, line), (1, line), (2, ""), (2, "")]
    assert all((r.doc, r.removed, r.n_removed, r.start, r.hash, r.N_Paragraphs) == ("d", "r", 1, 2, "h", "p") for r in out)
    assert sorted((r.doc_id or 0, r._n_removed) for r in out) == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    assert paragraphs.without_repeated_paragraphs(spark.createDataFrame([], kind)).count() == 0
