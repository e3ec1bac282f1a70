"""Rows that share an id, quotas of the splitting tree, and texts longer than a piece."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewell.llm import mixing, secrets, simhash, suffixes, toxicity

DOC = "doc_id bigint, text string, source string, shard string"


def test_rows_of_an_id_are_mixed_together(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", None]), "mine") for i in range(300)]
    docs += [(7, "two " * 10, "a", "mine"), (7, "other " * 10, "a", "mine"), (7, "other " * 10, "a", "mine"), (None, "no id", "a", "x"), (None, "no id", "a", "x"), (None, "another one", "b", "x")]
    df = spark.createDataFrame(docs, DOC).repartition(3)
    plan = mixing.mix_plan(df, block_docs=8).collect()
    assert len(plan) == len(docs)
    times = defaultdict(set)
    for r in plan:
        times[r.unit, r.source].add((r.taken // r["size"], tuple(r.shards)))
    assert all(len(x) == 1 for x in times.values())
    mixed = mixing.mixed(df, block_docs=8)
    assert set(df.columns) < set(mixed.columns)
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    want = Counter()
    for r in plan:
        want[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert words == want  # no row of an id is lost
    for r in plan:
        assert abs(want[r.source] - r.target) <= 40


def test_quotas_of_the_splitting_tree(spark):
    rows = [(("a", "b", None)[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2], i, 0) for i in range(900)]
    blocks = spark.createDataFrame(rows, "source string, block int, copy int").repartition(4)
    sizes = Counter(r[0] for r in rows)
    for shards in (1, 3, 8):
        quotas = {r.source: r.quotas for r in mixing.source_quotas(blocks, shards, 5).collect()}
        assert {s: sum(q) for s, q in quotas.items()} == sizes  # a source's blocks, all of them
        whole = np.sum(list(quotas.values()), axis=0)
        assert len(whole) == shards and whole.max() - whole.min() <= shards.bit_length()
        got = mixing.splitting_tree(blocks, ["source", "block", "copy"], shards, 5).collect()
        dealt = Counter((r.source, r.shard) for r in got)
        assert len({r.block for r in got}) == len(got) == 900
        assert all(dealt[s, k] == n for s, q in quotas.items() for k, n in enumerate(q))
    draws = [{r.source: r.quotas for r in mixing.source_quotas(blocks, 2, seed).collect()}["b"][0] for seed in range(12)]
    law = np.random.default_rng(1).hypergeometric(sizes["b"], 900 - sizes["b"], 450, 4000)
    assert len(set(draws)) > 3 and abs(np.mean(draws) - law.mean()) < 4 * law.std() / 12**0.5
    assert mixing.source_quotas(blocks.limit(0), 4, 1).count() == 0


def test_different_texts_under_one_id_stay(spark):
    base = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"thing{i}" for i in range(300))
    docs = [(1, base, "a", "s"), (1, other, "a", "s"), (1, other, "a", "s"), (2, base + " x", "a", "s"), (3, "third one here " * 9, "a", "s"), (None, base, "a", "s"), (None, base, "a", "s")]
    got = simhash.deduplicated(spark.createDataFrame(docs, DOC))
    assert got.columns == ["doc_id", "text", "source", "shard"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(1, base): 1, (1, other): 1, (3, docs[4][1]): 1, (None, base): 2})


@pytest.mark.parametrize("piece", [64, 1000, 1 << 16])
def test_scores_do_not_depend_on_pieces(monkeypatch, piece):
    rng = np.random.default_rng(3)
    field = toxicity.Field(np.unique(rng.integers(0, len(toxicity.SIZES) << toxicity.BITS, 50_000)))
    field.w, field.bias = rng.standard_normal(len(field.buckets)) * 2, -0.5
    field.t, field.doc = rng.standard_normal((2, 2)), np.array([-1.0, 0.3, 0.1, 0.2])
    words = ["".join(rng.choice(list("abcdeé"), size=rng.integers(1, 12))) for _ in range(400)]
    n = 300_000 if piece > 1 << 15 else 2000
    texts = [" ".join(rng.choice(words, size=n)).encode(), ("x" * 5000 + " y. " + "z" * 3000).encode(), b"", b". ! "]
    monkeypatch.setattr(toxicity, "SLICE", 1 << 30)
    scores, spans = field.judged(texts)
    monkeypatch.setattr(toxicity, "SLICE", piece)
    again, same = field.judged(texts)
    assert scores.tolist() == again.tolist() and spans == same
    if piece > 1 << 15:
        assert len(texts[0]) > 2 * 10**6 * 0.9  # no sentence ends in it


@pytest.mark.parametrize("length", [100, 150, 255])
def test_removals_at_production_length(spark, length):
    """Bytes that a string of that length covers which starts earlier too, by a set of all strings."""
    rng = random.Random(8)
    parts = ["".join(rng.choices("abcdefghij é", k=k)) for k in (length - 1, length, length + 1, length + 50, 4 * length)]
    texts = ["".join(rng.choice([*parts, "".join(rng.choices("klmnop ", k=60))]) for _ in range(rng.randrange(5))) for _ in range(60)] + ["ab" * 300, "ab" * 300, None, ""]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"], length=length).collect()}
    seen, want = set(), {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = True
            seen.add(data[a : a + length])
        spans = int(np.count_nonzero(gone[:-1] & ~np.roll(gone, 1)[:-1])) if len(data) else 0
        want[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(data, gone) if not x)).hexdigest())
    assert got == want and sum(w[1] for w in want.values()) > 5000
    with pytest.raises(ValueError, match="at most"):
        suffixes.hit_spans(spark.createDataFrame([], "doc_id bigint, text string"), length=256)


def test_frequent_keys_by_counts_over_all_documents(spark):
    """A line that stands once in one document of 200, so never twice in a slice, is a frequent key."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    line = word(140)
    rows = [(i, word(300) + (line if i % 200 == 0 else "") + word(300)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc bigint, text string")
    found = set(suffixes._heavy_keys(docs, 100).tolist())
    own = np.frombuffer(line.encode(), np.uint8)
    assert set(suffixes.anchors(own, np.array([len(own)]), 100)[1].view(np.int64).tolist()) & found and len(found) < 10


def test_model_of_secrets_by_a_plain_count(spark):
    """Ratios of pairs from counts of every string of every document, repeats counted."""
    rng = random.Random(9)
    words = ["ordinary", "words", "token", "snake_case-name", "ab", "x" * 40]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(40)] + [None, "", "password = Zq9Zq9Zq9Zq9", "secret: Zq9Zq9Zq9Zq9"]
    one = secrets.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3), random_strings=0)
    n = len(secrets.ALPHABET)
    counts = np.ones((2, n, n))
    for t in texts:
        for label, group in ((1, re.findall(r"(?i)(?:password|secret)\s*[:=]\s*([A-Za-z0-9]+)", t or "")), (0, re.findall(r"[A-Za-z0-9+/_=-]{3,}", re.sub(r"(?i)(password|secret)\s*[:=]\s*[A-Za-z0-9]+", " ", t or "")))):
            for word in group:
                for a, b in zip(word, word[1:]):
                    counts[label, secrets.ALPHABET.index(a), secrets.ALPHABET.index(b)] += 1
    want = np.log(counts[1] / counts[1].sum(1, keepdims=True)) - np.log(counts[0] / counts[0].sum(1, keepdims=True))
    assert np.allclose(np.array(one).reshape(n, n), want)
