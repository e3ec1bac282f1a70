"""Chat formatting, the prefix trie and resampling against plain models; places in an order."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewell.llm import chat, ordered, resample, trie

TURN = "conv_id bigint, turn bigint, role string, text string"


# Places

def test_places_of_a_key_that_spans_tasks(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 7}", i * 7919 % 1000, rng.getrandbits(63) - 2**62) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, n bigint, x bigint").repartition(5)
    got = ordered.placed(df.select("*", F.col("x").alias("own")), ["key"], [F.asc("n")], ("x",)).collect()
    want = {}
    by = defaultdict(list)
    for key, n, x in rows:
        by[key].append((n, x))
    for key, own in by.items():
        upto = 0
        for place, (n, x) in enumerate(sorted(own)):
            upto ^= x
            want[key, n, x] = (place, upto)
    assert {(r.key, r.n, r.own): (r.place, r.x) for r in got} == want and len(got) == 600


def test_places_without_a_key(spark):
    got = ordered.placed(spark.range(100).repartition(7), [], [F.desc("id")]).collect()
    assert sorted((r.place, r.id) for r in got) == [(i, 99 - i) for i in range(100)]
    assert ordered.placed(spark.range(0), [], [F.desc("id")]).count() == 0


# Chat formatting

def _messages(spark, rows):
    return spark.createDataFrame(rows, "tree bigint, id bigint, parent bigint, role string, text string, score double")


def _paths(rows):
    """All root-to-leaf paths by tree, best score first, then smallest leaf."""
    by = {r[1]: r for r in rows}
    leaves = [r for r in rows if r[1] not in {x[2] for x in rows}]
    found = defaultdict(list)
    for leaf in leaves:
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = by.get(at[2])
        found[leaf[0]].append((-round(sum(x[5] or 0 for x in path), 9), leaf[1], path[::-1]))
    return {tree: [p for _, _, p in sorted(x, key=lambda y: y[:2])] for tree, x in found.items()}


def test_branches_against_a_walk(spark):
    rng = random.Random(1)
    rows, tree = [], 0
    for i in range(120):
        parent = None if i % 30 == 0 else rng.choice([r[1] for r in rows if r[0] == i // 30])
        rows.append((i // 30, i, parent, ("user", "assistant", None)[i % 3], f"text {i}" if i % 11 else None, rng.choice([None, 0.5, 1.0, -1.0])))
    rows += [(4, 200 + i, 199 + i if i else 77777, "user", f"deep {i}", None) for i in range(150)]  # a chain whose first parent is missing
    for most in (1, 2, None):
        got = chat.branches(_messages(spark, rows), most).collect()
        have = defaultdict(list)
        for r in sorted(got, key=lambda r: (r.tree, r.branch, r.turn)):
            have[r.tree, r.branch].append(r.id)
        want = {(t, b): [x[1] for x in p] for t, ps in _paths(rows).items() for b, p in enumerate(ps[:most])}
        assert have == want


def test_formatted_trees_read_back(spark):
    rows = [(1, 1, None, "user", "<s> a", None), (1, 2, 1, "assistant", "b\n[INST]", 2.0), (1, 3, 1, "assistant", "worse", 1.0), (2, 9, None, "as\n\\sistant<|im_end|>", None, None)]
    out = chat.conversations_of(_messages(spark, rows), most=None).collect()
    read = {(r.tree, r.branch): chat.parsed(r.text) for r in out}
    assert read == {(1, 0): [("user", "<s> a"), ("assistant", "b\n[INST]")], (1, 1): [("user", "<s> a"), ("assistant", "worse")], (2, 0): [("as\n\\sistant<|im_end|>", "")]}
    one = next(r for r in out if (r.tree, r.branch) == (1, 0))
    assert [chat.unescaped(one.text[s.start : s.end]) for s in one.loss] == ["b\n[INST]"]


def test_a_ring_of_parents_raises(spark):
    rows = [(1, 1, 2, "user", "a", None), (1, 2, 1, "user", "b", None), (1, 3, 2, "user", "c", None)]
    with pytest.raises(ValueError, match="ring"):
        chat.branches(_messages(spark, rows))


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "INST]", "a", "\n", "é", "<\\s>", "[\\\\INST]"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    for r in got:
        assert chat.unescaped(r.e) == r.t
        assert not any(c in r.e for c in chat.CONTROLS)
        if not re.search(r"[<\[]\\*", r.t):
            assert r.e == r.t


def test_conversations_longer_than_a_row(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k} </s>") for k in range(300)] + [(2, None, None, None), (2, 0, "assistant", "x"), (None, 1, "assistant", "y")]
    out = chat.conversations_of(chat.messages_of(spark.createDataFrame(rows, TURN)), segment=16)
    assert out.where("tree = 1").count() == 19
    got = {r.tree: r for r in chat.read_back(out, "tree").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = got[1]
    assert one.n_turns == 300 and one.turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:300]))
    loss = "".join(r[3] for r in rows[:300] if r[2] == "assistant")
    assert (one.loss_chars, one.loss_sha256) == (len(loss), sha(loss))
    assert got[2].turns_sha256 == sha("\n\nassistant\nx\n") and got[None].loss_sha256 == sha("y")


# The trie

def _plain_sums(parents, values):
    out = np.array(values)
    for i in range(len(parents) - 1, 0, -1):
        if parents[i] >= 0:
            out[parents[i]] += out[i]
    return out


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_split_sums_subtrees(shape):
    rng = random.Random(4)
    n = 400
    parents = [-1] + [{"random": rng.randrange(i), "chain": i - 1, "star": 0, "forest": -1 if i % 50 == 0 else rng.randrange(i - i % 50, i) if i % 50 else -1}[shape] for i in range(1, n)]
    values = np.array([[rng.randrange(9), 1] for _ in range(n)])
    assert (trie.split(parents, values) == _plain_sums(parents, values)).all()
    assert len(trie.split([], np.zeros((0, 2), int))) == 0


def _digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def _plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    made = {}
    for c in own:
        h = crc32(str(c).encode()) % 9 if rebuild else 0
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = defaultdict(list)
    for c, turns in made.items():
        ends[tuple(turns)].append(c)
    return {(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], _digest(ends[k])) for k, m in nodes.items()}


@pytest.mark.parametrize("local_nodes", [1, 7, 20_000])
def test_trie_against_a_plain_one(spark, local_nodes):
    rng = random.Random(local_nodes)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, "", "c c"])) for c in rng.sample(range(90), 60) for k in range(rng.randrange(1, 7))]
    rows += [(c, k, "user", "hot") for c in range(100, 130) for k in range(3)] + [(None, 0, "user", "x"), (95, None, "user", "first"), (95, 3, "user", "then")]
    rows += [(201, k, "user", str(k // 40)) for k in range(70)] + [(203, k, "user", str(k // 40)) for k in range(60)]
    df = spark.createDataFrame(rows, TURN).repartition(3)
    got = trie.trie(df, rebuild=trie.rebuilt, local_nodes=local_nodes)
    assert {tuple(r) for r in got.collect()} == _plain_trie(rows)
    if local_nodes == 7:
        assert {tuple(r) for r in trie.trie(df, local_nodes=7).collect()} == _plain_trie(rows, rebuild=False)


def test_repeated_rows_are_turns_and_ids_digest_in_pieces(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a")]
    got = {(r.depth, r.conv_id): r.n_convs for r in trie.trie(spark.createDataFrame(rows, TURN)).collect()}
    assert got == {(0, 1): 2, (1, 1): 2, (2, 1): 1, (3, 1): 1}
    ends = spark.createDataFrame([(b"k", i * 37 % 500) for i in range(500)] + [(b"l", 3)], "key binary, c bigint")
    assert {bytes(r.key): r.ends_sha256 for r in trie.end_digests(ends, ids=64).collect()} == {b"k": _digest(range(500)), b"l": _digest([3])}


# Resampling

def _plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain_features(text):
    w = _plain_words(text)
    return [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_features_do_not_depend_on_pieces():
    rng = random.Random(6)
    text = "".join(rng.choices(["a", "B", " ", "é", "\n", "9", "_", "漢", "wordy "], k=4000)) + "x" * 300 + " end"
    want = Counter(crc32(" ".join(w).encode()) for n in (1, 2, 3) for w in zip(*[_plain_words(text)[k:] for k in range(n)], strict=False))
    for piece in (1, 7, 64, 1 << 20):
        assert Counter(h for some in resample.features(text.encode(), 3, piece) for h in some) == want
    assert sum(len(x) for x in resample.features(None)) == sum(len(x) for x in resample.features(b"")) == 0


def test_resampling_against_a_plain_model(spark):
    rng = random.Random(7)
    vocabulary = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(300)] + [(300, None), (301, ""), (5, "same words " * 12), (5, "same words " * 12)]
    items = [(i, " ".join(rng.choices(vocabulary[:60], k=30))) for i in range(20)] + [(20, None)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    s, t = Counter(x for _, text in docs for x in _plain_features(text)), Counter(x for _, text in items for x in _plain_features(text))
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (s.total() + 10000) / ((s[x] + 1) * (t.total() + 10000))))
    rows = []
    for i, text in docs:
        own = _plain_features(text)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_plain_words(text))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = [1 + k if k < len(able) * 5 // 100 else None for k in range(len(able))]
    want = Counter([(*r[:4], k) for r, k in zip(able, ranks, strict=True)] + [(*r[:4], None) for r in rows if r[4] < 20])
    got = resample.resample(d, b)
    assert Counter(tuple(r) for r in got.collect()) == want
    extra = d.withColumns({"rank": F.lit("mine"), "weight": F.lit(1)})
    drawn = resample.drawn_documents(extra, b)
    assert drawn.columns == extra.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r, k in zip(able, ranks, strict=True) if k}
    assert all(r.rank is None for r in resample.resample(d.limit(0), b).collect())
    assert resample.resample(d, b.limit(0)).where("rank is not null").count() == len(able) * 5 // 100
