"""The operators' inner workings, held against plain models."""

import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from clausewell.llm import decontaminate, embeddings, mixing, pii, quality, queries, secrets, simhash, suffixes, toxicity

VOCABULARY = [f"word{i}" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(VOCABULARY + ["vile"] * (20 * (i % 2)), k=rng.randrange(1, 60))) + ". End." for i in range(120)]
    texts += ["", None, "é" * 30_000, "vile " * 9000, texts[0]]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("module", "run"), [(quality, quality.score), (toxicity, toxicity.tag)])
def test_scores_are_functions_of_the_text(spark, docs, labels, module, run):
    """The same for any partitioning and any neighbours; no label of the held-out fifth can change one."""
    model = module.train(docs, labels)
    of = lambda d, m: {r.doc_id: r.score for r in run(d, m, ["doc_id"]).collect()}
    one = of(docs.coalesce(1), model)
    assert one == of(docs.repartition(7), model) == of(docs.orderBy(F.desc("doc_id")).coalesce(1), model)
    assert one[0] == one[124]
    turned = labels.select("doc_id", *[F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    assert turned.exceptAll(labels).count() > 5 and of(docs, module.train(docs, turned)) == one
    alike = docs.withColumn("score", F.lit("mine")).withColumn("toxic_spans", F.lit("mine"))
    kept = run(alike, model, ["doc_id", "score", "toxic_spans"]).collect()
    assert all(r.score == r.toxic_spans == "mine" and r._score == one[r.doc_id] for r in kept)


def test_network_against_loops():
    """Embedding, filters, pooling of overlapping chunks and the mean, one window at a time."""
    net = quality.Network()
    net.p["b"][:] = np.linspace(-0.2, 0.2, quality.FILTERS)
    net.p["v"][:] = np.linspace(-1, 1, quality.FILTERS)
    rng = np.random.default_rng(2)
    for size in (0, 1, 511, 512, 1024, 1500, 5000):
        text = rng.integers(32, 127, size, np.uint8).tobytes()
        symbols = [b + 1 for b in text] + [0] * (max(2, -(-size // 512)) * 512 - size)
        logits = []
        for a in range(0, len(symbols) - 512, 512):
            chunk = symbols[a : a + 1024]
            top = [0.0] * quality.FILTERS
            for k in range(0, 1024 - quality.WIDTH + 1, quality.STRIDE):
                x = np.concatenate([net.p["e"][s] for s in chunk[k : k + quality.WIDTH]])
                top = np.maximum(top, x @ net.p["w"] + net.p["b"])
            logits.append(float(top @ net.p["v"] + net.p["c"][0]))
        assert net.score(text) == pytest.approx(1 / (1 + math.exp(-np.mean(logits))), abs=1e-5)


def test_marginals_by_enumeration():
    """Log-odds of each word against sums over all labellings of chains."""
    rng = np.random.default_rng(1)
    e, t = rng.standard_normal(9) * 2, rng.standard_normal((2, 2))
    starts, sizes = np.array([3, 0, 8]), np.array([5, 3, 1])
    got = toxicity.marginals(e, starts, sizes, t)[2]
    for a, n in zip(starts, sizes):
        mass = np.zeros((n, 2))
        for own in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[a + i] * y for i, y in enumerate(own)) + sum(t[x, y] for x, y in zip(own, own[1:])))
            for i, y in enumerate(own):
                mass[i, y] += w
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), got[a : a + n])


def test_fingerprints_by_a_plain_count():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Äb", "CD", "e.f", "g"], k=k)) for k in (0, 1, 3, 4, 5, 40, 17_000)] + ["a\x0bb\tc\rd\x1ce", "\xa0x"]
    for text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want
    with pytest.raises(ValueError):
        simhash.links(None, max_bits=3)
    assert [simhash.blocks_kept(n, 4) for n in (0, 10**4, 10**9, 10**30)] == [1, 2, 4, 8]


def plain_feistel(s, key, kind):
    half, n = len(s) // 2, len(s)
    a, b = s[:half], s[half:]

    def moved(x, r, other):
        stream = bytes.fromhex(hashlib.sha256(f"{key}|{kind}|{r}|{n}|{other}".encode()).hexdigest())
        for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            x = "".join(letters[(letters.index(c) + stream[i % 32]) % len(letters)] if c in letters else c for i, c in enumerate(x))
        return x

    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = moved(a, r, b)
        else:
            b = moved(b, r, a)
    return a + b


def luhn(head):
    total = sum(sum(divmod(int(c) * (2 if (len(head) - i) % 2 else 1), 10)) for i, c in enumerate(head))
    return str(-total % 10)


def test_pseudonyms_by_a_plain_feistel(spark):
    card = "4539578763621486"
    text = f"pay {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} now, John.55@mail4.example.com or +1 (487) 555-7209."
    got = pii.pseudonymise(spark.createDataFrame([(text, 1)], "text string, n_card int"), key="k", counts=tuple(f"n_{k}" for k in pii.FORMATS)).first()
    new = plain_feistel(card[:-1], "k", "card")
    new += luhn(new)
    phone = iter(plain_feistel("4875557209", "k", "phone"))
    tail = "".join(next(phone) if c.isdigit() else c for c in " (487) 555-7209")
    assert got.text == f"pay {new[:4]} {new[4:8]} {new[8:12]} {new[12:]} now, {plain_feistel('John.55', 'k', 'email')}@mail4.example.com or +1{tail}."
    assert luhn(card[:-1]) == card[-1] and (got.n_card, got._n_card, got.n_email, got.n_phone) == (1, 1, 1, 1)


def test_secrets_by_a_plain_model(spark, tmp_path):
    rng = random.Random(9)
    letters = "abcdefABCDEF0123456789+/_=-."
    texts = []
    for i in range(80):
        parts = [rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(0, 4)):
            kind = rng.randrange(6)
            token = "".join(rng.choices(letters, k=rng.randrange(3, 40)))
            made = [f"PassWord = '{token}'", f"api-key:{token}", f"apiKEY:  {token}", "AKIA" + token.upper().translate({ord(c): None for c in "+/_=-."}), "".join(rng.choices("0123456789abcdef", k=rng.randrange(15, 50))), token]
            parts.insert(rng.randrange(len(parts) + 1), made[kind])
        texts.append(" é𝄞 ".join(parts))
    texts += [None, "", "secret=token: abcdefgh", "token=" + "x" * 5, " ".join("AKIA" + "A" * 16 for _ in range(300))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    good = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    model = secrets.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    n = len(secrets.ALPHABET)
    at = secrets.ALPHABET.index

    def ratio(s):
        return sum(float(f"{model[at(a) * n + at(b)]:.6f}") for a, b in zip(s, s[1:])) / (len(s) - 1)

    counts = {k: 0 for k in ("assign", "access", "hex", "markov")}
    for r in queries.QUERIES["op4_secrets"](spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(base) for m in p.finditer(t) if good[kind](m)]
        told = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(1 for s in spans if s[1] == k) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(told(spans).encode()).hexdigest()
        spans += [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if ratio(m[0]) > 0.5]
        assert r.spans == told(spans)
        for _, k, _ in spans:
            counts[secrets.KINDS[k]] += 1
    assert min(counts.values()) > 3


def test_access_keys_train_the_random_side(spark):
    kind = "doc_id int, text string"
    few = secrets.train(spark.createDataFrame([(1, "plain words here")], kind))
    many = secrets.train(spark.createDataFrame([(1, "plain words here"), *[(i, "AKIA" + "QZ" * 10) for i in range(2000)]], kind))
    pair = secrets.ALPHABET.index("Q") * len(secrets.ALPHABET) + secrets.ALPHABET.index("Z")
    assert many[pair] > few[pair] + 1


def test_targets_by_filling(spark):
    """Shares by weight, sources above twice their size stopped, the excess shared again, one round at a time."""
    rng = random.Random(6)
    sizes = {None if i == 0 else f"s{i:02d}": rng.choice([0, 10, 50, 400, 5000, 90_000]) for i in range(23)}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = {}, {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(full.values())
        rest = sum(weight[s] for s in sizes if s not in full)
        target = {s: full[s] if s in full else left * weight[s] / rest for s in sizes}
        over = {s: 2.0 * sizes[s] for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_splitting_tree(spark):
    """Shards hold equal numbers of blocks, and of each source near what chance gives."""
    blocks = spark.range(4000).select((F.col("id") % 4 % 3).cast("string").alias("source"), F.col("id").alias("block"), F.lit(0).alias("copy"))
    for shards in (1, 5, 16):
        got = mixing.splitting_tree(blocks, ["source", "block", "copy"], shards, 3).groupBy("shard", "source").count().toPandas()
        whole = got.groupby("shard")["count"].sum()
        assert len(whole) == shards and whole.sum() == 4000 and whole.max() - whole.min() <= shards.bit_length()
        assert (abs(got["count"] - whole[got["shard"]].to_numpy() * got["source"].map({"0": 0.5, "1": 0.25, "2": 0.25})) < 6 * np.sqrt(4000 / shards * 0.25)).all()


def test_estimates_leave_few_pairs_open():
    """Of random and near vectors no pair at the threshold is missed, and few others are computed again."""
    rng = np.random.default_rng(5)
    for d in (64, 100, 256):
        base = rng.standard_normal((300, d))
        near = base[:100] + rng.standard_normal((100, d)) * rng.uniform(0.1, 0.45, (100, 1))
        unit = embeddings.units(np.concatenate([base, near]))
        names = ["code", "factor", "planes", "low", "step", "total"]
        fields = embeddings.encode(unit, embeddings.rotation(d))
        rows = pd.DataFrame({n: [v.tobytes() for v in f] if f.ndim > 1 else f for n, f in zip(names, fields)})
        codes = embeddings.Codes(rows, d)
        x, y = codes.open_pairs(np.arange(len(unit)), 0, 0.93, 6.0)
        cosine = unit @ unit.T
        found = set(zip(x.tolist(), y.tolist()))
        assert {(int(a), int(b)) for a, b in np.argwhere(cosine >= 0.93)} <= found
        assert len(found) < 0.02 * len(unit) ** 2


def test_suffixes_sorted_in_turns():
    """Eight bytes at a time gives the order of all 104 bytes, ties by place."""
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 123, 150), 8), np.full(500, 97), np.zeros(120)]).astype(np.uint8)
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").reshape(-1).astype(np.uint64)
    at = np.sort(rng.choice(len(data) - 120, 2500, replace=False))
    assert suffixes.by_lanes(at, lanes, 104).tolist() == sorted(at.tolist(), key=lambda p: (data[p : p + 104].tobytes(), p))


def test_several_automata_merge_their_spans(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(words[3 * i : 3 * i + 12])) for i in range(9)]
    text = "x " + " ".join(words[:30]) + " y " + " ".join(rng.choices(words, k=30))
    docs = spark.createDataFrame([(1, text, 5, "a")], "doc_id int, text string, n_hit int, Items string")
    given = spark.createDataFrame(items, "item_id int, text string")
    one, many = (decontaminate.scan(docs, given, ["n_hit", "Items"], max_chars=m).first() for m in (10**6, 40))
    assert (one._n_hit, one.hit_spans, sorted(one._items)) == (many._n_hit, many.hit_spans, sorted(many._items)) and one._n_hit >= 30 and one.n_hit == 5


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.9), ("op6_toxicity", "toxic", 0.8)])
def test_held_out_documents_are_told_apart(spark, name, label, least):
    """Share of pairs (label 1, label 0) of the held-out fifth whose scores are in that order."""
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = queries.QUERIES[name](spark, TABLES).where("held_out").join(labels, "doc_id").select("score", F.col(label).alias("y")).collect()
    ones, zeros = ([r.score for r in rows if r.y == y] for y in (1, 0))
    right = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    assert len(ones) > 5 and len(zeros) > 5 and right / len(ones) / len(zeros) >= least
