"""Stored index, one-scan dense search, hashed titles, halved lengths, linear folds: against plain models."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewell.functions import rolling
from clausewell.operators import corpus, match, retrieve


def _bm25(blocks, queries, k):
    words = {i: [w for w in re.split(r"[\W_]+", t or "") if w] for i, t in blocks}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = set()
    for q, text in queries:
        scores = Counter()
        for w in [w for w in re.split(r"[\W_]+", text or "") if w]:
            for i, ws in words.items():
                tf = ws.count(w)
                if tf:
                    scores[i] += (raw[w] if raw[w] >= 0 else 0.25 * mean) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items() if round(s, 6) > 0)[:k], 1)}
    return out


def test_index_built_once_and_searched_without_texts(spark, tmp_path):
    rng = random.Random(1)
    blocks = [(i, "hot " + " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(1, 30)))) for i in range(120)] + [(120, None), (121, ""), (122, "hot hot hot")]
    queries = [(i, " ".join(rng.choices([f"w{j}" for j in range(70)] + ["hot"], k=4))) for i in range(20)] + [(20, None), (21, "absent")]
    path = str(tmp_path / "index")
    retrieve.build_index(spark.createDataFrame(blocks, "block_id int, text string").repartition(5), path, buckets=8)
    asked = spark.createDataFrame(queries, "query_id int, text string")
    got = retrieve.search(spark, path, asked, k=7)
    assert {(r.query_id, r.block_id, r["rank"]) for r in got.collect()} == _bm25(blocks, queries, 7)
    assert "text" not in spark.read.parquet(f"{path}/postings").columns
    one = retrieve.search(spark, path, asked.where("query_id = 3"), k=7)
    assert {r.block_id for r in one.collect()} == {b for q, b, _ in _bm25(blocks, queries, 7) if q == 3}
    assert retrieve.search(spark, path, asked.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1 << 22, 16])
def test_index_has_a_row_a_block_and_queries_go_in_groups(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(retrieve, "CELLS", cells)
    monkeypatch.setattr(retrieve, "ASKED", 50)
    rng = random.Random(8)
    blocks = [(f"b{i:03d}", " ".join(rng.choices(["hot", *(f"w{j}" for j in range(40))], k=rng.randrange(40)))) for i in range(150)]
    queries = [(i, " ".join(rng.choices(["hot", *(f"w{j}" for j in range(45))], k=5))) for i in range(40)]
    path = str(tmp_path / "index")
    retrieve.build_index(spark.createDataFrame(blocks, "block_id string, text string").repartition(6), path)
    assert spark.read.parquet(f"{path}/postings").count() == len(blocks)
    got = retrieve.search(spark, path, spark.createDataFrame(queries, "query_id bigint, text string"), k=4).collect()
    assert {(r.query_id, r.block_id, r["rank"]) for r in got} == _bm25(blocks, queries, 4)


def test_best_of_many_rounds_with_ties_and_no_numbers():
    rng = np.random.default_rng(9)
    scores = rng.integers(0, 30, (7, 4000)) / 8.0
    scores[:, 1::50] = np.nan
    best = retrieve._Best(7, 5, 3)
    for at in range(0, 4000, 800):
        best.add(scores[:, at : at + 800], np.arange(at, at + 800), 0)
    want = [(q, b) for q in range(7) for b in np.lexsort((np.arange(4000), -np.nan_to_num(scores[q], nan=-1)))[:5]]
    assert list(zip(best.q, best.b, strict=True)) == want


def test_index_of_no_blocks(spark, tmp_path):
    none = spark.createDataFrame([], "block_id int, text string")
    assert retrieve.bm25(none, spark.createDataFrame([(1, "a")], "query_id int, text string")).count() == 0


@pytest.mark.parametrize("most_bytes", [64 << 20, 2048])
def test_dense_in_rounds_with_ties(spark, most_bytes, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (300, 4)).astype(float) + 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)] + [(999, None)], "block_id bigint, vector array<double>").repartition(4)
    asked = rows.where("block_id % 7 = 0 or block_id = 999").withColumnRenamed("block_id", "query_id")
    got = retrieve.dense(rows, asked, k=11, most_bytes=most_bytes).collect()
    s = np.round(v @ v.T, 9)
    want = {(q, int(b), r) for q in range(0, 300, 7) for r, b in enumerate(np.lexsort((np.arange(300), -s[q]))[:11], 1)}
    assert {(r.query_id, r.block_id, r["rank"]) for r in got} == want
    assert retrieve.dense(rows, asked.limit(0)).count() == retrieve.dense(rows.limit(0), asked).count() == 0


def _texts(rng, n, letters, most):
    return ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_titles_in_names(spark, monkeypatch, sent):
    monkeypatch.setattr(rolling, "SENT", sent)
    rng = random.Random(3)
    names = [*enumerate(_texts(rng, 150, "abé漢𝄞", 30)), (150, None), (151, "common part " * 3)] + [(200 + i, f"common part {i}") for i in range(40)]
    titles = [*enumerate(_texts(rng, 60, "abé漢𝄞", 5)), (60, "common part"), (61, None), (62, ""), (63, "common part 39")]
    got = match.locate(spark.createDataFrame(titles, "title_id int, title string"), spark.createDataFrame(names, "name_id int, name string"))
    want = {(i, j, k) for i, t in titles if t for k, (_, _, j) in enumerate(sorted((len(n), str(m), m) for m, n in names if n and t in n), 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_best_names_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    exts = ["x", "y", None]
    names = [(i, n, rng.choice(exts)) for i, n in enumerate(_texts(rng, 200, "abé𝄞", 12) + [None, ""] + ["abab"] * 9)]
    labels = [(i, n, rng.choice(exts)) for i, n in enumerate(_texts(rng, 80, "abé𝄞", 4) + [None, "", "abab", "zz"])]
    a = spark.createDataFrame(labels, "label_id int, label string, label_ext string")
    b = spark.createDataFrame(names, "name_id int, name string, ext string")
    want = {tuple(r) for r in match.best_label(a.where("label <> ''").crossJoin(b).where(F.contains("name", "label"))).collect()}
    assert {tuple(r) for r in match.best_names(a, b).collect()} == want and want
    held = {label for _, label, _ in labels if label and any(n and label in n for _, n, _ in names)}
    got = match.located(a.withColumnRenamed("label", "title"), b).collect()
    assert {r.title for r in got} == held and len(got) == sum(label in held for _, label, _ in labels)


def test_titles_are_ranked_once_for_all_rows_of_a_title(spark):
    """2,000 rows of one title in 2,000 names: names are ranked for the title, and its rows meet the ranks after."""
    ids = spark.range(2000)
    got = match.locate(ids.select(F.col("id").alias("title_id"), F.lit("mm").alias("title")), ids.select(F.col("id").alias("name_id"), F.concat(F.lit("comma"), "id").alias("name")))
    assert got.agg(F.count("*"), F.count_distinct("title_id"), F.max("cand_no")).first()[:] == (4_000_000, 2000, 2000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the plan's top comes first


def _lcs(a, b):
    return max((m for i in range(len(a)) for m in range(len(a) - i + 1) if a[i : i + m] in b), default=0)


@pytest.mark.parametrize("short", [256, 9, 0])
def test_common_substrings_of_all_pairs(spark, monkeypatch, short):
    monkeypatch.setattr(match, "SHORT", short)
    rng = random.Random(7)
    a = [*enumerate(_texts(rng, 30, "abé𝄞", 18)), (40, "aaaaaaaa"), (41, "abababab"), (42, ""), (43, None)]
    b = [*enumerate(_texts(rng, 40, "abé𝄞", 18)), (50, "aaaaaaaaaa"), (51, "babababa"), (52, None), (53, "abéxabéxabé")]
    got = match.common_substring(spark.createDataFrame(a, "a_id int, s string"), spark.createDataFrame(b, "b_id int, s string"), 3).collect()
    want = {(i, j): _lcs(s, t) for i, s in a for j, t in b if s and t and _lcs(s, t) >= 3}
    assert {(r.a_id, r.b_id): r.lcs for r in got} == want and len(got) == len(want)


def test_matches_of_short_texts_are_not_shuffled(spark):
    """Every pair of 1,500 texts shares a string: rows are made where the texts meet, so the plan groups none of them."""
    texts = spark.range(1500).select(F.col("id").alias("a_id"), F.concat(F.lit("shared by all of them "), "id").alias("s"))
    got = match._local(texts, texts.withColumnRenamed("a_id", "b_id"), 17)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1500 * 1500 and "Aggregate" not in plan and "Window" not in plan


def test_best_common_substring_makes_no_pairs(spark):
    rng = random.Random(4)
    b = [*enumerate(_texts(rng, 70, "ab", 24)), (70, None), *((100 + i, "shared by all of them" + str(i)) for i in range(30))]
    a = [*enumerate(_texts(rng, 40, "ab", 20)), (40, None), (41, ""), *((50 + i, f"x{i}shared by all of them") for i in range(9)), (70, "漢字 none")]
    got = match.best_common(spark.createDataFrame(a, "a_id int, s string"), spark.createDataFrame(b, "b_id int, s string"), least=5)
    want = set()
    for i, s in a:
        best = max(((_lcs(s, t), -j) for j, t in b if t and s), default=(0, 0))
        want |= {(i, -best[1], best[0])} if best[0] >= 5 else set()
    assert {tuple(r) for r in got.collect()} == want
    assert match.best_common(spark.createDataFrame(a, "a_id int, s string").limit(0), spark.createDataFrame(b, "b_id int, s string")).count() == 0


def _starts(sizes, marks, limit=420, least=120):
    out, size = [], 0
    for i, (n, m) in enumerate(zip(sizes, marks, strict=True)):
        if not out or size > 0 and ((m and size > least) or size + n > limit):
            out, size = [*out, i + 1], 0
        size += n
    return out


def test_block_starts_and_their_growth(spark):
    rng = random.Random(5)
    docs = [(i, ["x" * rng.choice([0, 1, 50, 130, 300, 500]) + rng.choice(["", "!"]) for _ in range(rng.randrange(12))]) for i in range(200)]
    rows = spark.createDataFrame(docs, "i int, units array<string>")
    got = {r.i: r.at for r in rows.select("i", corpus.starts(F.col("units"), lambda u: F.endswith(u, F.lit("!"))).alias("at")).collect()}
    assert got == {i: _starts([len(u) for u in us], [u.endswith("!") for u in us]) for i, us in docs}

    def took(n):
        one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("unit "), k.cast("string"))).alias("units"))
        began = time.time()
        one.select(F.size(corpus.starts(F.col("units"), lambda u: F.endswith(u, F.lit("7"))))).collect()
        return time.time() - began

    took(1000)
    small, large = took(40_000), took(160_000)
    assert large < 8 * small + 2  # four times the units


def test_pieces_of_long_texts(spark):
    rng = random.Random(6)
    docs = [(i, "".join("y" * rng.choice([1, 30, 200, 420, 900]) + "。" for _ in range(rng.randrange(9)))) for i in range(100)] + [(100, None), (101, "")]
    got = corpus.split_long(spark.createDataFrame(docs, "i int, text string")).toPandas()
    for i, text in docs:
        own = got[got.i == i].sort_values("piece_no")
        if text is None:
            assert own.empty
        else:
            assert own.piece.str.len().max() <= 672 and own.piece.iloc[0] == text[: len(own.piece.iloc[0])] and own.piece.iloc[-1] == text[len(text) - len(own.piece.iloc[-1]) :]
    assert isinstance(got, pd.DataFrame)


def test_ranks_of_a_hot_key(spark):
    from clausewell.sources.shared import ranked

    rows = [("hot" if i % 4 else f"k{i % 3}", i * 7919 % 2003) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "k string, v int").repartition(6), ["k"], [F.col("v")]).collect()
    want = {(k, v, n) for key in {r[0] for r in rows} for n, (k, v) in enumerate(sorted(r for r in rows if r[0] == key), 1)}
    assert {tuple(r) for r in got} == want and len(got) == 2000


def test_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    import hashlib

    from clausewell.sources import readers

    size = 3 * 2**30 + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.seek(size - 1)
        f.write(b"x")
    (tmp_path / "small name é.txt").write_bytes(b"abc")
    digest = hashlib.sha256()
    for _ in range((size - 1) // 2**20):
        digest.update(bytes(2**20))
    digest.update(bytes((size - 1) % 2**20) + b"x")
    got = {r.local_path.split("/")[-1]: r for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert (got["large.bin"].size, got["large.bin"].actual, got["large.bin"].error) == (size, digest.hexdigest(), None)
    assert [r.actual for n, r in got.items() if n.startswith("small")] == [hashlib.sha256(b"abc").hexdigest()]
    gone = readers.streamed_digests(spark.createDataFrame([(str(tmp_path / "none"),)], "path string")).first()
    assert gone.actual is None and "FileNotFound" in gone.error


def test_one_broken_document_fails_alone(spark, tmp_path):
    from clausewell.operators import sheets
    from clausewell.sources import readers

    unit = "array<struct<unit_no:int,location:string,text:string>>"
    docs = spark.createDataFrame([("1", "a", "pdf", [(0, "para0", "text")]), ("2", "b", "pdf", None), ("3", "c", "doc", [(0, "para0", None)]), ("4", "d", "xls", None)], f"doc_id string, orig_name string, type string, units {unit}")
    blocks, failed = corpus.text_blocks_or_failures(docs)
    assert [r.doc_id for r in blocks.collect()] == ["1"] and {tuple(r) for r in failed.collect()} == {("2", "no_units"), ("3", "unit_without_text")}
    assert readers.exit_status(failed, str(tmp_path / "failed")) == 1 and readers.exit_status(failed.limit(0)) == 0
    cells = [(d, "S", r, c, v) for d in "12" for r, c, v in ((0, 0, "项目"), (0, 1, "2020年"), (1, 0, "保费"), (1, 1, "5"))]
    rows = spark.createDataFrame([*cells, ("2", "S", None, 1, "9")], "doc_id string, sheet string, r int, c int, raw string")
    facts, failed = sheets.facts_or_failures(rows)
    assert [(r.doc_id, r.value) for r in facts.collect()] == [("1", 5.0)] and [tuple(r) for r in failed.collect()] == [("2", "cell_without_place")]


def test_common_substring_lengths_are_long_as_in_sql(spark):
    a = spark.createDataFrame([(1, "shared by all")], "a_id int, s string")
    assert dict(match.common_substring(a, a.withColumnRenamed("a_id", "b_id"), 5).dtypes)["lcs"] == "bigint"


def test_every_pair_meets_in_one_block(spark, monkeypatch):
    """Blocks of a few texts: each pair is listed once, whatever ends with a batch, a block or a part of the pairs."""
    for name, few in (("SHARE", 3), ("PARTS", 4), ("ROWS", 5), ("PAIRS", 7)):
        monkeypatch.setattr(match, name, few)
    rng = random.Random(8)
    a, b = ([*enumerate(_texts(rng, 30, "abé𝄞", 18)), (40, "aaaaaaaa"), (41, "abababab")] for _ in "ab")
    want = {(i, j): _lcs(s, t) for i, s in a for j, t in b if s and t and _lcs(s, t) >= 3}
    got = match.common_substring(spark.createDataFrame(a, "a_id int, s string"), spark.createDataFrame(b, "b_id bigint, s string"), 3).collect()
    assert {(r.a_id, r.b_id): r.lcs for r in got} == want and len(got) == len(want)
    rows = sorted([(p, True, i, None, s) for i, s in a for p in (0, 3) if s and len(s) >= 3] + [(p, False, None, j, t) for j, t in b for p in (0, 3, 4) if t and len(t) >= 3], key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows[k : k + 11], strict=True))][:2] + [pa.array([r[c] for r in rows[k : k + 11]], kind) for c, kind in ((2, pa.int32()), (3, pa.int64()), (4, pa.string()))], names=list("vwxyz")) for k in range(0, len(rows), 11)]
    got = [tuple(r.values()) for x in match._blocks(3)(batches) for r in x.to_pylist()]
    assert Counter(got) == Counter({(i, j, lcs): 2 for (i, j), lcs in want.items()})


def test_all_pairs_of_texts_that_share_much(spark):
    """9 million pairs, all with some 200 characters in common: a pair costs no comparison of its two texts."""
    texts = spark.range(3000).select(F.col("id").alias("a_id"), F.concat(F.col("id"), F.repeat(F.lit("shared by every one of these "), 7), "id").alias("s"))
    began = time.time()
    found = match.common_substring(texts, texts.withColumnRenamed("a_id", "b_id"), 17).agg(F.count("*"), F.min("lcs")).first()
    assert found[0] == 9_000_000 and found[1] == 203 and time.time() - began < 60
