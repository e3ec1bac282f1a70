"""Queries over small tables, held against plain rules."""

import numpy as np
import pytest

from clausewell.operators import retrieve
from clausewell.plans import answering, queries, questions
from clausewell.plans import tables as table_plans

WORDS = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents and vectors with the same ids, and three passages of which two have a vector query."""
    rng = np.random.default_rng(4)
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, " ".join(rng.choice(WORDS, 20)) + f" d{i} " + "x" * (700 if i % 3 else 0), "s") for i in range(101)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{folder}/documents.parquet")
    items = [(i, " ".join(rng.choice(WORDS, 6)) + "; " + " ".join(rng.choice(WORDS, 4))) for i in (20, 21, 40)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [float(x) for x in rng.standard_normal(6)], 0) for i in range(101)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_dense_queries(spark, tables):
    """Every id divisible by 20 is searched."""
    rows = queries.dense_topk(spark, tables).collect()
    assert {r.query_id for r in rows} == {0, 20, 40, 60, 80, 100}


def fused(spark, tables, k):
    """Reciprocal ranks of the first 50 of either list, added in plain Python: the best k of each query."""
    lists = [queries._bm25(spark, tables, 100).collect(), retrieve.top(queries._dense(spark, tables).drop("rank"), 100).collect()]
    ranks = {}
    for n, rows in enumerate(lists):
        for r in rows:
            if r["rank"] <= 50:
                ranks.setdefault(r.query_id, {}).setdefault(r.block_id, [1000, 1000])[n] = r["rank"]
    score = lambda p: round(sum(1 / (60 + x) for x in p if x < 1000), 9)
    return {q: [b for b, _ in sorted(own.items(), key=lambda x: (-score(x[1]), *x[1]))[:k]] for q, own in ranks.items()}


def test_fusion_takes_fifty_of_each_list(spark, tables):
    want = fused(spark, tables, 6)
    got = {}
    for r in queries.hybrid_rrf(spark, tables).collect():
        got.setdefault(r.query_id, set()).add(r.block_id)
    assert got == {q: set(own) for q, own in want.items()}
    evidence = questions.retrieved_evidence(spark, tables).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert {r.q for r in evidence} == {20, 21, 40} and max(len(r.text) for r in evidence) == 600
    assert all(r.text == texts[want[r.q][r.no - 1]][:600] for r in evidence) and len(evidence) == 18


def test_answers_take_twenty_hits(spark, tables):
    hits = questions._asked_hybrid(spark, tables, 20).collect()
    want = fused(spark, tables, 20)
    assert {(r.q, r["rank"], r.block_id) for r in hits} == {(q, i + 1, b) for q in (20, 21, 40) for i, b in enumerate(want[q])} and len(hits) == 60
    assert {r.q for r in questions.fallback_option(spark, tables).collect()} == {20, 21, 40}
    assert [k for _, k, _, _ in questions.VARIANTS] == [10, 20, 20, 20, 20]
    assert {r.name for r in questions.strategy_sweep(spark, tables).collect()} == {"V0", "V1", "V2", "V3", "V4"}


def test_only_texts_of_located_documents_are_cut(spark, tables, monkeypatch):
    """Of the documents only the best of each passage are cut into lines, and passages are ranked once a query."""
    cut, ranked = [], []
    units, bm25 = questions._units, questions._bm25
    monkeypatch.setattr(questions, "_units", lambda spark, d, among=None: cut.append(units(spark, d, among)) or cut[-1])
    for plans in (questions, answering):
        monkeypatch.setattr(plans, "_bm25", lambda spark, d, k: ranked.append(k) or bm25(spark, d, k))
    best = {r.block_id for r in queries._bm25(spark, tables, 1).collect()}
    for query in (questions.extraction_audit, questions.document_prompts, questions.strategy_sweep, questions.statement_hits_vectors):
        cut.clear(), ranked.clear()
        assert query(spark, tables).count() > 0 and len(ranked) == 1
        assert all({r.doc_id for r in x.collect()} == best for x in cut)


def test_only_vectors_that_are_asked_are_made(spark, tables, monkeypatch):
    """Vector 100 is no statement's or block's, so it is not made unit or joined."""
    made, vectors = [], questions._vectors
    monkeypatch.setattr(questions, "_vectors", lambda *a: made.append(vectors(*a)) or made[-1])
    hits = {r.q: r.hit for r in questions.statement_hits_vectors(spark, tables).collect()}
    said, held = ({r.vec_id for r in x.select("vec_id").collect()} for x in made)
    assert said == {q * 31 % 100 + i for q in hits for i in range(2)} and 100 not in held and len(held) == 3


def test_title_locate_takes_all(spark, tmp_path):
    names = {i: f"Customer#{i:09d}" for i in range(1, 130)}
    spark.createDataFrame(list(names.items()), "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for i, name in names.items():
        held = sorted((len(x), str(j), j) for j, x in names.items() if name[-6:-1] in x)
        want |= {(i, j, n + 1) for n, (_, _, j) in enumerate(held)}
    rows = queries.title_locate(spark, str(tmp_path)).collect()
    assert {(r.title_id, r.name_id, r.cand_no) for r in rows} == want and len(rows) == len(want)


def test_number_fidelity_takes_all_lines(spark, tmp_path):
    lines = [(o, n, 30 + o * n, o) for o in range(1, 6) for n in range(1, 4)] + [(9, 2, 4, 48)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_orderkey, r.l_linenumber): (r.missing, r.status) for r in queries.number_fidelity(spark, str(tmp_path)).collect()}
    held = lambda p, e: str(p) in e
    assert got == {(o, n): ("", "ok") if held(p, f"{s} of {p * 2} at 10.5") else (str(p), "warn") for o, n, p, s in lines}


def test_table_units_take_every_line(spark, tmp_path):
    texts = {0: "first " + "x" * 60 + "\n\n last ", 1: "one", 77: "a\nb", 78: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(50, "bolt", "B1"), (51, "nut", "B2")], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.doc_id, r.unit_no, r.location, r.text) for r in table_plans.table_units(spark, str(tmp_path)).collect()}
    assert got == {
        ("0", 0, "para0", "first " + "x" * 60), ("0", 1, "para2", "last"), ("0", 2, "tbl0r50", "bolt |  | B1"),
        ("1", 0, "para0", "one"), ("1", 1, "tbl0r51", "nut |  | B2"), ("77", 0, "para0", "a"), ("77", 1, "para1", "b"),
    }
