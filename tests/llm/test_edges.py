"""Edge cases of every operator and the pipeline, and brute force where SQL has no words for the result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewell.llm import decontaminate, mixing, paragraphs, pii, quality, queries, secrets, simhash, suffixes, toxicity

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, kept string"
WORDS = [f"word{i}" for i in range(400)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with copies, near copies, a benchmark passage, a secret, nulls, an empty text and a long one."""
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choices(WORDS, k=30)).capitalize() for _ in range(3)) for _ in range(60)]
    passage = " ".join(rng.choices(WORDS, k=20))
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", "\n\n", "Key " + passage + " " + texts[2], "password = hunter2hunter2 " + texts[3], "é漢𝄞 " * 3000, "one " * 5000]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(60)] + [(64, 0, 0), (65, 0, 0), (None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(x) for x in np.random.default_rng(i // 2).standard_normal(8)], i % 3) for i in range(20)] + [(20, None, 1), (21, [1.0] * 8, None)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    turns = [(c, k, role, f"{role} {k} of {c % 3}") for c in range(12) for k, role in enumerate(("user", "assistant", "user")[: 1 + c % 3])] + [(12, None, None, None), (12, 0, "user", ""), (None, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_tables(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() == (name == "op11_chat_formatting")  # its own conversation -7


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op5_embeddings", "op11_chat_formatting", "op12_prefix_trie"}))
def test_a_row_for_each_document(spark, tables, name):
    rows = queries.QUERIES[name](spark, tables)
    assert rows.select("doc_id").distinct().count() == 70 == rows.count()


def test_clashing_columns_pass(spark):
    rows = spark.createDataFrame([(1, "some words of a text", "en", "a", 20, 0.5, "s", "k"), (2, None, None, None, None, None, None, None), (1, "some words of a text", "en", "a", 20, 0.5, "s", "k")], KIND)
    items = spark.createDataFrame([(1, "other")], "item_id int, text string")
    for out in (simhash.deduplicated(rows), decontaminate.decontaminate(rows, items), secrets.redact(rows), pii.pseudonymise(rows), paragraphs.without_repeated_paragraphs(rows)):
        assert set(rows.columns) <= set(out.columns) and out.count() >= 2
    names = rows.withColumns({n: F.lit("mine") for n in ("doc", "a", "pos", "_marks", "n_removed", "removed", "hash", "fp", "component", "vec_id", "id", "t", "y")})
    out = suffixes.without_repeats(names, names.columns).collect()
    assert len(out) == 3 and all(r.doc == r.n_removed == r._marks == "mine" and r.kept in ("k", None) and r._n_removed == 0 for r in out)
    for done in (simhash.deduplicated(names), decontaminate.decontaminate(names, items), secrets.redact(names), quality.accepted(names, names.select("doc_id", F.lit(1).alias("quality")), least=0.0)):
        assert done.columns == names.columns and all(r.doc == r.fp == "mine" for r in done.collect())


def windows(text, size=10):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in words).split(" ")
    words = [w for w in words if w]
    return words, [tuple(words[i : i + size]) for i in range(max(0, len(words) - size + 1))] or ([tuple(words)] if words else [])


def test_decontamination_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    item = windows(spark.read.parquet(f"{tables}/benchmark.parquet").where("item_id = 1").first().text)[1]
    got = {r.doc_id: r for r in queries.QUERIES["op1_decontamination"](spark, tables).collect()}
    for r in docs:
        words = windows(r.text)[0]
        hit = {i + k for i in range(len(words)) if tuple(words[i : i + 10]) in item for k in range(10)}
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (len(words), len(hit), int(bool(hit)))


def test_cards_beside_other_numbers(spark):
    """A card is found with short numbers, dates, addresses and other cards next to it; what is no card stays."""
    card, spaced, bad = "4539578763621486", "4539 5787 6362 1486", "4539578763621487"
    cases = [
        (f"pay {card} 124 now", [card], "124"), (f"pay {spaced} 124", [spaced], "124"), (f"no 123 {card}.", [card], "123"), (f"1234 {spaced}", [spaced], "1234"), (f"7-{card}-99", [card], "99"),
        (f"{card} {card}", [card], ""), (f"{bad} {card} {bad}", [card], bad), (f"{bad} 123", [], f"{bad} 123"), ("1 " * 1000, [], "1 1"), ("1" * 3000, [], "111"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, text string")
    for r in pii.pseudonymise(rows, counts=tuple(f"n_{k}" for k in pii.FORMATS)).collect():
        text, cards, stays = cases[r.i]
        assert not any(c in r.text for c in cards) and stays in r.text and len(r.text) == len(text)
        assert r.n_card == sum(text.count(c) for c in cards) and (cards or r.text == text)
    mixed = spark.createDataFrame([(f"{card} 1999-12-31",), (f"{card} 129.38.82.176",), (f"{card} 123a@b.example.com",)], "text string")
    got = pii.pseudonymise(mixed, counts=tuple(f"n_{k}" for k in pii.FORMATS)).collect()
    assert [(r.n_card, r.n_date, r.n_ip, r.n_email) for r in got] == [(1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1)]
    assert not any(x in r.text for r in got for x in (card, "1999-12-31", "129.38.82.176", "123a@"))


def test_pipeline_by_stages(spark, tables, empty_tables):
    """Each stage against a plain rule over its own input; the last one against its targets."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, tables)
    scores = {r.doc_id: r.score for r in queries.QUERIES["op8_quality"](spark, tables).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}

    one = stages["SimHash near-dedup"](spark, docs, tables)
    classes = {r.doc_id: r.component_id for r in queries.QUERIES["op2_simhash"](spark, tables).collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(classes.values())
    assert {0, 2} <= set(classes.values()) and not {60, 61} & set(classes.values())

    clean = stages["benchmark decontamination"](spark, docs, tables)
    passage = spark.read.parquet(f"{tables}/benchmark.parquet").where("item_id = 1").first().text
    assert clean.columns == docs.columns and not any(passage in (r.text or "") for r in clean.collect())
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in clean.collect() if r.doc_id != 66)

    safe = {r.doc_id: r for r in stages["secret scans"](spark, docs, tables).collect()}
    assert "hunter2hunter2" not in safe[67].text and all(safe[i].text == before[i] for i in range(60))
    assert all(r.n_chars == len(r.text) for r in safe.values() if r.text is not None)

    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    mixed = stages["mixing to target weights"](spark, docs, tables).groupBy("doc_id").count().collect()
    assert all(r["count"] * plan[r.doc_id]["size"] == plan[r.doc_id].taken for r in mixed)

    out = corpus_pipeline.run(spark, tables)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids <= {i for i, s in scores.items() if s >= 0.3} and not {60, 61} & ids
    assert corpus_pipeline.run(spark, empty_tables).count() == 0


def test_embedding_links_by_brute_force(spark, tables):
    rows = [r for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r.embedding is not None and r.label is not None]
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op5_embeddings"](spark, tables).collect()}
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    for r in rows:
        assert got[r.vec_id] == sum(1 for o in rows if o.vec_id != r.vec_id and o.label == r.label and unit[o.vec_id] @ unit[r.vec_id] >= 0.93)
    assert got[20] == got[21] == 0 and len(got) == 22


def test_models_ignore_other_columns(spark, tables):
    """Scores do not change with lang, source or doc_id."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s")})
    for module, run in ((quality, quality.score), (toxicity, toxicity.tag)):
        model = module.train(docs, labels)
        a = {r.doc_id: r.score for r in run(docs, model, ["doc_id"]).collect()}
        assert a == {r.doc_id: r.score for r in run(other, model, ["doc_id"]).collect()}


