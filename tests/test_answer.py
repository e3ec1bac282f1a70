import random
import re

from pyspark.sql import functions as F

from clausewell.operators import answer, corpus, evaluate, match, retrieve
from clausewell.plans import answering


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def options(*values):
    return {k: F.lit(v).cast("double") for k, v in zip("ABCD", values)}


def test_numeric_options(spark):
    assert one(spark, answer.nearest_option(F.lit(100.0), options(101, 103, 99.5, None))) == "C"
    assert one(spark, answer.nearest_option(F.lit(0.5), options(0.51, 9, 9, 9))) == "A"
    assert one(spark, answer.nearest_option(F.lit(50.0), options(1, None))) is None
    assert one(spark, answer.within(F.lit(100.0), options(101, 103, 99.5, None))) == ["A", "C"]
    # distances are relative to the computed value, and 2 % is already too far
    assert one(spark, answer.nearest_option(F.lit(1000.0), options(1020.3, None))) is None
    assert one(spark, answer.nearest_option(F.lit(1000.0), options(1019.9, None))) == "A"
    assert one(spark, answer.within(F.lit(50.0), options(51.0, 50.9))) == ["B"]
    assert one(spark, answer.pair_arithmetic(F.lit(3.0), F.lit(10.0), options(7, 13))) == "A"
    assert [one(spark, answer.option_number(F.lit(s))) for s in ("约1,200.5亿元", "无", "-3%")] == [1200.5, None, -3.0]


def test_options_by_text(spark):
    asked = spark.createDataFrame([(1, 7, "A", "abcdef;uvwxyz"), (1, 7, "B", "uvwxyz"), (2, 8, "A", "abcd")], "q int, doc_id int, letter string, option string")
    blocks = spark.createDataFrame([(7, 0, "xxabcdefxx"), (7, 1, "uvwx"), (7, 2, "uvwxyz")], "doc_id int, block_no int, text string")
    found = answer.clause_coverage(asked, blocks)
    scores = answer.option_scores(found)
    assert [(r.q, r.letter, r.score) for r in scores.where("chosen").collect()] == [(1, "A", 1.0)]
    assert [r.block_no for r in answer.option_evidence(found, scores).orderBy("ord").collect()] == [0, 1, 2]


def test_split_long(spark):
    texts = ["x" * 500 + "。", "y" * 420, None, "", "z" * 700]
    rows = spark.createDataFrame([(i, 0, s) for i, s in enumerate(texts)], "doc_id int, block_no int, text string")
    got = [(r.doc_id, r.piece_no, len(r.piece)) for r in corpus.split_long(rows).orderBy("doc_id", "piece_no").collect()]
    assert got == [(0, 0, 501), (0, 1, 60), (1, 0, 420), (3, 0, 0), (4, 0, 420), (4, 1, 340)]


def test_titles(spark):
    titles = spark.createDataFrame([(1, "abcdefghijklmn"), (2, "zzzzzzzzzzzzzz"), (3, "bcd"), (4, "q")], "title_id int, title string")
    names = spark.createDataFrame([("xxbcdefghijklmxx",)], "name string")
    assert {r.title_id for r in match.out_of_corpus(titles, names).collect()} == {2, 4}
    kinds = "label_id int, label string, label_ext string, name_id int, name string, ext string"
    pairs = spark.createDataFrame([(1, "办法", "pdf", 1, "附件办法", "docx"), (1, "办法", "pdf", 2, "资本办法说明", "pdf"), (1, "办法", "pdf", 3, "资本办法", "pdf")], kinds)
    assert [r.name_id for r in match.best_label(pairs).collect()] == [3]


def test_audits(spark):
    rows = spark.createDataFrame([("A", " x", "x", "y"), ("B", "x", "x", "y"), (None, "x", "x", "y")], "answer string, answer_text string, option_a string, option_b string")
    rows = rows.withColumns({"option_c": F.lit("c"), "option_d": F.lit("d")})
    assert evaluate.inconsistent_answers(rows).count() == 2
    seen = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.69), (2, 1, 0.7), (2, 1, 0.1)], "q int, statement_no int, coverage double")
    assert {r.q: r.hit for r in evaluate.statements_hit(seen).collect()} == {1: False, 2: True}
    near = seen.withColumn("cosine", F.when(F.col("coverage") == 0.69, 0.6))
    assert {r.q: r.hit for r in evaluate.statements_hit(near).collect()} == {1: True, 2: True}
    pieces = spark.createDataFrame([(1, "p", 0, "a"), (1, "p", 1, "b"), (2, "p", 0, "c")], "doc_id int, location string, ord int, text string")
    assert {r.text for r in evaluate.cited_blocks(pieces).collect()} == {"b", "c"}
    a, b = spark.createDataFrame([(1,), (2,)], "block_id int"), spark.createDataFrame([(2,), (3,)], "block_id int")
    assert {tuple(r) for r in retrieve.misaligned(a, b).collect()} == {(1, "vector"), (3, "block")}


def test_claims_and_refusals(spark):
    claims = lambda s: one(spark, evaluate.uncited(F.lit(s), "未找到足够证据"))
    assert claims("甲为5[1]。乙为6。丙[2][3]！") == ["乙为6。"] and claims("未找到足够证据。乙") == [] and claims("……") == []
    rows = spark.createDataFrame([("a", "x", "ok"), ("a", " none ", "ok"), ("b", "y", "refused"), ("b", None, None)], "kind string, answer string, status string")
    assert {tuple(r) for r in evaluate.refusal_rates(rows, "none").collect()} == {("a", 2, 1, 0.5), ("b", 2, 1, 0.5)}


def test_choice_and_rates(spark):
    rows = spark.createDataFrame([(1, "dev", "word"), (2, "dev", "excel"), (3, "test", "pdf")], "q int, split string, source_type string")
    assert [r.q for r in evaluate.choose(rows).orderBy("q").collect()] == [1, 2] and [r.q for r in evaluate.choose(rows, text_only=True).collect()] == [1]
    graded = spark.createDataFrame([(k < 5,) for k in range(16)], "correct boolean")
    assert evaluate.accuracy(graded, []).first().percent == 31.2
    assert {tuple(r) for r in evaluate.split_documents(spark.createDataFrame([("dev", 1), ("dev", 1), ("test", 2)], "split string, grp int")).collect()} == {("dev", 1), ("test", 2)}


def test_documents_that_questions_name(spark):
    """The shortest file name that holds the title, then the smallest number as text; white space, file kind, number and extension do not count."""
    names = [(1, "7_资本 办法说明.pdf"), (9, "8_资本办法.docx"), (10, "9_资本办法.xls"), (11, "附件资本办法补充规定.pdf"), (12, None)]
    asked = [(1, "依据《资本办法（PDF）》，哪项正确？"), (2, "依据《 办法 说明》？"), (3, "依据《保险法》？"), (4, "资本办法？"), (5, "《补充规定(Word)》与《资本办法》？"), (6, None), (7, "《（PDF）》")]
    got = answer.scope(spark.createDataFrame(asked, "q int, question string"), spark.createDataFrame(names, "doc_id int, name string"))
    assert {tuple(r) for r in got.collect()} == {(1, 10), (2, 1), (5, 11)}


def test_option_scoring_is_the_whole_method(spark, tmp_path):
    """Four options a question, by clauses, over the blocks of the document that its title locates, against a plain model."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(60)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    items = {i: f"{said(6)}. {said(5)}; {said(4)}" for i in range(10)}
    # documents i and i + 20 are equal but for their sources: the words find i, the title the one of the shorter name
    texts = {i: f"{said(4)} d{i} {said(9)}\n{items[i][:20]}\n{items[i][20:]}\n{said(8)}" for i in items}
    docs = [(i + k, s, "s" * (3 if (i + k // 20) % 2 else 1)) for i, s in texts.items() for k in (0, 20)]
    spark.createDataFrame([*docs, (99, None, "s")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda s: "".join(s.replace(". ", "。").split())

    def coverage(a, t):
        return sum(a[i : i + 4] in t for i in range(len(a) - 3)) / (len(a) - 3) if len(a) > 3 else float(a in t)

    want = set()
    for q in items:
        scores = {}
        for k, other in enumerate(range(q - q % 4, q - q % 4 + 4)):
            if other in items:
                clauses = re.split("[;。]", plain(items[other]))
                scores["ABCD"[k]] = round(sum(coverage(c, plain(texts[q])) for c in clauses) / len(clauses), 9)
        best = min(scores, key=lambda k: (-scores[k], k))
        want |= {(q, k, v, k == best) for k, v in scores.items()}
    options = answering._scoped(spark, str(tmp_path))
    assert {(r.q, r.doc_id) for r in options.collect()} == {(q, q if q % 2 == 0 else q + 20) for q in items}
    assert {tuple(r) for r in answering.option_scoring(spark, str(tmp_path)).collect()} == want
    assert all(k == "ABCD"[q % 4] and v == 1 for q, k, v, chosen in want if chosen)
