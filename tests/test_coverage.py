import random
import time

import pytest
from pyspark.sql import functions as F

from clausewell.functions import text as X
from clausewell.operators import answer, coverage, evidence


def plain(a, t, n=4):
    a, t = a or "", t or ""
    if len(a) < n:
        return float(a != "" and a in t)
    runs = [a[i : i + n] for i in range(len(a) - n + 1)]
    return sum(r in t for r in runs) / len(runs)


def test_grams_of_any_characters(spark):
    rows = spark.createDataFrame([("abcde",), ("a€😀é资本",), ("abc",), ("",)], "s string")
    got = [r.g for r in rows.select(X.grams(F.col("s"), 4).alias("g")).collect()]
    assert got == [["abcd", "bcde"], ["a€😀é", "€😀é资", "😀é资本"], [], []]


@pytest.mark.parametrize("n", [2, 4])
def test_pairs_by_a_plain_count(spark, n):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choices("ab资😀", k=k))
    asked = [(d, a) for d in (1, 2, 3, 9) for a in [word(rng.randrange(12)) for _ in range(6)] + ["", None, "aaaaaaa"]] + [(None, "ab")]
    texts = [(d, b, t) for d in (1, 2, 4) for b, t in enumerate([word(rng.randrange(40)) for _ in range(5)] + ["", None, "aaa", "aaaa"])]
    got = coverage.pair_coverage(spark.createDataFrame([*asked, *asked], "d int, a string"), spark.createDataFrame(texts, "d int, b int, t string"), ["d"], ["b"], n).collect()
    want = {(d, b, a or ""): plain(a, t, n) for d, a in asked for e, b, t in texts if d == e}
    assert {(r.d, r.b, r.a): r.coverage for r in got} == want and len(got) == len(want)


def test_audit_with_nulls_and_repeated_questions(spark):
    asked = spark.createDataFrame([(1, 7, "k", "abcd ef"), (1, 7, "k", "abcd ef"), (2, 7, "k", None), (3, 8, "k", "abcd"), (4, None, "k", "abcd"), (5, 9, "k", "ab"), (6, 7, "k", "")], "q int, doc_id int, source_type string, evidence string")
    units = spark.createDataFrame([(7, 1, "ef"), (7, 0, "x abc d"), (9, 0, None), (9, 1, "ca b"), (5, 0, "abcd")], "doc_id int, unit_no int, text string")
    got = sorted((r.q, r.coverage, r.note) for r in evidence.extraction_audit(asked, units).collect() if r.q)
    assert got == [(1, 1.0, "ok"), (1, 1.0, "ok"), (2, 0.0, "miss"), (3, 0.0, "empty"), (4, 0.0, "empty"), (5, 1.0, "ok"), (6, 0.0, "miss")]
    assert evidence.extraction_audit(asked.limit(0), units).count() == 0 and evidence.extraction_audit(asked, units.limit(0)).where("note = 'empty'").count() == 7


def test_work_grows_with_the_texts_not_their_product(spark):
    """Evidence as long as its document: four times the length takes far less than sixteen times the time."""
    rng = random.Random(3)

    def seconds(size):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
        asked, held = spark.createDataFrame([(1, text[::-1])], "d int, a string"), spark.createDataFrame([(1, text)], "d int, t string")
        begun = time.monotonic()
        found = coverage.pair_coverage(asked, held, ["d"], []).collect()[0].coverage
        assert 0 < found < 1
        return time.monotonic() - begun

    seconds(1000)
    small, large = seconds(200_000), seconds(800_000)
    assert large < 8 * small + 2


@pytest.mark.parametrize("n", [2, 4])
def test_all_parts_of_a_question_in_one_pass_over_a_text(spark, n):
    rng = random.Random(10 + n)
    word = lambda k: "".join(rng.choices("ab资😀 ", k=k))
    parts = [(q, i, a) for q in (1, 2, 3) for i, a in enumerate([word(rng.randrange(12)) for _ in range(6)] + ["", None, "aaaaaaa", "a b"])]
    texts = [(q, b, t) for q in (1, 2, 4) for b, t in enumerate([word(rng.randrange(40)) for _ in range(5)] + ["", None, "aaa", "aaaa"])]
    got = coverage.parts_coverage(spark.createDataFrame(parts, "q int, i int, a string"), spark.createDataFrame(texts, "q int, b int, t string"), "q", n).collect()
    bare = lambda x: x and x.replace(" ", "")
    want = {(q, b, i): None if a is None or t is None else plain(bare(a), bare(t), n) for q, i, a in parts for e, b, t in texts if q == e}
    assert {(r.q, r.b, r.i): r.coverage for r in got} == want and len(got) == len(want)


def test_options_as_long_as_their_texts(spark):
    """Four times the length of options and texts takes far less than sixteen times the time."""
    rng = random.Random(4)

    def seconds(size):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
        options = spark.createDataFrame([(1, "A", text[::-1]), (1, "B", text[1:])], "q int, letter string, option string")
        begun = time.monotonic()
        assert answer.fallback_option(options, spark.createDataFrame([(1, 1, 7, text)], "q int, rank int, block_id int, text string")).first().letter == "B"
        return time.monotonic() - begun

    seconds(1000)
    small, large = seconds(50_000), seconds(200_000)
    assert large < 8 * small + 2
