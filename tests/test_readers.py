import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from clausewell.operators import answer, evaluate, evidence, questions, sheets
from clausewell.sources import readers


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"path": "a", "size": 1, "sha256": "x"}, {"path": "b", "size": 2, "sha256": "y"}, {"path": "a", "size": 3, "sha256": "z"}]}))
    assert sorted(map(tuple, readers.manifest(spark, str(tmp_path / "m.json")).collect())) == [("a", 3, "z"), ("b", 2, "y")]
    (tmp_path / "n.json").write_text(json.dumps([{"num": "1", "orig_name": "n", "ext": "pdf", "local_path": "l", "zip_path": "z"}]))
    assert readers.mapping(spark, str(tmp_path / "n.json")).count() == 1
    got = {r.local_path.split("/")[-1]: r.actual for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got["m.json"] == hashlib.sha256((tmp_path / "m.json").read_bytes()).hexdigest()
    (tmp_path / "u.jsonl").write_text('{"doc_id": "1", "unit_no": 0, "text": "x"}\nbroken\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "u.jsonl"), readers.UNITS)
    assert [r.text for r in good.collect()] == ["x"] and [r.line for r in bad.collect()] == ["broken"]


def test_question_sheet(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,question,option_a,option_b\n1,"a, ""b""\nc",x,y\n,none,,\n')
    rows = readers.questions(spark, str(tmp_path / "q.csv"), 1)
    assert rows.first().question == 'a, "b"\nc' and [r.option for r in readers.options(rows, "ab").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        readers.questions(spark, str(tmp_path / "q.csv"), 2)


def test_units_and_facts(spark, tmp_path):
    text = spark.createDataFrame([("d", 0, " a "), ("d", 1, " "), ("d", 2, None)], "doc_id string, i int, text string")
    rows = spark.createDataFrame([("d", 0, 0, ["x ", None]), ("d", 0, 1, ["", " "])], "doc_id string, t int, r int, cells array<string>")
    assert [(r.unit_no, r.location, r.text) for r in readers.document_units(text, rows).orderBy("unit_no").collect()] == [(0, "para0", "a"), (1, "tbl0r0", "x | ")]
    pages = spark.createDataFrame([("d", 1, " "), ("d", 2, "t")], "doc_id string, page int, text string")
    assert [r.location for r in readers.page_units(pages).collect()] == ["page2"]
    facts = spark.createDataFrame([("d", "S", 1, 2, "i", "i", "i", "c", 1.0, "")], readers.FACTS)
    readers.write_facts(facts, str(tmp_path / "facts"), 4)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 1
    good, bad = readers.split_failures(spark.createDataFrame([(1, None), (2, "x")], "a int, error string"))
    assert (good.count(), bad.count(), good.columns) == (1, 1, ["a"])
    assert readers.exit_status(bad, str(tmp_path / "failed")) == 1 and readers.exit_status(bad.limit(0)) == 0
    assert json.loads((spark.read.text(str(tmp_path / "failed")).first().value)) == {"a": 2, "error": "x"}
    readers.write_rows(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).first().value == '{"a":1,"b":null}'
    readers.write_summary({"all": spark.createDataFrame([("x", 2, 50.0)], "kind string, n int, percent double")}, str(tmp_path / "summary"))
    assert json.loads(spark.read.text(str(tmp_path / "summary")).first().value) == {"all": [{"kind": "x", "n": 2, "percent": 50.0}]}


def test_merges(spark):
    cells = spark.createDataFrame([("d", "S", r, c, f"{r}{c}") for r in range(3) for c in range(3)], "doc_id string, sheet string, r int, c int, raw string")
    merges = spark.createDataFrame([("d", "S", 0, 1, 1, 2), ("e", "S", 0, 1, 0, 1)], "doc_id string, sheet string, r1 int, r2 int, c1 int, c2 int")
    texts = lambda half: [r.raw for r in sheets.fill_merged(cells, merges, half).orderBy("r", "c").collect()]
    assert texts(False) == ["00", "01", "01", "10", "01", "01", "20", "21", "22"]
    assert texts(True) == ["00", "01", "02", "10", "11", "12", "20", "21", "22"]


def test_fidelity(spark):
    ask = lambda a, e: spark.range(1).select(evaluate.fidelity(F.lit(a), F.lit(e), "no evidence").alias("x")).first().x
    assert [ask("no evidence 5", ""), ask("10.50", "10.5"), ask("10.6", "about 11"), ask("12.345", "12.34"), ask("7", "8"), ask("[3] yes", "")] == ["refused", "ok", "ok", "ok", "warn", "ok"]


def test_repair_without_help(spark):
    rows = spark.createDataFrame([("a", "x", "dev"), ("b", "x", "test")], "grp string, qa_type string, split string")
    assert sorted(map(tuple, questions.repair_types(rows).collect())) == [("a", "x", "dev"), ("b", "x", "test")]
    rows = spark.createDataFrame([("a", "x", "dev"), ("b", "y", "test"), ("c", "y", "test"), ("c", "y", "test"), ("d", "x", "dev")], "grp string, qa_type string, split string")
    assert {r.grp: r.split for r in questions.repair_types(rows).collect()} == {"a": "test", "b": "dev", "c": "test", "d": "dev"}


def repaired(rows, rounds=5):
    """A plain model: a round moves one group, dev's wants first."""
    split = {g: s for g, _, s in rows}
    size = {g: sum(1 for x in rows if x[0] == g) for g in split}
    for _ in range(rounds):
        held = {s: {q for g, q, _ in rows if split[g] == s} for s in ("dev", "test")}
        wants = [(s, sorted(held[o] - held[s])) for s, o in (("dev", "test"), ("test", "dev")) if held[o] - held[s]]
        if not wants:
            break
        side, types = wants[0]
        split[min((size[g], g) for g, q, _ in rows if q == types[0] and split[g] != side)[1]] = side
    return split


def test_repair_by_a_plain_model(spark):
    rng = random.Random(7)
    for _ in range(6):
        side = {f"g{i}": rng.choice(("dev", "test")) for i in range(7)}
        rows = [(g, rng.choice("abcdef"), s) for g, s in side.items() for _ in range(rng.randrange(1, 4))]
        got = questions.repair_types(spark.createDataFrame(rows, "grp string, qa_type string, split string")).collect()
        assert {r.grp: r.split for r in got} == repaired(rows)


def test_refusals(spark):
    options = spark.createDataFrame([(1, "A", "abcdef"), (1, "B", "abcdxx"), (2, "A", "x")], "q int, letter string, option string")
    hits = spark.createDataFrame([(1, 1, 7, "zabcdefz")], "q int, rank int, block_id int, text string")
    got = {r.q: (r.letter, r.refused) for r in answer.fallback_option(options, hits).collect()}
    assert got == {1: ("A", False), 2: (None, True)}
    none = spark.createDataFrame([], "q int, no int, text string, source string, location string")
    assert evidence.prompts(spark.createDataFrame([(1, "why")], "q int, question string"), none).first().prompt == "why"
