"""The chained table solver against a plain walk over records, as a question at a time would be answered."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clausewell.operators import sheets, solve

FACT = "doc_id string, sheet string, sheet_no int, row int, col int, indicator string, indicator_path string, family_root string, column_label string, value double, unit string"
QUESTION = "q int, question string, qa_type string, A string, B string, C string, D string"


def _hits(facts, doc, term, sheet):
    own = [f for f in facts if f["doc_id"] == doc and (not sheet or sheet in f["sheet"] or f["sheet"] in sheet)]
    own.sort(key=lambda f: (f["sheet_no"], f["row"], f["col"]))
    for kind, meets in (("i", lambda f: f["indicator"] == term), ("i", lambda f: term in f["indicator_path"]), ("c", lambda f: f["column_label"] == term)):
        found = [f for f in own if meets(f)]
        if found:
            return kind, found
    return None, []


def _number(text):
    m = re.search(r"-?\d+(\.\d+)?", (text or "").replace(",", ""))
    return float(m[0]) if m else None


def _off(value, option):
    return abs(value - option) / max(1.0, abs(value))


def _nearest(value, options):
    best = min(((_off(value, n), k) for k, n in options.items() if n is not None), default=(9, None))
    return best[1] if best[0] < 0.02 else None


def _one(facts, doc, kind, quoted, change, sheet, texts):
    options = {k: _number(v) for k, v in texts.items()}
    met = [(k, f[0]["value"]) for k, f in (_hits(facts, doc, t, sheet) for t in quoted) if k]
    if kind == solve.LOOKUP:
        values = [v for k, v in met if k == "i"]
        return (_nearest(values[0], options), "table_lookup") if values else (None, "indicator_not_found")
    if kind == solve.COMPARE:
        scored = []
        for letter, text in texts.items():
            k, found = _hits(facts, doc, text, sheet)
            if k == "i":
                found = [f for f in found if any(b in f["column_label"] for b in quoted)] or found
                scored.append((bool(re.search(sheets.STOCK, found[0]["indicator"])), -found[0]["value"], letter))
        return (min(scored)[2], "table_compare_max") if scored else (None, "compare_no_values")
    if kind != solve.CALCULATE:
        return None, "unknown_qa_type"
    if change:
        k, found = _hits(facts, doc, change[0], sheet)
        rows = {}
        for f in found if k == "i" else []:
            rows.setdefault((f["sheet"], f["row"]), sorted((g for g in facts if (g["doc_id"], g["sheet"], g["row"]) == (doc, f["sheet"], f["row"])), key=lambda g: g["col"]))
        for row in list(rows.values())[:1]:
            a, b = ([g["value"] for g in row if c in g["column_label"]] for c in change[1:])
            if a and b and _nearest(b[0] - a[0], options):
                return _nearest(b[0] - a[0], options), "table_calc_row"
        for row in rows.values():
            near = [k for k, n in options.items() if n is not None and _off(row[-1]["value"] - row[0]["value"], n) < 0.02]
            if len(row) > 1 and len(near) == 1:
                return near[0], "table_calc_span"
    if len(met) < 2:
        return None, "calc_need_two_values"
    a, b = met[0][1], met[1][1]
    found = [_nearest(v, options) for v in (a - b, b - a, a + b)]
    return next(((k, "table_calc_fallback") for k in found if k), (None, "calc_no_match"))


@pytest.mark.parametrize("seed", [1, 2])
def test_table_solve_against_a_walk(spark, seed):
    rng = random.Random(seed)
    indicators = ["保费", "赔款", "总资产", "件数", "其中车险"]
    facts = []
    for doc in "123":
        for no, sheet in enumerate(rng.sample(["甲表", "乙表", "甲表附"], 2)):
            for row in range(2, 7):
                name, group = rng.choice(indicators), rng.choice(["财险", "寿险"])
                for col in rng.sample(range(2, 6), rng.randrange(1, 4)):
                    facts.append((doc, sheet, no, row, col, name, f"{group}/{name}", name, f"{2018 + col}年累计", float(rng.choice([1, 2, 5, 10, 40, 100])), ""))
    plain = [dict(zip(("doc_id", "sheet", "sheet_no", "row", "col", "indicator", "indicator_path", "family_root", "column_label", "value"), f, strict=False)) for f in facts]
    names = {"1": "统计表一季度", "2": "统计表", "3": "保险统计表二季度"}
    questions, want = [], {}
    for q in range(160):
        kind = rng.choice([solve.LOOKUP, solve.COMPARE, solve.CALCULATE, solve.CALCULATE, "其他题"])
        title, sheet = rng.choice(["统计表", "保险统计表", "一季度", "没有的表", None]), rng.choice([None, None, "甲表", "乙"])
        terms = [rng.choice([*indicators, "财险", "2020年累计", "2021", "没有"]) for _ in range(rng.randrange(4))]
        change = (rng.choice(indicators), *rng.sample(["2020年", "2021年", "2022年", "1999年"], 2)) if kind == solve.CALCULATE and rng.random() < 0.6 else None
        texts = {k: rng.choice(indicators) if kind == solve.COMPARE else f"约{rng.choice([1, -1, 3, 9, 39, 1040, 8, 90, 95])}.0亿" for k in "ABCD"}
        text = (f"《{title}》" if title else "") + (f"工作表：{sheet}。 " if sheet else "") + "".join(f"“{x}”" for x in terms) + ("，“{}”从“{}”到“{}”的变化".format(*change) if change else "")
        quoted = terms + list(change or [])
        questions.append((q, text, kind, *texts.values()))
        if title is None:
            want[q] = (None, "no_title")
            continue
        docs = sorted((d for d in names if title in names[d]), key=lambda d: (len(names[d]), d))
        tried = [_one(plain, d, kind, quoted, change, sheet, texts) for d in docs]
        want[q] = next((x for x in tried if x[0]), tried[0] if tried else (None, "doc_not_found"))
    rows = solve.table_solve(spark.createDataFrame(questions, QUESTION), spark.createDataFrame(list(names.items()), "doc_id string, name string"), spark.createDataFrame(facts, FACT))
    assert {r.q: (r.answer, r.reason) for r in rows.collect()} == want
    assert len({w[1] for w in want.values()}) >= 10


def test_evidence_and_order_of_sheets(spark):
    rows = [("1", "Z", 0, 3, 2, "保费", "保费", "", "2020年", 10.0, ""), ("1", "A", 1, 3, 2, "保费", "保费", "", "2020年", 99.0, ""), ("1", "A", 1, 4, 2, "赔款", "赔款", "", "2020年", 5.0, "")]
    facts, names = spark.createDataFrame(rows, FACT), spark.createDataFrame([("1", "表")], "doc_id string, name string")
    asked = spark.createDataFrame([(1, "《表》“保费”", solve.LOOKUP, "10", "99", "x", None), (2, "《表》工作表：A “保费”", solve.LOOKUP, "10", "99", "x", None), (3, "《表》“赔款”“2020年”", solve.CALCULATE, "-5", "7", None, "")], QUESTION)
    got = {r.q: r for r in solve.table_solve(asked, names, facts).collect()}
    assert (got[1].answer, got[1].sheet, got[1].address, got[1].value) == ("A", "Z", "B3", 10.0)
    assert (got[2].answer, got[2].sheet) == ("B", "A")
    assert (got[3].answer, got[3].reason, got[3].address, got[3].value) == ("A", "table_calc_fallback", "B4,B3", -5.0)  # a column label counts
    assert solve.table_solve(asked.limit(0), names, facts).count() == 0
    assert {r.reason for r in solve.table_solve(asked, names.limit(0), facts).collect()} == {"doc_not_found"}
    assert {r.reason for r in solve.table_solve(asked, names, facts.limit(0)).collect()} == {"indicator_not_found", "calc_need_two_values"}


def test_graded_batch_takes_the_text_answer_where_tables_fail(spark):
    facts = spark.createDataFrame([("1", "S", 0, 3, 2, "保费", "保费", "", "2020年", 10.0, "")], FACT)
    names = spark.createDataFrame([("1", "表")], "doc_id string, name string")
    asked = spark.createDataFrame([(k, "《表》“保费”" if k < 3 else "x", solve.LOOKUP, a, "2", "3", "4") for k, a in ((1, "10"), (2, "11"), (3, "10"), (4, "1"))], QUESTION)
    asked = asked.withColumns({"source_type": F.when(F.col("q") < 4, "excel").otherwise("word"), "gold": F.lit("A")})
    text = spark.createDataFrame([(2, "A"), (3, "B"), (4, "A")], "q int, answer string")
    got = {r.q: (r.answer, r.route, r.reason, r.correct) for r in solve.graded_batch(asked, names, facts, text).collect()}
    assert got == {1: ("A", "table", None, True), 2: ("A", "text", "table_lookup", True), 3: ("B", "text", "no_title", False), 4: ("A", "text", None, True)}
