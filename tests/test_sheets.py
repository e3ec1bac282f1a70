from clausewell.operators import sheets


def test_facts(spark):
    grid = [
        ["2024年9月人身险公司经营情况表", "", ""], ["单位：亿元", "", ""], ["指标", "本月", "本年累计"], ["一、收入", "", ""], ["原保险保费收入", "1,200.5", "3400"],
        ["其中：寿险", "800", "—"], ["单位：万件", "", ""], ["新增保单件数", "55", "210"],
    ]
    cells = spark.createDataFrame([("7", "S", r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "doc_id string, sheet string, r int, c int, raw string")
    facts = sheets.facts(cells).cache()
    got = [tuple(x)[2:] for x in facts.orderBy("row", "col").collect()]
    assert got == [
        (5, 2, "原保险保费收入", "一、收入/原保险保费收入", "原保险保费收入", "本月", 1200.5, "亿元"),
        (5, 3, "原保险保费收入", "一、收入/原保险保费收入", "原保险保费收入", "本年累计", 3400.0, "亿元"),
        (6, 2, "其中：寿险", "一、收入/其中：寿险", "原保险保费收入", "本月", 800.0, "亿元"),
        (8, 2, "新增保单件数", "新增保单件数", "新增保单件数", "本月", 55.0, "万件"),
        (8, 3, "新增保单件数", "新增保单件数", "新增保单件数", "本年累计", 210.0, "万件"),
    ]
    asked = spark.createDataFrame([(1, "7", "寿险"), (2, "7", "本月"), (3, "7", "原保险保费收入")], "q int, doc_id string, term string")
    assert [r["count"] for r in sheets.lookup(facts, asked).groupBy("q").count().orderBy("q").collect()] == [1, 3, 2]
    asked = spark.createDataFrame([(1, "7", "原保险保费收入", "本月", "本年累计")], "q int, doc_id string, term string, col1 string, col2 string")
    assert sheets.row_difference(facts, asked).first().difference == 2199.5
    assert tuple(sheets.fact_counts(cells, facts).first()) == (1, 1, 5, 0)


def test_headers(spark):
    words = {"2024年9月": True, "1999年": False, "比年初": True, "余额": True, "上年末": True, "二季度末": True, "3月末": True, "期末": False, "x" * 15 + "本月": False}
    row = lambda d, r, c, v: (d, "S", r, c, v, None)
    cells = [x for k, w in enumerate(words) for x in (row(str(k), 0, 1, w), row(str(k), 1, 0, "甲"), row(str(k), 1, 1, "5"))]
    kind = "doc_id string, sheet string, r int, c int, raw string, num double"
    found = {r.doc_id for r in sheets.facts(spark.createDataFrame(cells, kind)).collect()}
    assert found == {str(k) for k, ok in enumerate(words.values()) if ok}
    # a cell that is numeric in the workbook is a number whatever its text says
    cells = [row("d", 0, 1, "本月"), row("d", 1, 0, "甲"), ("d", "S", 1, 1, "五", 5.0)]
    assert sheets.facts(spark.createDataFrame(cells, kind)).first().value == 5.0
