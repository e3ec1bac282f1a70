"""Queries that answer questions from their text on, by tables and by text, and their SQL."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import answer, corpus, sheets, solve
from ..sources import readers
from ..sources.shared import new_path, stored
from .queries import _CELLS, _FOLD, _SPLIT, _block_docs, _cells, _opening, _values, t

LETTERS = "ABCD"
#: no, kind, title (n: a nation's, r: a region's, x: nobody's), sheet, two quoted terms, row and columns of a change, set of options.
TEMPLATES = (
    (0, solve.LOOKUP, "n", "", "9-NONE", "2-HIGH", "", "", "", "values"),
    (1, solve.LOOKUP, "n", "", "9-NONE", "", "", "", "", "values"),
    (2, solve.LOOKUP, "n", "", "1994年累计", "", "", "", "", "values"),
    (3, solve.LOOKUP, "n", "", "1-URGENT", "", "", "", "", "small"),
    (4, solve.LOOKUP, "n", "S）。", "1-URGENT", "", "", "", "", "values"),
    (5, solve.LOOKUP, "n", "Z", "1-URGENT", "", "", "", "", "values"),
    (6, solve.COMPARE, "n", "", "1994", "", "", "", "", "names"),
    (7, solve.COMPARE, "n", "", "", "", "", "", "", "names"),
    (8, solve.COMPARE, "n", "", "", "", "", "", "", "values"),
    (9, solve.CALCULATE, "n", "", "", "", "1-URGENT", "1993", "1995", "values"),
    (10, solve.CALCULATE, "n", "", "", "", "2-HIGH", "1800", "1801", "span"),
    (11, solve.CALCULATE, "n", "", "", "", "2-HIGH", "1800", "1801", "small"),
    (12, solve.CALCULATE, "n", "", "1-URGENT", "1994年累计", "", "", "", "values"),
    (13, solve.CALCULATE, "n", "", "1-URGENT", "2-HIGH", "", "", "", "small"),
    (14, solve.LOOKUP, "", "", "1-URGENT", "", "", "", "", "values"),
    (15, solve.LOOKUP, "x", "", "1-URGENT", "", "", "", "", "values"),
    (16, "other", "n", "", "1-URGENT", "", "", "", "", "values"),
    (17, solve.LOOKUP, "r", "", "2-HIGH", "", "", "", "", "values"),
    (18, solve.COMPARE, "r", "S", "1995", "", "", "", "", "names"),
)
FIELDS = "j int, kind string, title string, sheet string, t1 string, t2 string, d1 string, c1 string, c2 string, options string"


def _facts(spark, d):
    """Two sheets a nation; the first in the workbook, whose name comes last, has each value 7 larger."""
    cells = stored(_cells(spark, d).withColumn("sheet_no", F.lit(1)))
    value = F.when(F.col("raw").rlike("^[0-9]+$"), (F.col("raw").try_cast("bigint") + 7).cast("string")).otherwise(F.col("raw"))
    both = stored(cells.unionByName(cells.withColumns({"sheet": F.lit("Total T"), "sheet_no": F.lit(0), "raw": value})))
    return stored(sheets.facts(both))


def _names(spark, d):
    nations = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("n_nationkey").cast("string").alias("doc_id"), "r_name", "n_name", norm(F.concat("r_name", F.lit("-"), "n_name", F.lit("表"))).alias("name"))


def _questions(spark, d):
    """Each template for each nation. Options are amounts of the nation itself, indicators, or numbers that nothing comes near."""
    own = lambda p, order: F.min_by("v", F.when(F.col("prio") == p, order))
    place = F.struct("seg", "prio", "c")
    row = F.min(F.when(F.col("prio") == "1-URGENT", F.col("seg")))
    values = _values(spark, d)
    firsts = values.groupBy("doc_id").agg(own("1-URGENT", place).alias("u"), own("2-HIGH", place).alias("h"), F.min_by("v", F.when(F.col("c") == 3, F.struct("seg", "prio"))).alias("y"), row.alias("seg"))
    ends = values.join(firsts.select("doc_id", "seg"), ["doc_id", "seg"])
    at = lambda p, c: F.max(F.when((F.col("prio") == p) & (F.col("c") == c), F.col("v")))
    ends = ends.groupBy("doc_id").agg((at("1-URGENT", 4) - at("1-URGENT", 2)).alias("r"), (F.max_by("v", F.when(F.col("prio") == "2-HIGH", F.col("c"))) - F.min_by("v", F.when(F.col("prio") == "2-HIGH", F.col("c")))).alias("l"))
    rows = _names(spark, d).join(firsts.drop("seg"), "doc_id", "left").join(ends, "doc_id", "left").crossJoin(F.broadcast(spark.createDataFrame(TEMPLATES, FIELDS)))
    amount = lambda x: F.concat(F.lit("about "), x.cast("decimal(20,2)").cast("string"), F.lit(" yuan"))
    u, h, y = F.col("u") + 7, (F.col("h") + 7).cast("decimal(18,0)"), F.col("y") + 7
    plain = [F.lit(str(k)) for k in (1, 2, 3)]
    sets = {
        "values": [amount(u), amount(h * F.lit("1.01").cast("decimal(3,2)")), amount(u - y), amount(F.col("r"))],
        "span": [*plain, amount(F.col("l"))],
        "small": [*plain, F.lit("0.5")],
        "names": [F.lit(x) for x in ("1-URGENT", "2-HIGH", "9-NONE", "3-MEDIUM")],
    }
    options = []
    for i, k in enumerate(LETTERS):
        chosen = F.lit(None).cast("string")
        for name, held in sets.items():
            chosen = F.when(F.col("options") == name, held[i]).otherwise(chosen)
        options.append(chosen.alias(k))
    title = F.when(F.col("title") == "n", F.concat(F.lit("《 -"), "n_name", F.lit("表（Excel）》"))).when(F.col("title") == "r", F.concat(F.lit("《"), "r_name", F.lit(" -》"))).when(F.col("title") == "x", "《no such》").otherwise("")
    said = lambda c: F.when(F.col(c) != "", F.concat(F.lit("“"), c, F.lit("”"))).otherwise("")
    change = F.when(F.col("d1") != "", F.concat(said("d1"), F.lit("从"), said("c1"), F.lit("到"), said("c2"))).otherwise("")
    text = F.concat(title, F.when(F.col("sheet") != "", F.concat(F.lit("工作表："), "sheet", F.lit(" "))).otherwise(""), said("t1"), said("t2"), change)
    q = F.col("doc_id").cast("int") * 100 + F.col("j")
    return rows.select(q.alias("q"), "j", text.alias("question"), F.col("kind").alias("qa_type"), *options)


def table_solve(spark, d):
    return solve.table_solve(_questions(spark, d).drop("j"), _names(spark, d).select("doc_id", "name"), _facts(spark, d))


def graded_batch(spark, d):
    """Every fifth question is on text, whose answer is the option that a passage of the first two options covers best."""
    rows = _questions(spark, d)
    rows = rows.withColumns({"source_type": F.when(F.col("j") % 5 == 4, "word").otherwise("excel"), "gold": F.element_at(F.array(*map(F.lit, LETTERS)), F.col("j") % 4 + 1)})
    options = rows.select("q", F.explode(F.create_map(*[x for k in LETTERS for x in (F.lit(k), F.col(k))])).alias("letter", "option")).where("option is not null")
    hits = rows.where("j <> 14").select("q", F.lit(1).alias("rank"), F.col("q").alias("block_id"), F.concat(F.lit("of "), F.coalesce("B", F.lit("")), F.lit(" and "), F.coalesce("A", F.lit(""))).alias("text"))
    by_text = answer.fallback_option(options, hits).select("q", F.col("letter").alias("answer"))
    return solve.graded_batch(rows, _names(spark, d).select("doc_id", "name"), _facts(spark, d), by_text).select("q", "answer", "route", "reason", "gold", "correct")


def failed_rows(spark, d):
    """What blocks, facts and answers leave out, and how many rows each makes of the rest."""
    docs = _block_docs(spark, d).withColumn("n", F.expr("try_cast(substring(orig_name, 5) as int)"))
    broken = F.transform("units", lambda u: u.withField("text", F.when(F.col("n") % 19 > 0, u.text)))
    docs = docs.withColumn("units", F.when(F.col("n") % 17 > 0, broken)).drop("n")
    blocks, no_blocks = corpus.text_blocks_or_failures(docs, _opening)
    cells = stored(_cells(spark, d))
    bad = cells.where("doc_id = '3' and r = 0").unionByName(cells.where("doc_id = '4' and r = 0").withColumn("c", F.lit(None).cast("int")))
    facts, no_facts = sheets.facts_or_failures(stored(cells.unionByName(bad)))
    facts = stored(facts)
    asked = _questions(spark, d).where("j < 4")
    asked = asked.withColumn("question", F.when(F.col("q") % 5 > 0, F.col("question"))).drop("j")
    answers, no_answers = solve.solved_or_failures(asked.union(asked.where("q = 101")), _names(spark, d).select("doc_id", "name"), facts)
    parts = [(no_blocks, "doc_id", "blocks"), (no_facts, "doc_id", "facts"), (no_answers, "q", "answers")]
    rows = [df.select(F.lit(step).alias("step"), F.col(key).cast("string").alias("id"), "error", F.lit(1).cast("bigint").alias("n")) for df, key, step in parts]
    rows += [df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit("").alias("id"), F.lit("kept").alias("error"), "n") for df, step in ((blocks, "blocks"), (facts, "facts"), (answers, "answers"))]
    return functools.reduce(DataFrame.union, rows)


def facts_written(spark, d):
    """Facts written as they are stored for lookups, and read back."""
    path = new_path(spark)
    readers.write_facts(sheets.facts(stored(_cells(spark, d))), path)
    return spark.read.parquet(path).select("doc_id", "row", "col", "indicator", "column_label", "value")


QUERIES = {f.__name__: f for f in (table_solve, graded_batch, failed_rows, facts_written)}

_ROWS = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in TEMPLATES)
_SETS = {
    "values": ("u", "CAST(h AS DECIMAL(18,0)) * 1.01", "u - y", "r"),
    "span": ("'1'", "'2'", "'3'", "l"),
    "small": ("'1'", "'2'", "'3'", "'0.5'"),
    "names": ("'1-URGENT'", "'2-HIGH'", "'9-NONE'", "'3-MEDIUM'"),
}
_OPTIONS = ", ".join("CASE oset " + " ".join(f"WHEN '{name}' THEN " + (x[i] if x[i][0] == "'" else f"'about ' || CAST(CAST({x[i]} AS DECIMAL(20,2)) AS VARCHAR) || ' yuan'") for name, x in _SETS.items()) + f" END AS o{k}" for i, k in enumerate(LETTERS))
_NUMBERS = ", ".join(f"TRY_CAST(nullif(regexp_extract(replace(o{k}, ',', ''), '-?[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS n{k}" for k in LETTERS)


def _distances(v):
    pairs = ", ".join(f"{{'d': abs({v} - n{k}) / greatest(1.0, abs({v})), 'k': '{k}'}}" for k in LETTERS)
    return f"list_sort(list_filter([{pairs}], lambda x: x.d IS NOT NULL))"


def _nearest(v):
    return f"CASE WHEN {_distances(v)}[1].d < 0.02 THEN {_distances(v)}[1].k END"


def _cell(row, column):
    return f"chr(CAST(64 + {column} AS INT)) || {row}"


_SOLVE = f"""{_CELLS},
f AS (SELECT doc_id, sno, sheet, r + 1 AS row, c + 1 AS col, p, s || '/' || p AS path, (c + 1991) || '年累计' AS label, CAST(v + 7 * CAST(sno = 0 AS INT) AS DOUBLE) AS v FROM b, (VALUES (0, 'Total T'), (1, 'S')) sh(sno, sheet)),
k1 AS (SELECT doc_id, arg_min(v, (r, c)) FILTER (p = '1-URGENT') + 7 AS u, arg_min(v, (r, c)) FILTER (p = '2-HIGH') + 7 AS h, arg_min(v, r) FILTER (c = 3) + 7 AS y, min(s) FILTER (p = '1-URGENT') AS s1 FROM b GROUP BY 1),
k2 AS (SELECT b.doc_id, max(v) FILTER (p = '1-URGENT' AND c = 4) - max(v) FILTER (p = '1-URGENT' AND c = 2) AS r, arg_max(v, c) FILTER (p = '2-HIGH') - arg_min(v, c) FILTER (p = '2-HIGH') AS l FROM b JOIN k1 ON k1.doc_id = b.doc_id AND s = s1 GROUP BY 1),
names AS (SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, replace(r_name, ' ', '') || '-' || n_name || '表' AS name, '-' || n_name || '表' AS tn, replace(r_name, ' ', '') || '-' AS tr FROM nation JOIN region ON n_regionkey = r_regionkey),
tpl(j, kind, title, sheet, t1, t2, d1, c1, c2, oset) AS (VALUES {_ROWS}),
z0 AS (SELECT CAST(names.doc_id AS INT) * 100 + j AS q, CASE title WHEN 'n' THEN tn WHEN 'r' THEN tr WHEN 'x' THEN 'nosuch' END AS title, kind, j, nullif(regexp_replace(sheet, '[）。]', '', 'g'), '') AS asked, d1, c1, c2,
       list_filter([t1, t2, d1, c1, c2], lambda x: x <> '') AS quoted, {_OPTIONS} FROM names LEFT JOIN k1 USING (doc_id) LEFT JOIN k2 USING (doc_id), tpl),
z AS (SELECT *, {_NUMBERS} FROM z0),
tr AS (SELECT z.*, doc_id, row_number() OVER (PARTITION BY q ORDER BY length(name), doc_id) AS cand FROM z JOIN names ON contains(name, z.title)),
ask AS (SELECT q, doc_id, asked, quoted, 'q' AS k, i AS no, quoted[i] AS term FROM tr, unnest(range(1, len(quoted) + 1)) u(i) WHERE kind IN ('{solve.LOOKUP}', '{solve.CALCULATE}')
  UNION ALL SELECT q, doc_id, asked, quoted, 'c', i, [oA, oB, oC, oD][i] FROM tr, unnest(range(1, 5)) u(i) WHERE kind = '{solve.COMPARE}'
  UNION ALL SELECT q, doc_id, asked, quoted, 'd', 0, d1 FROM tr WHERE d1 <> ''),
hit0 AS (SELECT ask.*, sno, sheet, row, col, p, label, v, CASE WHEN p = term THEN 1 WHEN contains(path, term) THEN 2 WHEN label = term THEN 3 END AS tier,
         len(list_filter(quoted, lambda x: contains(label, x))) > 0 AS based FROM ask JOIN f USING (doc_id) WHERE asked IS NULL OR contains(replace(sheet, ' ', ''), asked) OR contains(asked, replace(sheet, ' ', ''))),
hit AS (SELECT * FROM hit0 WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY q, doc_id, k, no)),
one AS (SELECT *, row_number() OVER (PARTITION BY q, doc_id, k, no ORDER BY k = 'c' AND NOT based, sno, row, col) AS n FROM hit QUALIFY n = 1),
lk AS (SELECT * FROM one WHERE k = 'q' AND tier < 3 QUALIFY row_number() OVER (PARTITION BY q, doc_id ORDER BY no) = 1),
cm AS (SELECT * FROM one WHERE k = 'c' AND tier < 3 QUALIFY row_number() OVER (PARTITION BY q, doc_id ORDER BY v DESC, no) = 1),
pr0 AS (SELECT q, doc_id, row, col, v, row_number() OVER (PARTITION BY q, doc_id ORDER BY no) AS m FROM one WHERE k = 'q'),
pr AS (SELECT x.q, x.doc_id, x.v AS a, y.v AS b, {_cell("x.row", "x.col")} || ',' || {_cell("y.row", "y.col")} AS pat FROM pr0 x JOIN pr0 y ON x.q = y.q AND x.doc_id = y.doc_id AND x.m = 1 AND y.m = 2),
rw0 AS (SELECT q, doc_id, sno, sheet, row, min(col) AS hit FROM hit WHERE k = 'd' AND tier < 3 GROUP BY ALL),
rw AS (SELECT rw0.q, rw0.doc_id, rw0.sno, rw0.sheet, rw0.row, hit, arg_min(f.v, f.col) FILTER (contains(label, c2)) - arg_min(f.v, f.col) FILTER (contains(label, c1)) AS change,
       arg_max(f.v, f.col) - arg_min(f.v, f.col) AS span, count(*) AS n, min(f.col) AS lo, max(f.col) AS hi FROM rw0 JOIN f ON f.doc_id = rw0.doc_id AND f.sheet = rw0.sheet AND f.row = rw0.row JOIN z ON z.q = rw0.q GROUP BY ALL),
r1 AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY q, doc_id ORDER BY sno, row, hit) = 1),
r2 AS (SELECT rw.*, list_filter({_distances("span")}, lambda x: x.d < 0.02) AS near FROM rw JOIN z USING (q) WHERE n > 1 AND len(list_filter({_distances("span")}, lambda x: x.d < 0.02)) = 1
       QUALIFY row_number() OVER (PARTITION BY q, doc_id ORDER BY sno, row, hit) = 1),
al AS (SELECT tr.*, lk.v AS lv, lk.sheet AS ls, lk.p AS lp, {_cell("lk.row", "lk.col")} AS la, cm.v AS cv, cm.sheet AS cs, cm.p AS cp, {_cell("cm.row", "cm.col")} AS ca, 'ABCD'[cm.no] AS cl,
       r1.change, r1.sheet AS s1, {_cell("r1.row", "r1.hit")} AS a1, r2.span, r2.sheet AS s2, {_cell("r2.row", "r2.lo")} || ':' || {_cell("r2.row", "r2.hi")} AS a2, r2.near[1].k AS l2, pr.a, pr.b, pr.pat
       FROM tr LEFT JOIN lk USING (q, doc_id) LEFT JOIN cm USING (q, doc_id) LEFT JOIN r1 USING (q, doc_id) LEFT JOIN r2 USING (q, doc_id) LEFT JOIN pr USING (q, doc_id)),
st AS (SELECT *, {_nearest("lv")} AS l0, {_nearest("change")} AS l1, {_nearest("(a - b)")} AS p1, {_nearest("(b - a)")} AS p2, {_nearest("(a + b)")} AS p3 FROM al),
way AS (SELECT *, CASE WHEN kind = '{solve.LOOKUP}' THEN CASE WHEN lv IS NULL THEN 'indicator_not_found' ELSE 'table_lookup' END WHEN kind = '{solve.COMPARE}' THEN CASE WHEN cv IS NULL THEN 'compare_no_values' ELSE 'table_compare_max' END
        WHEN kind <> '{solve.CALCULATE}' THEN 'unknown_qa_type' WHEN l1 IS NOT NULL THEN 'table_calc_row' WHEN l2 IS NOT NULL THEN 'table_calc_span' WHEN coalesce(p1, p2, p3) IS NOT NULL THEN 'table_calc_fallback'
        WHEN a IS NOT NULL THEN 'calc_no_match' ELSE 'calc_need_two_values' END AS reason FROM st),
att AS (SELECT q, doc_id, cand, reason, CASE reason WHEN 'table_lookup' THEN l0 WHEN 'table_compare_max' THEN cl WHEN 'table_calc_row' THEN l1 WHEN 'table_calc_span' THEN l2 WHEN 'table_calc_fallback' THEN coalesce(p1, p2, p3) END AS answer,
        CASE reason WHEN 'table_lookup' THEN ls WHEN 'table_compare_max' THEN cs WHEN 'table_calc_row' THEN s1 WHEN 'table_calc_span' THEN s2 END AS sheet,
        CASE reason WHEN 'table_lookup' THEN la WHEN 'table_compare_max' THEN ca WHEN 'table_calc_row' THEN a1 WHEN 'table_calc_span' THEN a2 WHEN 'table_calc_fallback' THEN pat WHEN 'calc_no_match' THEN pat END AS address,
        CASE reason WHEN 'table_lookup' THEN lp WHEN 'table_compare_max' THEN cp WHEN 'table_calc_row' THEN d1 WHEN 'table_calc_span' THEN d1 END AS indicator,
        CASE reason WHEN 'table_lookup' THEN lv WHEN 'table_compare_max' THEN cv WHEN 'table_calc_row' THEN change WHEN 'table_calc_span' THEN span
             WHEN 'table_calc_fallback' THEN CASE WHEN p1 IS NOT NULL THEN a - b WHEN p2 IS NOT NULL THEN b - a ELSE a + b END END AS value FROM way),
best AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY q ORDER BY answer IS NULL, cand) = 1),
ts AS (SELECT z.q, doc_id, answer, coalesce(reason, CASE WHEN title IS NULL THEN 'no_title' ELSE 'doc_not_found' END) AS reason, sheet, address, indicator, value FROM z LEFT JOIN best USING (q))"""
_GRAMS = "list_transform(range(1, length(a) - 2), lambda i: a[i : i + 3])"

ORACLE_SQL = {
    "table_solve": f"WITH {_SOLVE} SELECT * FROM ts",
    "graded_batch": f"""WITH {_SOLVE}, o AS (SELECT q, 'ABCD'[i] AS letter, replace([oA, oB, oC, oD][i], ' ', '') AS a, replace('of ' || coalesce(oB, '') || ' and ' || coalesce(oA, ''), ' ', '') AS t FROM z, unnest(range(1, 5)) u(i) WHERE j <> 14 AND [oA, oB, oC, oD][i] IS NOT NULL),
        cv AS (SELECT q, letter, round(CASE WHEN length(a) < 4 THEN CAST(length(a) > 0 AND contains(t, a) AS DOUBLE) ELSE len(list_filter({_GRAMS}, lambda x: contains(t, x))) / len({_GRAMS}) END, 9) AS c FROM o),
        tx AS (SELECT q, letter FROM cv QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, letter) = 1),
        g AS (SELECT z.q, j % 5 = 4 AS word, 'ABCD'[j % 4 + 1] AS gold, ts.answer AS a, ts.reason, tx.letter AS b FROM z JOIN ts USING (q) LEFT JOIN tx USING (q)),
        h AS (SELECT q, CASE WHEN word THEN b ELSE coalesce(a, b) END AS answer, CASE WHEN NOT word AND a IS NOT NULL THEN 'table' ELSE 'text' END AS route, CASE WHEN NOT word AND a IS NULL THEN reason END AS reason, gold FROM g)
        SELECT *, coalesce(answer = gold, false) AS correct FROM h""",
    "facts_written": f"WITH {_CELLS} SELECT doc_id, r + 1 AS row, c + 1 AS col, p AS indicator, (c + 1991) || '年累计' AS column_label, CAST(v AS DOUBLE) AS value FROM b",
    "failed_rows": f"""WITH RECURSIVE typed AS (SELECT doc_id, replace(text, '. ', '。') AS text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) > 0 AS filled FROM documents WHERE doc_id % 4 < 3),
        lost AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'no_units' ELSE 'unit_without_text' END AS error FROM typed WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 AND filled),
        rest AS (SELECT doc_id, text FROM typed WHERE doc_id NOT IN (SELECT doc_id FROM lost)), {_FOLD.format(text="text", docs="rest")}, {_SPLIT},
        {_CELLS.replace("b AS (SELECT *, dense", "fb AS (SELECT *, dense")}, q AS (SELECT n_nationkey * 100 + j AS q FROM nation, unnest(range(4)) u(j))
        SELECT 'blocks' AS step, CAST(doc_id AS VARCHAR) AS id, error, 1::BIGINT AS n FROM lost UNION ALL SELECT 'blocks', '', 'kept', count(*) FROM pieces
        UNION ALL SELECT DISTINCT 'facts', doc_id, CASE doc_id WHEN '3' THEN 'two_cells_in_a_place' ELSE 'cell_without_place' END, 1 FROM fb WHERE doc_id IN ('3', '4')
        UNION ALL SELECT 'facts', '', 'kept', count(*) FROM fb WHERE doc_id NOT IN ('3', '4')
        UNION ALL SELECT 'answers', CAST(q AS VARCHAR), 'no_question', 1 FROM q WHERE q % 5 = 0
        UNION ALL SELECT 'answers', '101', 'repeated_id', 1 FROM q, unnest([1, 2]) WHERE q = 101
        UNION ALL SELECT 'answers', '', 'kept', count(*) FROM q WHERE q % 5 > 0 AND q <> 101""",
}
