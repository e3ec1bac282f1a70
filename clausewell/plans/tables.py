"""Queries on spreadsheets and answers from their facts, and their SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import answer, evaluate, evidence, sheets
from ..sources import readers
from .queries import _CELLS, _cells, _values, t

LETTERS = "ABCD"


def _grid(spark, d):
    """A sheet of ten columns for each hundred parts."""
    doc, r = F.floor(F.col("p_partkey") / 100).cast("string").alias("doc_id"), F.floor(F.col("p_partkey") % 100 / 10).cast("int").alias("r")
    rows = t(spark, d, "part").groupBy(doc, r).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x.p_name).alias("row"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x.row).alias("rows")).withColumn("sheet", F.lit("S"))


def grid_cells(spark, d):
    return sheets.grid_cells(_grid(spark, d)).drop("sheet")


def merged_cells(spark, d):
    cells = sheets.grid_cells(_grid(spark, d))
    merges = cells.where("c = 2 and r % 3 = 0").select("doc_id", "sheet", F.col("r").alias("r1"), (F.col("r") + 1).alias("r2"), F.lit(2).alias("c1"), F.lit(4).alias("c2"))
    return sheets.fill_merged(cells, merges).drop("sheet")


def fallback_header(spark, d):
    return sheets.facts(_cells(spark, d, mark="Y")).select("doc_id", "row", "col", "indicator_path", "column_label", "value")


def table_units(spark, d):
    """Every line of a document, then the table rows of the parts dealt to the documents 0 to 49."""
    lines = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    rows = t(spark, d, "part").select((F.col("p_partkey") % 50).cast("string").alias("doc_id"), F.lit(0).alias("t"), F.col("p_partkey").alias("r"), F.array("p_name", F.lit(" "), "p_brand").alias("cells"))
    return readers.document_units(lines, rows)


def _choices(spark, d):
    """Four numeric options for each nation, made of the first records of its first two priorities, and of the second's first row."""
    own = lambda p, v: F.when(F.col("prio") == p, v)
    first = lambda p: F.min_by("v", own(p, F.struct("seg", "c"))).cast("double")
    last = F.min_by("v", own("2-HIGH", F.struct(F.col("seg"), -F.col("c")))).cast("double")
    a, b = first("1-URGENT"), first("2-HIGH")
    rows = _values(spark, d).groupBy("doc_id").agg(a.alias("A"), (b * 1.01).alias("B"), (a - b).alias("C"), (last - b).alias("D"))
    return rows.withColumn("q", F.col("doc_id").cast("int"))


def _asked(spark, d, *terms):
    pairs = F.posexplode(F.array(*map(F.lit, terms))).alias("term_no", "term")
    return _choices(spark, d).select("q", "doc_id", *LETTERS, pairs)


def _facts(spark, d):
    return sheets.facts(_cells(spark, d))


def table_lookup(spark, d):
    return sheets.lookup_answer(_facts(spark, d), _asked(spark, d, "9-NONE", "2-HIGH", "1-URGENT"))


def table_compare(spark, d):
    terms = dict(zip(LETTERS, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), strict=True))
    asked = _choices(spark, d).select("q", "doc_id", F.explode(F.create_map(*[F.lit(x) for p in terms.items() for x in p])).alias("letter", "term"), F.array(F.lit("1994")).alias("bases"))
    return sheets.compare_answer(_facts(spark, d), asked, stock="URGENT")


def table_span(spark, d):
    return sheets.row_span(_facts(spark, d), _asked(spark, d, "2-HIGH"))


def table_pair(spark, d):
    return sheets.pair_answer(_facts(spark, d), _asked(spark, d, "9-NONE", "1-URGENT", "2-HIGH", "5-LOW"))


def table_evidence(spark, d):
    return sheets.table_evidence(_facts(spark, d), _asked(spark, d, "9-NONE", "2-HIGH", "1-URGENT", "2-HIGH"))


def _attempts(spark, d):
    solved = F.when(F.col("l_quantity") < 10, F.col("l_returnflag"))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("cand_no"), solved.alias("answer"), F.when(solved.isNull(), F.concat(F.lit("reason"), F.col("l_linenumber"))).alias("reason"))


def first_solved(spark, d):
    return answer.first_solved(_attempts(spark, d)).select("q", "cand_no", "answer", "reason")


def answer_route(spark, d):
    orders = t(spark, d, "orders")
    asked = orders.select(F.col("o_orderkey").alias("q"), F.when(F.col("o_orderstatus") == "F", "excel").otherwise("word").alias("source_type"))
    return answer.routed(asked, answer.first_solved(_attempts(spark, d)), orders.select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("answer")))


def evidence_hit_rates(spark, d):
    gold = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderpriority").alias("qa_type"), F.when(F.col("o_orderstatus") == "F", "excel").otherwise("word").alias("source_type"))
    rows = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    rows = rows.agg(F.min("l_suppkey").alias("s"), F.collect_list(F.concat(F.lit("B"), "l_linenumber")).alias("cells"), F.max("l_quantity").alias("most"), F.collect_list("l_quantity").alias("numbers"))
    named = rows.select("id", F.when(F.col("s") % 3 == 0, F.col("s") % 50).alias("doc_id"), F.when(F.col("s") % 3 == 1, (F.col("s") + 1) % 50).alias("evidence_doc"), (F.col("s") % 10).alias("fallback_doc"))
    files = evidence.file_hits(named, gold).withColumnRenamed("hit", "file_hit")
    held = rows.select("id", "cells", F.array(F.concat(F.lit("B"), (F.col("most") % 8).cast("int"))).alias("gold_cells"), "numbers", F.array(F.lit(25.0)).alias("gold_numbers"))
    held = evidence.table_hits(held).select("id", F.col("hit").alias("content_hit"))
    return evidence.hit_rates(files.join(held, "id", "left").withColumn("content_hit", F.coalesce("content_hit", F.lit(False))))


def answer_text_check(spark, d):
    letter = F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", letter.alias("answer"), F.col("l_returnflag").alias("answer_text"), F.lit(" A").alias("option_a"), F.lit("N ").alias("option_b"), F.lit("R").alias("option_c"), F.col("l_linestatus").alias("option_d"))
    return evaluate.inconsistent_answers(rows).select("l_orderkey", "l_linenumber", "answer", "answer_text")


def _unit_cells(spark, d):
    """Sheets as in the other queries, with a unit above the header and another before the third segment, and the
    second priority as a part of the first."""
    rows = _values(spark, d)
    own = W.partitionBy("doc_id")
    rows = rows.withColumn("k", F.dense_rank().over(own.orderBy("seg")))
    rows = rows.withColumn("r", F.dense_rank().over(own.orderBy("seg", "prio")) + F.col("k") + 1 + (F.col("k") > 2).cast("int"))
    name = F.when(F.col("prio") == "2-HIGH", F.concat(F.lit("其中："), "prio")).otherwise(F.col("prio"))
    tops = rows.groupBy("doc_id", "seg", "k").agg(F.min("r").alias("r"))
    parts = [
        rows.select("doc_id", "r", "c", F.col("v").cast("string").alias("raw")),
        rows.select("doc_id", "r", F.lit(0).alias("c"), name.alias("raw")).distinct(),
        tops.select("doc_id", (F.col("r") - 1).alias("r"), F.lit(0).alias("c"), F.col("seg").alias("raw")),
        tops.where("k = 3").select("doc_id", (F.col("r") - 2).alias("r"), F.lit(0).alias("c"), F.lit("单位：件").alias("raw")),
        rows.select("doc_id", F.lit(1).alias("r"), "c", F.concat(F.col("c") + 2001, F.lit("年")).alias("raw")).distinct(),
        rows.select("doc_id", F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(" 单位 ：万元").alias("raw")).distinct(),
    ]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells.withColumn("sheet", F.lit("S"))


def facts_units(spark, d):
    return sheets.facts(_unit_cells(spark, d)).drop("sheet")


def fact_counts(spark, d):
    cells = _unit_cells(spark, d)
    return sheets.fact_counts(cells, sheets.facts(cells))


def page_units(spark, d):
    """Pages with text by number, in documents of ten."""
    text = F.when(F.col("page_id") % 7 == 3, " ").otherwise(F.concat(F.lit(" "), "html", F.lit(" ")))
    rows = t(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("doc_id"), (F.col("page_id") % 10 + 1).cast("int").alias("page"), text.alias("text"))
    return readers.page_units(rows)


def manifest_files(spark, d):
    """Manifests, one a region, of nations as files, some entries twice."""
    entry = F.struct(F.col("n_name").alias("path"), F.col("n_nationkey").cast("bigint").alias("size"), F.sha2("n_name", 256).alias("sha256"))
    again = F.struct(F.col("n_name").alias("path"), (F.col("n_nationkey") + 100).cast("bigint").alias("size"), F.lit("later").alias("sha256"))
    nations = t(spark, d, "nation").select("n_regionkey", entry.alias("f")).union(t(spark, d, "nation").where("n_nationkey % 4 = 1").select("n_regionkey", again.alias("f")))
    files = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("f.size", "f"))).alias("fs"))
    return readers.manifest_files(files.select(F.to_json(F.struct(F.transform("fs", lambda x: x.f).alias("files"))).alias("value")))


def file_digests(spark, d):
    rows = t(spark, d, "documents").select(F.concat(F.lit("set/"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return readers.digests(rows.withColumn("length", F.length("content")))


def question_rows(spark, d):
    """Question sheets written as CSV lines and read again; rows without an id go."""
    rows = t(spark, d, "conversations").select(F.when(F.col("turn") % 3 < 2, F.concat("conv_id", F.lit("-"), "turn")).alias("id"), F.col("text").alias("question"), F.col("role").alias("option_a"))
    lines = rows.select(F.to_csv(F.struct("id", "question", "option_a"), {"escape": '"'}).alias("value"))
    read = lines.select(F.from_csv("value", "id string, question string, option_a string", {"escape": '"'}).alias("x")).select("x.*")
    return readers.sheet_rows(read)


def json_rows(spark, d):
    """Turns written as JSON lines and read again; every ninth line is cut short."""
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    lines = t(spark, d, "conversations").select(F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.expr("left(to_json(struct(conv_id, turn, text)), 12)")).otherwise(line).alias("value"))
    good, broken = readers.json_rows(lines, "conv_id bigint, turn bigint, text string")
    return good.withColumn("line", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (grid_cells, merged_cells, fallback_header, table_units, table_lookup, table_compare, table_span, table_pair, table_evidence, first_solved, answer_route, evidence_hit_rates, answer_text_check, facts_units, fact_counts, page_units, manifest_files, file_digests, question_rows, json_rows)}

_GRID = "g AS (SELECT CAST(p_partkey // 100 AS VARCHAR) AS doc_id, CAST(p_partkey % 100 // 10 AS INT) AS r, CAST(p_partkey % 10 AS INT) AS c, p_name AS raw FROM part)"
_U1, _H1 = (f"CAST(arg_min(v, (seg, c)) FILTER (prio = '{p}') AS DOUBLE)" for p in ("1-URGENT", "2-HIGH"))
_END = "CAST(arg_min(v, (seg, -c)) FILTER (prio = '2-HIGH') AS DOUBLE)"
_CHOICES = f"""{_CELLS}, ch AS (SELECT doc_id, {_U1} AS o1, {_H1} * 1.01 AS o2, {_U1} - {_H1} AS o3, {_END} - {_H1} AS o4 FROM a GROUP BY doc_id)"""
_PAIRS = ", ".join(f"{{'d': abs({{0}} - o{i}) / greatest(1.0, abs({{0}})), 'k': '{k}'}}" for i, k in enumerate(LETTERS, 1))
_DIST = f"list_sort(list_filter([{_PAIRS}], lambda x: x.d IS NOT NULL))"


def _dist(value):
    """SQL of the options' distances from a value, nearest first."""
    return _DIST.replace("{0}", value)


def _near(value):
    return f"CASE WHEN {_dist(value)}[1].d < 0.02 THEN {_dist(value)}[1].k END"


_FIRST = "f AS (SELECT doc_id, p, v, r, c, row_number() OVER (PARTITION BY doc_id, p ORDER BY r, c) AS n FROM b)"
_UNITS = """x0 AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_mktsegment AS seg, o_orderpriority AS prio, year(o_orderdate) - 1991 AS c, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        x1 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY seg) AS k, dense_rank() OVER (PARTITION BY doc_id ORDER BY seg, prio) AS n FROM x0),
        x AS (SELECT *, n + k + 1 + CAST(k > 2 AS INT) AS r, replace(CASE WHEN prio = '2-HIGH' THEN '其中：' ELSE '' END || prio, ' ', '') AS p, replace(seg, ' ', '') AS s FROM x1),
        rows AS (SELECT DISTINCT doc_id, r, p FROM x), ev AS (SELECT doc_id, r, CASE WHEN NOT starts_with(p, '其中') OR r = min(r) OVER (PARTITION BY doc_id) THEN p END AS e FROM rows),
        roots AS (SELECT doc_id, r, last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY r) AS family_root FROM ev)"""
_SOLVED = """s AS (SELECT l_orderkey AS q, l_linenumber AS cand_no, CASE WHEN l_quantity < 10 THEN l_returnflag END AS answer, CASE WHEN l_quantity < 10 THEN NULL ELSE 'reason' || l_linenumber END AS reason FROM lineitem),
        w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY answer IS NULL, cand_no, answer) = 1)"""

ORACLE_SQL = {
    "grid_cells": f"WITH {_GRID} SELECT * FROM g",
    "merged_cells": f"""WITH {_GRID} SELECT g.doc_id, g.r, g.c, CASE WHEN g.c BETWEEN 2 AND 4 AND g.r % 3 < 2 AND h.doc_id IS NOT NULL THEN h.raw ELSE g.raw END AS raw
        FROM g LEFT JOIN g h ON h.doc_id = g.doc_id AND h.r = g.r - g.r % 3 AND h.c = 2
        UNION ALL SELECT doc_id, r + 1, x, raw FROM g, unnest([2, 3, 4]) u(x) WHERE c = 2 AND r % 3 = 0 AND NOT EXISTS (FROM g k WHERE k.doc_id = g.doc_id AND k.r = g.r + 1 AND k.c = x)""",
    "fallback_header": f"WITH {_CELLS} SELECT doc_id, r + 1 AS row, c + 1 AS col, s || '/' || p AS indicator_path, (c + 1991) || 'Y' AS column_label, CAST(v AS DOUBLE) AS value FROM b",
    "table_units": """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS ls FROM documents),
        u AS (SELECT doc_id, 0 AS kind, i - 1 AS k, 'para' || (i - 1) AS location, trim(ls[i], ' ') AS text FROM l, unnest(range(1, len(ls) + 1)) t(i) WHERE trim(ls[i], ' ') <> ''
        UNION ALL SELECT CAST(p_partkey % 50 AS VARCHAR), 1, p_partkey, 'tbl0r' || p_partkey, p_name || ' |  | ' || p_brand FROM part)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, k) - 1 AS INT) AS unit_no, location, text FROM u""",
    "facts_units": f"WITH {_UNITS} SELECT doc_id, r + 1 AS row, c + 1 AS col, p AS indicator, s || '/' || p AS indicator_path, family_root, (c + 2001) || '年' AS column_label, CAST(v AS DOUBLE) AS value, CASE WHEN k < 3 THEN '万元' ELSE '件' END AS unit FROM x JOIN roots USING (doc_id, r)",
    "fact_counts": f"WITH {_UNITS} SELECT count(DISTINCT doc_id) AS workbooks, count(DISTINCT doc_id) AS sheets, count(*) AS records, 0::BIGINT AS failed FROM x",
    "page_units": "SELECT page_id // 10 AS doc_id, (page_id % 10 + 1)::INT AS unit_no, 'page' || (page_id % 10 + 1) AS location, trim(html, ' ') AS text FROM pages WHERE page_id % 7 <> 3 AND trim(html, ' ') <> ''",
    "manifest_files": "SELECT n_name AS path, (n_nationkey + CASE WHEN n_nationkey % 4 = 1 THEN 100 ELSE 0 END)::BIGINT AS size, CASE WHEN n_nationkey % 4 = 1 THEN 'later' ELSE sha256(n_name) END AS sha256 FROM nation",
    "file_digests": "SELECT 'set/' || doc_id AS local_path, octet_length(encode(text))::INT AS size, sha256(text) AS actual FROM documents",
    "question_rows": "SELECT conv_id || '-' || turn AS id, text AS question, role AS option_a FROM conversations WHERE turn % 3 < 2",
    "json_rows": """SELECT conv_id, turn, text, NULL::VARCHAR AS line FROM conversations WHERE (conv_id + turn) % 9 <> 0
        UNION ALL SELECT NULL, NULL, NULL, left('{"conv_id":' || conv_id || ',"turn":' || turn || ',', 12) FROM conversations WHERE (conv_id + turn) % 9 = 0""",
    "table_lookup": f"""WITH {_CHOICES}, {_FIRST}, h AS (SELECT * FROM f WHERE n = 1 AND p IN ('2-HIGH', '1-URGENT') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p = '1-URGENT') = 1)
        SELECT CAST(doc_id AS INT) AS q, doc_id, chr(CAST(c + 65 AS INT)) || (r + 1) AS address, CAST(v AS DOUBLE) AS value, {_near('v')} AS answer FROM h JOIN ch USING (doc_id)""",
    "table_compare": f"""WITH {_CHOICES}, f AS (SELECT doc_id, p, v FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY c <> 3, r, c) = 1),
        l AS (SELECT doc_id, p, v, CASE p WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '5-LOW' THEN 'D' END AS letter FROM f JOIN ch USING (doc_id))
        SELECT CAST(doc_id AS INT) AS q, letter AS answer, p AS indicator, CAST(v AS DOUBLE) AS value FROM l WHERE letter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY letter = 'A', v DESC, letter) = 1""",
    "table_span": f"""WITH {_CHOICES}, h AS (SELECT doc_id, r, CAST(arg_max(v, c) - arg_min(v, c) AS DOUBLE) AS difference FROM b WHERE p = '2-HIGH' GROUP BY ALL HAVING count(*) > 1),
        n AS (SELECT doc_id, r, difference, list_filter({_dist('difference')}, lambda x: x.d < 0.02) AS near FROM h JOIN ch USING (doc_id))
        SELECT CAST(doc_id AS INT) AS q, r + 1 AS row, difference, near[1].k AS answer FROM n WHERE len(near) = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r) = 1""",
    "table_pair": f"""WITH {_CHOICES}, {_FIRST}, h AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f WHERE n = 1 AND p IN ('1-URGENT', '2-HIGH', '5-LOW')),
        x AS (SELECT doc_id, CAST(max(v) FILTER (k = 1) AS DOUBLE) AS a, CAST(max(v) FILTER (k = 2) AS DOUBLE) AS b FROM h GROUP BY 1 HAVING count(*) > 1)
        SELECT CAST(doc_id AS INT) AS q, a AS first, b AS second, coalesce({_near('(a - b)')}, {_near('(b - a)')}, {_near('(a + b)')}) AS answer FROM x JOIN ch USING (doc_id)""",
    "table_evidence": f"""WITH {_CHOICES}, {_FIRST}, h AS (SELECT * FROM f JOIN ch USING (doc_id) WHERE n <= 2 AND p IN ('1-URGENT', '2-HIGH'))
        SELECT CAST(doc_id AS INT) AS q, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p = '1-URGENT', n) AS INT) AS no,
        'S!' || chr(CAST(c + 65 AS INT)) || (r + 1) || ': ' || p || '(' || p || ') [' || (c + 1991) || '年累计] = ' || v AS text, doc_id AS source, 'S!' || chr(CAST(c + 65 AS INT)) || (r + 1) AS location FROM h""",
    "first_solved": f"WITH {_SOLVED} SELECT * FROM w",
    "answer_route": f"""WITH {_SOLVED}, o AS (SELECT o_orderkey AS q, o_orderpriority AS b, o_orderstatus = 'F' AS x FROM orders)
        SELECT q, CASE WHEN x THEN coalesce(answer, b) ELSE b END AS answer, CASE WHEN x AND answer IS NOT NULL THEN 'table' ELSE 'text' END AS route,
        CASE WHEN x AND answer IS NULL THEN coalesce(reason, 'doc_not_found') END AS reason FROM o LEFT JOIN w USING (q)""",
    "evidence_hit_rates": """WITH r AS (SELECT l_orderkey AS id, min(l_suppkey) AS s, bool_or(abs(l_quantity - 25) < 0.01) AS near, list('B' || l_linenumber) AS cells, 'B' || CAST(max(l_quantity) % 8 AS INT) AS cell FROM lineitem GROUP BY 1),
        m AS (SELECT id, near OR list_contains(cells, cell) AS content, CASE s % 3 WHEN 0 THEN s % 50 WHEN 1 THEN (s + 1) % 50 ELSE s % 10 END AS named FROM r),
        j AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'excel' ELSE o_orderpriority END AS g, coalesce(named = o_custkey % 50, false) AS f, coalesce(content, false) AS content FROM orders LEFT JOIN m ON id = o_orderkey),
        k AS (SELECT * FROM j UNION ALL SELECT 'all', f, content FROM j)
        SELECT g AS grp, count(*) AS n, count(*) FILTER (f) AS files, count(*) FILTER (content) AS contents FROM k GROUP BY 1""",
    "answer_text_check": """WITH r AS (SELECT l_orderkey, l_linenumber, 'ABCDE'[l_suppkey % 5 + 1] AS answer, l_returnflag AS answer_text, l_linestatus AS st FROM lineitem)
        SELECT l_orderkey, l_linenumber, answer, answer_text FROM r WHERE NOT coalesce(answer_text = CASE answer WHEN 'A' THEN 'A' WHEN 'B' THEN 'N' WHEN 'C' THEN 'R' WHEN 'D' THEN st END, false)""",
}
