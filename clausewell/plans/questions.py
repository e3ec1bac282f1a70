"""Queries on question sets, evidence and option strategies, and their SQL."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer, evaluate, evidence, match, questions, retrieve
from ..sources.shared import stored
from .answering import _COVERAGE, _SHARED, _coverage, _located, _options
from .queries import _BM25, _DENSE, _N, _bm25, _hybrid, _units, t

#: Question forms of these queries, in turn.
FORMS = ("When did 《{}》 come out?", "Who keeps 《{}》?", "Is 《{}》 still open?")
#: name, hits taken, scores fused, options by clauses
VARIANTS = [("V0", 10, False, False), ("V1", 20, False, False), ("V2", 20, True, False), ("V3", 20, False, True), ("V4", 20, True, True)]


def _asked_hybrid(spark, d, k, ranked=None):
    """Fused hits of the benchmark passages; vectors that are asked without a passage are no questions."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("q"))
    return stored(_hybrid(spark, d, k, ranked).withColumnRenamed("query_id", "q").join(asked, "q", "left_semi"))


def _texts(spark, d, hits):
    return hits.join(t(spark, d, "documents").select(F.col("doc_id").alias("block_id"), "text"), "block_id")


def fallback_option(spark, d):
    ranked = _bm25(spark, d, 50)
    options = _options(spark, d, _located(spark, d, ranked)).drop("doc_id")
    return answer.fallback_option(options, _texts(spark, d, _asked_hybrid(spark, d, 20, ranked)))


def strategy_sweep(spark, d):
    ranked = _bm25(spark, d, 20)
    top = ranked.where(F.col("rank") == 1).select(F.col("query_id").alias("i"), F.col("score").alias("top"))
    strength = top.select(F.col("i").alias("q"), F.lit("A").alias("letter"), "top").union(top.select(F.col("i") - 1, F.lit("B"), "top"))
    hits = ranked.select(F.col("query_id").alias("q"), "block_id", "rank")
    return answer.sweep(_options(spark, d, _located(spark, d, ranked)).drop("doc_id"), _texts(spark, d, hits), strength, VARIANTS)


def _statements(spark, d, top=None):
    return _coverage(spark, d, top).withColumn("statement_no", F.concat("letter", "clause_no"))


def statement_hits(spark, d):
    return evaluate.statements_hit(_statements(spark, d))


def statement_hits_cosine(spark, d):
    """As statement_hits, with the cosine of the vectors of a question's and its document's numbers for all its statements."""
    unit = t(spark, d, "embeddings").select("vec_id", retrieve.unit(F.col("embedding")).alias("v"))
    top = _located(spark, d)
    near = top.join(unit.select(F.col("vec_id").alias("q"), F.col("v").alias("a")), "q").join(unit.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("b")), "doc_id")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return evaluate.statements_hit(_statements(spark, d, top).join(near.select("q", dot.alias("cosine")), "q", "left"), least=0.9, least_cosine=0.1)


def _vectors(spark, d, among):
    """Unit vectors of the ids of among(vec_id), of which these queries ask a hundred at most; no other vector is shuffled."""
    asked = t(spark, d, "embeddings").join(F.broadcast(among.select("vec_id").distinct()), "vec_id", "left_semi")
    return asked.select("vec_id", retrieve.unit(F.col("embedding")).alias("v"))


def statement_hits_vectors(spark, d):
    """As statement_hits, with a vector for each statement and for each block, and their cosine."""
    top = _located(spark, d)
    rows = _statements(spark, d, top).join(top, "q")
    said = rows.select("q", "statement_no", ((F.col("q") * 31 + F.col("clause_no")) % 100).alias("vec_id")).distinct()
    held = rows.select("doc_id", "block_no", ((F.col("doc_id") + F.col("block_no") * 7) % 100).alias("vec_id")).distinct()
    said, held = (x.join(_vectors(spark, d, x), "vec_id").drop("vec_id") for x in (said, held))
    return evaluate.statements_hit(evaluate.with_cosine(rows, said, held), least=0.9, least_cosine=0.3)


def cited_blocks(spark, d):
    """Lines of documents under places of three lines each: the last of each place."""
    blocks = _units(spark, d).select("doc_id", F.concat(F.lit("para"), F.floor(F.col("unit_no") / 3)).alias("location"), F.col("unit_no").alias("ord"), "text")
    return evaluate.cited_blocks(blocks)


def strategy_accuracy(spark, d):
    """Variants over all questions, some of which have no options that a document was found for."""
    q = F.col("item_id")
    asked = t(spark, d, "benchmark").select(q.alias("q"), F.when(q % 3 == 0, "single").otherwise("other").alias("qa_type"), F.when(q % 4 == 1, "B").otherwise("A").alias("gold"))
    asked = asked.union(asked.where("q % 5 = 0").withColumn("q", F.col("q") + 1000000))
    return answer.sweep_accuracy(strategy_sweep(spark, d), asked, [v[0] for v in VARIANTS])


def document_prompts(spark, d):
    top = _located(spark, d)
    blocks = _units(spark, d, top).select("doc_id", F.col("unit_no").alias("block_no"), "text", F.concat(F.lit("para"), "unit_no").alias("location"))
    found = evidence.document_evidence(top, blocks)
    return evidence.prompts(t(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question")), found)


def retrieved_evidence(spark, d):
    blocks = t(spark, d, "documents").select(F.col("doc_id").alias("block_id"), "text", "source", F.lit("whole").alias("location"))
    return evidence.retrieved_evidence(_asked_hybrid(spark, d, 6), blocks)


def _audit(spark, d):
    top = _located(spark, d)
    asked = top.join(t(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("evidence")), "q")
    asked = asked.join(t(spark, d, "documents").select("doc_id", F.col("source").alias("source_type")), "doc_id")
    return evidence.extraction_audit(stored(asked), _units(spark, d, top))


def extraction_audit(spark, d):
    return _audit(spark, d)


def extraction_totals(spark, d):
    return evidence.audit_summary(_audit(spark, d))[0]


def extraction_misses(spark, d):
    return evidence.audit_summary(_audit(spark, d))[1]


def _names(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("name_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("ext"))


def _labels(spark, d):
    digits = F.substring("s_name", -9, 9)
    k = F.col("s_suppkey")
    label = F.when(k % 7 == 0, F.concat(F.lit("none "), k)).when(k % 3 == 0, F.concat(digits, F.lit("zz"))).otherwise(F.substring(digits, 6, 3))
    return t(spark, d, "supplier").select(k.alias("label_id"), label.alias("label"), F.lit("BUILDING").alias("label_ext"))


def label_match(spark, d):
    return questions.match_labels(_labels(spark, d), _names(spark, d), least=9)


def label_issues(spark, d):
    return questions.label_issues(_labels(spark, d), _names(spark, d), label_match(spark, d))


def sheet_locate(spark, d):
    titles = t(spark, d, "supplier").select(F.col("s_suppkey").alias("title_id"), F.substring("s_name", -4, 4).alias("title"))
    return match.locate(titles, _names(spark, d).where("ext in ('BUILDING', 'MACHINERY')"))


def unlocated_titles(spark, d):
    asked = t(spark, d, "supplier").select(F.col("s_suppkey").alias("q"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.substring("s_name", -4, 4), F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(""))).alias("title"))
    return evidence.unlocated(asked, match.located(asked, _names(spark, d)))


def _outside(spark, d):
    titles = t(spark, d, "benchmark").select((F.col("item_id") + 1).alias("title_id"), F.col("text").alias("title"))
    kept = match.out_of_corpus(titles, t(spark, d, "pages").select(F.col("html").alias("name")), 24)
    n = F.col("n_nationkey").cast("bigint")
    topics = t(spark, d, "nation").select((n + 1).alias("topic_id"), F.concat(F.lit("0 "), n).alias("topic"), F.concat(F.lit("What of "), "n_name", F.lit("?")).alias("question"))
    return questions.outside_questions(titles, kept, topics, questions.absent_topics(topics, _names(spark, d)), FORMS)


def outside_questions(spark, d):
    return _outside(spark, d)


def outside_counts(spark, d):
    return questions.kind_counts(_outside(spark, d))


def type_repair(spark, d):
    """Conversations with late or last turns are test, all others dev; of these some have a type of their own."""
    rows = t(spark, d, "conversations").join(t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    kind = F.when(F.col("turn") > 4, F.when(F.col("conv_id") % 2 == 0, "late").otherwise("last"))
    kind = F.coalesce(kind, F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0) & (F.col("last") <= 4), "solo"), F.lit("early"))
    rows = rows.select(F.col("conv_id").alias("grp"), "turn", kind.alias("qa_type"), F.when(F.col("last") > 4, "test").otherwise("dev").alias("split"))
    return questions.repair_types(rows)


def demo_sample(spark, d):
    return questions.one_each(t(spark, d, "documents"), "lang", "doc_id").select("lang", "doc_id", "n_chars")


def question_parse(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("《"), "text", F.lit("》工作表："), "role", F.lit("（a）b）。 “"), "role", F.lit("”或“"), "text", F.lit("”从“x"), "turn", F.lit("”到“y”")).alias("question"))
    x = F.col("question")
    change = X.difference_terms(x)
    return rows.select("conv_id", "turn", X.question_title(x).alias("title"), X.question_sheet(x).alias("sheet"), F.array_join(X.question_terms(x), "|").alias("terms"), change.term.alias("term"), change.col1.alias("col1"))


def title_stems(spark, d):
    """File names made of customers' names: stems, and titles without their kind."""
    kinds = F.element_at(F.array(*map(F.lit, ("（PDF）", "(Word)", "（xls)", "（other）"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    ends = F.element_at(F.array(*map(F.lit, (".docx", ".x_y", "", ".tar.gz"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = t(spark, d, "customer").select("c_custkey", F.concat("c_custkey", F.lit("_"), "c_name", F.lit(" "), "c_mktsegment", ends).alias("name"), F.concat("c_name", F.lit(" "), kinds).alias("title"))
    return rows.select("c_custkey", X.stem(F.col("name")).alias("stem"), X.clean_title(F.col("title")).alias("title"))


def evidence_parse(spark, d):
    """Gold evidence made of order lines: cells, values and statements."""
    text = F.concat(F.lit("单元格： C"), "l_linenumber", F.lit("；原始值："), "l_suppkey", F.lit("；利润="), "l_partkey", F.lit(".5(D"), "l_linenumber", F.lit(")；"), "l_returnflag", F.lit("一二三四五六七"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("e"))
    e = F.col("e")
    return rows.select("l_orderkey", "l_linenumber", F.array_join(X.evidence_cells(e), ",").alias("cells"), X.evidence_numbers(e).alias("numbers"), F.array_join(X.statements(e), "|").alias("statements"))


def option_numbers(spark, d):
    """The first number of option texts made of orders."""
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about "), F.format_number("o_totalprice", 2), F.lit(" or 7"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("x-"), "o_custkey", F.lit("%")))
    return t(spark, d, "orders").select("o_orderkey", answer.option_number(F.coalesce(text, F.lit("none"))).alias("value"))


QUERIES = {f.__name__: f for f in (fallback_option, strategy_sweep, strategy_accuracy, statement_hits, statement_hits_cosine, statement_hits_vectors, cited_blocks, document_prompts, retrieved_evidence, extraction_audit, extraction_totals, extraction_misses, label_match, label_issues, sheet_locate, unlocated_titles, outside_questions, outside_counts, type_repair, demo_sample, question_parse, title_stems, evidence_parse, option_numbers)}

_OPTIONS = f"""{_BM25}, o AS (SELECT * FROM (SELECT item_id AS q, 'A' AS letter, text AS option FROM benchmark UNION ALL SELECT item_id - 1, 'B', text FROM benchmark) WHERE q IN (SELECT query_id FROM bm)),
hit AS (SELECT query_id AS q, block_id, rank, {_N.format('text')} AS t FROM bm JOIN documents ON doc_id = block_id WHERE rank <= 20)"""
_FUSED = f"""{_DENSE}, fj AS (SELECT query_id AS q, block_id, bm.rank AS r1, dn.rank AS r2, round(coalesce(1 / (bm.rank + 60), 0) + coalesce(1 / (dn.rank + 60), 0), 9) AS score FROM bm FULL JOIN dn USING (query_id, block_id)),
fu AS (SELECT q, block_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) AS INT) AS rank FROM fj WHERE q IN (SELECT item_id FROM benchmark)),
fh AS (SELECT q, block_id, rank, {_N.format('text')} AS t FROM fu JOIN documents ON doc_id = block_id WHERE rank <= 20)"""
_SHARE = "CASE WHEN length(a) < 4 THEN CAST(length(a) > 0 AND contains(t, a) AS DOUBLE) ELSE len(list_filter(list_transform(range(1, length(a) - 2), lambda i: a[i : i + 3]), lambda x: contains(t, x))) / (length(a) - 3) END"
_NAMES = "names AS (SELECT c_custkey AS name_id, c_name AS name, c_mktsegment AS ext FROM customer)"
_LABELS = f"""{_NAMES}, l AS (SELECT s_suppkey AS label_id, CASE WHEN s_suppkey % 7 = 0 THEN 'none ' || s_suppkey WHEN s_suppkey % 3 = 0 THEN right(s_name, 9) || 'zz' ELSE right(s_name, 9)[6:8] END AS label FROM supplier),
m1 AS (SELECT label_id, name_id, 1 AS stage FROM l JOIN names ON contains(name, label)
       QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY ext <> 'BUILDING', NOT suffix(name, label), length(name), name_id) = 1),
ga AS (SELECT label_id, i AS pos, label[i : i + 8] AS g FROM l ANTI JOIN m1 USING (label_id), unnest(range(1, length(label) - 7)) t(i)),
gb AS (SELECT name_id, i AS other, name[i : i + 8] AS g FROM names, unnest(range(1, length(name) - 7)) t(i)),
gm AS (SELECT label_id, name_id, pos, pos - other AS d FROM ga JOIN gb USING (g)),
gr AS (SELECT *, pos - row_number() OVER (PARTITION BY label_id, name_id, d ORDER BY pos) AS run FROM gm),
gc AS (SELECT label_id, name_id, count(*) AS n FROM gr GROUP BY label_id, name_id, d, run),
m AS (FROM m1 UNION ALL SELECT label_id, name_id, 2 FROM gc QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY n DESC, name_id) = 1)"""
_AUDIT = f"""{_BM25}, qs AS (SELECT query_id AS q, block_id AS doc_id, source AS source_type, {_N.format('b.text')} AS a, {_N.format('d.text')} AS t FROM bm JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = block_id WHERE rank = 1),
au0 AS (SELECT q, doc_id, source_type, t, round({_SHARE}, 9) AS coverage FROM qs), au AS (SELECT q, doc_id, source_type, coverage, CASE WHEN t = '' THEN 'empty' WHEN coverage < 0.7 THEN 'miss' ELSE 'ok' END AS note FROM au0)"""
_FORMS = ", ".join("'" + f + "'" for f in FORMS)
_OUTSIDE = f"""b AS (SELECT item_id + 1 AS title_id, text AS title FROM benchmark), {_SHARED.format(table='pages', text='html')},
tp AS (SELECT n_nationkey + 1 AS k, '0 ' || n_nationkey AS topic, 'What of ' || n_name || '?' AS question FROM nation),
topics AS (SELECT DISTINCT k FROM tp JOIN customer ON contains(c_name, replace(topic, ' ', ''))),
qs AS (SELECT format('S5-D{{:02d}}', title_id) AS id, CASE WHEN title_id NOT IN (FROM bad) THEN replace([{_FORMS}][(title_id - 1) % {len(FORMS)} + 1], '{{}}', title) END AS question, 'title' AS kind, title AS topic, title_id NOT IN (FROM bad) AS kept FROM b
       UNION ALL SELECT format('S5-T{{:02d}}', k), CASE WHEN k NOT IN (FROM topics) THEN question END, 'natural', topic, k NOT IN (FROM topics) FROM tp)"""

ORACLE_SQL = {
    "fallback_option": f"""WITH {_OPTIONS}, {_FUSED}, p AS (SELECT q, letter, rank, block_id, t, {_N.format('option')} AS a FROM o JOIN fh USING (q)),
        s AS (SELECT q, letter, block_id, round({_SHARE}, 9) AS coverage, rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY coverage DESC, letter, rank) = 1)
        SELECT q, letter, block_id, coverage, letter IS NULL AS refused FROM (SELECT DISTINCT q FROM o) LEFT JOIN s USING (q)""",
    "strategy_sweep": f"""WITH {_OPTIONS}, o1 AS (SELECT q, letter, option, list_filter(string_split_regex(option, '[;；。]'), lambda x: {_N.format('x')} <> '') AS cs FROM o),
        pt AS (SELECT q, letter, false AS split, 0 AS k, {_N.format('option')} AS a FROM o1 UNION ALL SELECT q, letter, true, i, {_N.format('x[i]')} FROM (SELECT q, letter, CASE WHEN len(cs) = 0 THEN [option] ELSE cs END AS x FROM o1), unnest(range(1, len(x) + 1)) u(i)),
        c AS (SELECT q, letter, split, k, rank, {_SHARE} AS coverage FROM pt JOIN hit USING (q)),
        v(name, most, fused, split) AS (VALUES ('V0', 10, false, false), ('V1', 20, false, false), ('V2', 20, true, false), ('V3', 20, false, true), ('V4', 20, true, true)),
        b AS (SELECT name, fused, q, letter, k, max(coverage) AS m FROM c JOIN v USING (split) WHERE rank <= most GROUP BY ALL), tops AS (SELECT query_id AS i, score AS top FROM bm WHERE rank = 1),
        s AS (SELECT name, fused, q, letter, avg(m) AS cov, any_value(coalesce(top, 0)) AS top FROM b LEFT JOIN tops ON i = CASE letter WHEN 'A' THEN q ELSE q + 1 END GROUP BY ALL),
        r AS (SELECT name, q, letter, round(CASE WHEN fused THEN 0.75 * cov + 0.25 * top / greatest(top, 1) ELSE cov END, 9) AS score FROM s)
        SELECT *, row_number() OVER (PARTITION BY name, q ORDER BY score DESC, letter) = 1 AS chosen FROM r""",
    "statement_hits": f"WITH {_COVERAGE} SELECT q, bool_and(m >= 0.7) AS hit FROM (SELECT q, letter, clause_no, max(coverage) AS m FROM cov GROUP BY ALL) GROUP BY q",
    "statement_hits_cosine": f"""WITH {_COVERAGE}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        n AS (SELECT top.q, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS cosine FROM top JOIN e a ON a.vec_id = q JOIN e b ON b.vec_id = doc_id)
        SELECT q, bool_and(f) AS hit FROM (SELECT q, letter, clause_no, bool_or(coverage >= 0.9 OR coalesce(cosine >= 0.1, false)) AS f FROM cov LEFT JOIN n USING (q) GROUP BY ALL) GROUP BY q""",
    "document_prompts": f"""WITH {_BM25}, ul AS (SELECT query_id AS q, string_split(text, chr(10)) AS ls FROM bm JOIN documents ON doc_id = block_id WHERE rank = 1),
        u AS (SELECT q, i - 1 AS k, {_N.format('ls[i]')}[1:600] AS x, row_number() OVER (PARTITION BY q ORDER BY i) AS no FROM ul, unnest(range(1, len(ls) + 1)) t(i) WHERE trim(ls[i], ' ') <> ''),
        e AS (SELECT q, string_agg('[' || no || '] (para' || k || ') ' || x, chr(10) ORDER BY no) AS lines FROM u WHERE no <= 8 GROUP BY q)
        SELECT item_id AS q, concat_ws(chr(10), lines, text) AS prompt FROM benchmark LEFT JOIN e ON q = item_id""",
    "retrieved_evidence": f"WITH {_BM25}, {_FUSED} SELECT q, rank AS no, d.text[1:600] AS text, source, 'whole' AS location FROM fu JOIN documents d ON d.doc_id = block_id WHERE rank <= 6",
    "extraction_audit": f"WITH {_AUDIT} SELECT * FROM au",
    "extraction_totals": f"WITH {_AUDIT} SELECT source_type, count(*) AS n, count(*) FILTER (note = 'ok') AS ok, round(avg(coverage), 6) AS mean FROM au GROUP BY 1",
    "extraction_misses": f"WITH {_AUDIT} SELECT doc_id, count(*) AS misses FROM au WHERE note = 'miss' GROUP BY 1 ORDER BY misses DESC, doc_id LIMIT 10",
    "label_match": f"WITH {_LABELS} SELECT * FROM m",
    "label_issues": f"WITH {_LABELS} SELECT label_id, CASE WHEN name_id IS NULL THEN 'unmatched' ELSE 'repaired' END AS issue FROM l LEFT JOIN m USING (label_id) LEFT JOIN names USING (name_id) WHERE name_id IS NULL OR NOT contains(name, label)",
    "sheet_locate": f"""WITH {_NAMES} SELECT s_suppkey AS title_id, name_id, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY length(name), CAST(name_id AS VARCHAR)) AS INT) AS cand_no
        FROM supplier JOIN names ON contains(name, right(s_name, 4)) WHERE ext IN ('BUILDING', 'MACHINERY')""",
    "unlocated_titles": """WITH a AS (SELECT s_suppkey AS q, CASE WHEN s_suppkey % 5 > 0 THEN right(s_name, 4) || CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE '' END END AS title FROM supplier)
        SELECT q, title FROM a WHERE title IS NOT NULL AND NOT EXISTS (FROM customer WHERE contains(c_name, title))""",
    "outside_questions": f"WITH {_OUTSIDE} SELECT * FROM qs",
    "outside_counts": f"WITH {_OUTSIDE} SELECT kind, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS rejected FROM qs GROUP BY 1",
    "type_repair": """WITH c AS (SELECT conv_id AS grp, turn, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        y AS (SELECT grp, turn, n, CASE WHEN turn > 4 THEN CASE WHEN grp % 2 = 0 THEN 'late' ELSE 'last' END WHEN grp % 3 = 0 AND turn = 0 AND last <= 4 THEN 'solo' ELSE 'early' END AS qa_type, last > 4 AS test FROM c),
        m AS (SELECT arg_min(grp, (n, grp)) AS g, NOT test AS test FROM y WHERE qa_type <> 'early' GROUP BY qa_type, y.test)
        SELECT grp, turn, qa_type, CASE WHEN coalesce(m.test, y.test) THEN 'test' ELSE 'dev' END AS split FROM y LEFT JOIN m ON g = grp""",
    "question_parse": """WITH r AS (SELECT conv_id, turn, role, text, '《' || text || '》' AS head, '“' || role || '”或“' || text || '”从“x' || turn || '”到“y”' AS tail FROM conversations)
        SELECT conv_id, turn, nullif(regexp_extract(head, '《([^》]+)》', 1), '') AS title, role || '（a）b' AS sheet, array_to_string(regexp_extract_all(tail, '[“"]([^”"]{2,30})[”"]', 1), '|') AS terms,
        CASE WHEN regexp_matches(tail, '“[^”"]+”从') THEN regexp_extract(tail, '“([^”"]+)”从', 1) END AS term, CASE WHEN regexp_matches(tail, '“[^”"]+”从') THEN regexp_extract(tail, '从“([^”"]+)”', 1) END AS col1 FROM r""",
    "title_stems": """SELECT c_custkey, replace(c_name || c_mktsegment || ['', '.x_y', '', '.tar'][c_custkey % 4 + 1], ' ', '') AS stem,
        replace(c_name || ['', '', '', '（other）'][c_custkey % 4 + 1], ' ', '') AS title FROM customer""",
    "evidence_parse": """SELECT l_orderkey, l_linenumber, 'C' || l_linenumber || ',D' || l_linenumber AS cells, CASE WHEN l_suppkey = l_partkey + 0.5 THEN [l_suppkey::DOUBLE] ELSE [l_suppkey::DOUBLE, l_partkey + 0.5] END AS numbers,
        array_to_string(list_filter(['单元格：C' || l_linenumber, '原始值：' || l_suppkey, '利润=' || l_partkey || '.5(D' || l_linenumber || ')', l_returnflag || '一二三四五六七'], lambda x: length(x) >= 8), '|') AS statements FROM lineitem""",
    "option_numbers": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -o_custkey::DOUBLE END AS value FROM orders",
    "demo_sample": "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) = 1",
}
ORACLE_SQL["strategy_accuracy"] = f"""WITH sw AS ({ORACLE_SQL["strategy_sweep"]}), b AS (SELECT item_id AS q, CASE WHEN item_id % 3 = 0 THEN 'single' ELSE 'other' END AS kind, CASE WHEN item_id % 4 = 1 THEN 'B' ELSE 'A' END AS gold FROM benchmark),
    z AS (FROM b UNION ALL SELECT q + 1000000, kind, gold FROM b WHERE q % 5 = 0),
    r AS (SELECT names.name, z.*, letter FROM z CROSS JOIN (SELECT unnest(['V0', 'V1', 'V2', 'V3', 'V4']) AS name) names LEFT JOIN (SELECT * FROM sw WHERE chosen) s ON s.name = names.name AND s.q = z.q),
    e AS (SELECT name, 'all' AS value, letter, gold FROM r UNION ALL SELECT name, kind, letter, gold FROM r)
    SELECT name, value, count(*) AS n, count(*) FILTER (letter IS NULL) AS refused, count(*) FILTER (letter = gold) AS correct, round_even(count(*) FILTER (letter = gold) * 100 / count(*), 1) AS percent FROM e GROUP BY ALL"""
ORACLE_SQL["cited_blocks"] = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    u AS (SELECT doc_id, i - 1 AS n, trim(ls[i], ' ') AS x FROM l, unnest(range(1, len(ls) + 1)) t(i) WHERE trim(ls[i], ' ') <> '')
    SELECT doc_id, 'para' || (n // 3) AS location, CAST(max(n) AS INT) AS ord, arg_max(x, n) AS text FROM u GROUP BY doc_id, n // 3"""
ORACLE_SQL["statement_hits_vectors"] = f"""WITH {_COVERAGE}, e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    n AS (SELECT cov.*, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS cosine FROM cov JOIN top USING (q)
          LEFT JOIN e a ON a.vec_id = (q * 31 + clause_no) % 100 LEFT JOIN e b ON b.vec_id = (top.doc_id + block_no * 7) % 100)
    SELECT q, bool_and(f) AS hit FROM (SELECT q, letter, clause_no, bool_or(coverage >= 0.9 OR coalesce(cosine >= 0.3, false)) AS f FROM n GROUP BY ALL) GROUP BY q"""
