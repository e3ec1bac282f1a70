"""Queries on answering, splits and audits over the driver's tables, and their SQL."""

from pyspark.sql import functions as F

from ..operators import answer, corpus, evaluate, match, retrieve, sheets
from ..sources.shared import stored
from .queries import _BM25, _CELLS, _FOLD, _N, _SPLIT, _bm25, _cells, _lines, _opening, _units, t


def _located(spark, d, ranked=None):
    """The best document of each passage; ranked: a list that holds it, where it is there already."""
    top = _bm25(spark, d, 1) if ranked is None else ranked.where(F.col("rank") == 1)
    return top.select(F.col("query_id").alias("q"), F.col("block_id").alias("doc_id"))


def _options(spark, d, top=None):
    """Each benchmark passage asks about its best document (top); its options are itself and the passage after it."""
    top = _located(spark, d) if top is None else top
    items = t(spark, d, "benchmark")
    own = items.select(F.col("item_id").alias("q"), F.lit("A").alias("letter"), F.col("text").alias("option"))
    after = items.select((F.col("item_id") - 1).alias("q"), F.lit("B").alias("letter"), F.col("text").alias("option"))
    return own.union(after).join(top, "q")


def _coverage(spark, d, top=None):
    """Stored, as later steps read it several times."""
    top = _located(spark, d) if top is None else top
    return stored(answer.clause_coverage(_options(spark, d, top), _units(spark, d, top).select("doc_id", F.col("unit_no").alias("block_no"), "text")))


def _sentences(text):
    """Sentences that end as in Chinese text, as clauses do."""
    return F.replace(text, F.lit(". "), F.lit("。"))


def _scoped(spark, d):
    """A question on each benchmark passage that names its best document by the first words of it, and four options, the passages of its
    group of four: q, doc_id (what the named title locates), letter, option. File names are a number, first words and the source."""
    docs, items = t(spark, d, "documents"), t(spark, d, "benchmark")
    names = docs.select("doc_id", F.concat("doc_id", F.lit("_"), F.substring("text", 1, 40), F.lit(" "), "source", F.lit(".pdf")).alias("name"))
    said = F.concat(F.lit("What does 《"), F.substring("text", 1, 30), F.lit("（PDF）》 say?"))
    questions = stored(_located(spark, d).join(docs, "doc_id").select("q", said.alias("question")))
    scope = answer.scope(questions, names)
    group = F.floor(F.col("item_id") / 4).alias("of")
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int")).alias("letter")
    options = items.select(F.col("item_id").alias("q"), group).join(items.select(group, letter, _sentences(F.col("text")).alias("option")), "of").drop("of")
    return stored(options.join(scope, "q"))


def option_scoring(spark, d):
    """Options by the blocks of the document that their question names."""
    options = _scoped(spark, d)
    docs = t(spark, d, "documents").join(options.select("doc_id").distinct(), "doc_id", "left_semi")
    folded = stored(corpus.fold(docs.select("doc_id", _lines(_sentences(F.col("text"))).alias("units")), "units", _opening).select("doc_id", "block_no", "text"))
    pieces = corpus.split_long(folded)  # stored between, as either step keeps a Python worker a core
    blocks = pieces.select("doc_id", F.concat_ws("-", "block_no", "piece_no").alias("block_no"), F.col("piece").alias("text"))
    return answer.option_scores(answer.clause_coverage(options, blocks))


def option_evidence(spark, d):
    found = _coverage(spark, d)
    return answer.option_evidence(found, answer.option_scores(found))


def split_long(spark, d):
    return corpus.split_long(t(spark, d, "documents").select("doc_id", F.lit(0).alias("block_no"), F.replace("text", F.lit(". "), F.lit("。")).alias("text")))


def bm25_share(spark, d):
    return retrieve.max_normalised(_bm25(spark, d, 20)).select("query_id", "block_id", F.round("share", 5).alias("share"))


def vector_alignment(spark, d):
    return retrieve.misaligned(t(spark, d, "documents").select(F.col("doc_id").alias("block_id")), t(spark, d, "embeddings").select(F.col("vec_id").alias("block_id")))


def out_of_corpus(spark, d):
    titles = t(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"))
    return match.out_of_corpus(titles, t(spark, d, "documents").select(F.col("text").alias("name")), 24).select("title_id", "title")


def fact_row_diff(spark, d):
    asked = t(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.col("n_nationkey").cast("string").alias("doc_id"), F.lit("1-URGENT").alias("term"), F.lit("1993").alias("col1"), F.lit("1995").alias("col2"))
    return sheets.row_difference(sheets.facts(_cells(spark, d)), asked)


def _priced(spark, d):
    x = F.col("l_extendedprice")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("value"), *[(x + F.col("l_quantity") * k).alias(n) for n, k in (("A", 40), ("B", -15), ("C", 25))])


def numeric_option(spark, d):
    choices = {k: F.col(k) for k in "ABC"}
    rows = _priced(spark, d)
    return rows.select("l_orderkey", "l_linenumber", answer.nearest_option(F.col("value"), choices).alias("nearest"), F.array_join(answer.within(F.col("value"), choices), ",").alias("near"))


def _graded(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return evaluate.grade(rows.withColumn("pred", (F.col("n_chars") > 600).cast("int")).withColumnRenamed("quality", "gold"))


def error_rows(spark, d):
    return evaluate.error_rows(_graded(spark, d)).select("doc_id", "pred", "gold", "source")


def _split(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("word", "pdf", "excel"))), (F.col("conv_id") % 3 + 1).cast("int"))
    return t(spark, d, "conversations").select(F.col("conv_id").alias("grp"), "turn", "role", kind.alias("source_type"), F.when(F.col("turn") < 3, "dev").otherwise("test").alias("split"))


def split_leaks(spark, d):
    return evaluate.split_leaks(_split(spark, d))


def split_summary(spark, d):
    return evaluate.split_summary(_split(spark, d), ["role"])


def split_documents(spark, d):
    return evaluate.split_documents(_split(spark, d))


def split_choice(spark, d):
    return evaluate.choose(_split(spark, d), "test", text_only=True).select("grp", "turn", "source_type")


QUERIES = {f.__name__: f for f in (option_scoring, option_evidence, split_long, bm25_share, vector_alignment, out_of_corpus, fact_row_diff, numeric_option, error_rows, split_leaks, split_summary, split_documents, split_choice)}

_CLAUSES = f"""c0 AS (SELECT q, doc_id, letter, option, list_filter(string_split_regex(option, '[;；。]'), lambda x: {_N.format('x')} <> '') AS cs FROM o JOIN top USING (q)),
c1 AS (SELECT q, doc_id, letter, CASE WHEN len(cs) = 0 THEN [option] ELSE cs END AS cs FROM c0),
c AS (SELECT q, doc_id, letter, i - 1 AS clause_no, {_N.format('cs[i]')} AS a FROM c1, unnest(range(1, len(cs) + 1)) t(i))"""
_SCORES = """g AS (SELECT q, letter, clause_no, block_no, a, t, list_transform(range(1, length(a) - 2), lambda i: a[i : i + 3]) AS g FROM c JOIN {blocks} USING (doc_id)),
cov AS (SELECT q, letter, clause_no, block_no, CASE WHEN length(a) < 4 THEN CAST(length(a) > 0 AND contains(t, a) AS DOUBLE) ELSE len(list_filter(g, lambda x: contains(t, x))) / len(g) END AS coverage FROM g),
sc2 AS (SELECT q, letter, round(avg(m), 9) AS score FROM (SELECT q, letter, clause_no, max(coverage) AS m FROM cov GROUP BY ALL) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, letter) = 1 AS chosen FROM sc2)"""
_COVERAGE = f"""{_BM25}, top AS (SELECT query_id AS q, block_id AS doc_id FROM bm WHERE rank = 1),
o AS (SELECT item_id AS q, 'A' AS letter, text AS option FROM benchmark UNION ALL SELECT item_id - 1, 'B', text FROM benchmark),
{_CLAUSES},
ul AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IN (SELECT doc_id FROM top)),
u AS (SELECT doc_id, i - 1 AS block_no, {_N.format("ls[i]")} AS t FROM ul, unnest(range(1, len(ls) + 1)) t(i) WHERE trim(ls[i], ' ') <> ''),
{_SCORES.format(blocks='u')}"""
_SCOPED = f"""{_BM25}, said AS (SELECT query_id AS q, regexp_extract('What does 《' || text[1:30] || '（PDF）》 say?', '《([^》]+)》', 1) AS said FROM bm JOIN documents ON doc_id = block_id WHERE rank = 1),
titles AS (SELECT q, regexp_replace({_N.format('said')}, '(?i)[（(](pdf|word|excel|docx|doc|xlsx|xls)[)）]', '', 'g') AS title FROM said),
stems AS (SELECT doc_id, {_N.format("text[1:40] || ' ' || source")} AS stem FROM documents),
top AS (SELECT q, doc_id FROM titles JOIN stems ON title <> '' AND contains(stem, title) QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(stem), CAST(doc_id AS VARCHAR)) = 1),
o AS (SELECT x.item_id AS q, ['A', 'B', 'C', 'D'][y.item_id % 4 + 1] AS letter, replace(y.text, '. ', '。') AS option FROM benchmark x JOIN benchmark y ON x.item_id // 4 = y.item_id // 4),
{_CLAUSES},
typed AS (SELECT doc_id, replace(text, '. ', '。') AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM top)), {_FOLD.format(docs='typed', text='text')}, {_SPLIT},
blocks AS (SELECT doc_id, block_no || '-' || piece_no AS block_no, {_N.format('piece')} AS t FROM pieces),
{_SCORES.format(blocks='blocks')}"""
_NEAR = "abs(value - {0}) / greatest(1, abs(value))"

#: bad: ids of titles in b(title_id, title) that share 24 characters in a row with, or are held by, a text of a table.
_SHARED = """ck AS (SELECT substring({text}, k * 1000 + 1, 1023) AS c FROM {table}, unnest(range(0, length({text}) // 1000 + 1)) t(k)),
        held AS (SELECT DISTINCT c[i : i + 23] AS gram FROM ck, unnest(range(1, length(c) - 22)) t(i)),
        own AS (SELECT DISTINCT title_id, title[i : i + 23] AS gram FROM b, unnest(range(1, length(title) - 22)) t(i)),
        bad AS (SELECT DISTINCT title_id FROM own JOIN held USING (gram) UNION SELECT title_id FROM b JOIN {table} ON length(title) BETWEEN 1 AND 23 AND contains({text}, title))"""

ORACLE_SQL = {
    "option_scoring": f"WITH RECURSIVE {_SCOPED} SELECT * FROM best",
    "option_evidence": f"""WITH {_COVERAGE}, e AS (SELECT q, clause_no, block_no, row_number() OVER (PARTITION BY q, clause_no ORDER BY coverage DESC, block_no) AS rank FROM cov JOIN best USING (q, letter) WHERE chosen QUALIFY rank <= 2),
        m AS (SELECT q, block_no, min(clause_no * 10 + rank) AS place FROM e GROUP BY ALL)
        SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY place) AS INT) AS ord, CAST(block_no AS INT) AS block_no FROM m QUALIFY ord <= 4""",
    "bm25_share": f"WITH {_BM25} SELECT query_id, block_id, round(score / max(score) OVER (PARTITION BY query_id), 5) AS share FROM bm WHERE rank <= 20",
    "vector_alignment": """SELECT doc_id AS block_id, 'vector' AS lacks FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT vec_id, 'block' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    "out_of_corpus": f"WITH b AS (SELECT item_id AS title_id, text AS title FROM benchmark), {_SHARED.format(table='documents', text='text')} SELECT title_id, title FROM b WHERE title_id NOT IN (FROM bad)",
    "split_long": f"WITH RECURSIVE b AS (SELECT doc_id, 0 AS block_no, replace(text, '. ', '。') AS text FROM documents), {_SPLIT} SELECT doc_id, block_no, piece_no, piece FROM pieces",
    "split_documents": "SELECT DISTINCT CASE WHEN turn < 3 THEN 'dev' ELSE 'test' END AS split, conv_id AS grp FROM conversations",
    "split_choice": "SELECT conv_id AS grp, turn, CASE WHEN conv_id % 3 = 0 THEN 'word' ELSE 'pdf' END AS source_type FROM conversations WHERE turn >= 3 AND conv_id % 3 < 2",
    "fact_row_diff": f"""WITH {_CELLS}, f AS (SELECT doc_id, min(r) AS r FROM b WHERE p = '1-URGENT' GROUP BY 1)
        SELECT CAST(doc_id AS INT) AS q, CAST(max(v) FILTER (c = 4) - max(v) FILTER (c = 2) AS DOUBLE) AS difference FROM b JOIN f USING (doc_id, r) GROUP BY doc_id""",
    "numeric_option": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS value, l_extendedprice + l_quantity * 40 AS a, l_extendedprice + l_quantity * -15 AS b, l_extendedprice + l_quantity * 25 AS c FROM lineitem),
        n AS (SELECT *, {_NEAR.format('a')} AS da, {_NEAR.format('b')} AS db, {_NEAR.format('c')} AS dc FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN least(da, db, dc) < 0.02 THEN CASE least(da, db, dc) WHEN da THEN 'A' WHEN db THEN 'B' ELSE 'C' END END AS nearest,
        concat_ws(',', CASE WHEN da < 0.02 THEN 'A' END, CASE WHEN db < 0.02 THEN 'B' END, CASE WHEN dc < 0.02 THEN 'C' END) AS near FROM n""",
    "error_rows": "SELECT doc_id, CAST(n_chars > 600 AS INT) AS pred, quality AS gold, source FROM documents JOIN labels USING (doc_id) WHERE CAST(n_chars > 600 AS INT) IS DISTINCT FROM quality",
    "split_leaks": "SELECT conv_id AS grp, 2::BIGINT AS splits FROM conversations GROUP BY 1 HAVING count(DISTINCT turn < 3) > 1",
    "split_summary": """WITH s AS (SELECT conv_id, role, CASE WHEN turn < 3 THEN 'dev' ELSE 'test' END AS split FROM conversations)
        SELECT split, 'all' AS kind, '' AS value, count(*) AS n, count(DISTINCT conv_id) AS groups FROM s GROUP BY 1 UNION ALL SELECT split, 'role', role, count(*), count(DISTINCT conv_id) FROM s GROUP BY split, role""",
}
