"""Queries over the driver's tables and their SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, coverage, evaluate, match, retrieve, sheets
from ..sources.shared import stored


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _verified(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("actual"), "n_chars")
    path = F.concat(F.lit("set/"), F.col("doc_id").cast("string"))
    mapping = docs.select("doc_id", F.concat(F.lit("zip/data/"), path).alias("zip_path"), F.concat(F.lit("short/"), "doc_id").alias("local_path"), _kind().alias("type"))
    manifest = docs.where("doc_id % 7 <> 0").select(path.alias("path"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 11 == 0, "changed").otherwise(F.col("actual")).alias("sha256"))
    return corpus.verify(mapping, manifest, docs.where("doc_id % 13 <> 0").select(F.concat(F.lit("short/"), "doc_id").alias("local_path"), "actual"))


def _kind():
    """A file type for each document."""
    return F.element_at(F.array(*map(F.lit, ("doc", "docx", "pdf", "xls"))), (F.col("doc_id") % 4 + 1).cast("int"))


def corpus_verify(spark, d):
    return _verified(spark, d).select("doc_id", "path", "manifest_size", "sha256", "status")


def corpus_problems(spark, d):
    return corpus.problems(_verified(spark, d))


def corpus_counts(spark, d):
    return corpus.verify_counts(_verified(spark, d))


def exact_copies(spark, d):
    return corpus.exact_copies(t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("s")), "doc_id", "s")


def _units(spark, d, among=None):
    """Lines of documents that are not blank; among(doc_id): of those documents alone, before their texts are cut."""
    docs = t(spark, d, "documents")
    if among is not None:
        docs = docs.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("unit_no", "text"))
    return lines.withColumn("text", F.regexp_replace("text", "^ +| +$", "")).where("text <> ''")


def _lines(text):
    """The lines of a text as an array of units."""
    each = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("unit_no"), F.concat(F.lit("para"), i).alias("location"), F.trim(x).alias("text")))
    return F.filter(each, lambda u: u.text != "")


def _opening(u):
    """A line that begins a block in these texts, which have no clause numbers."""
    return u.rlike("^(The|In|A) ")


def units_to_blocks(spark, d):
    return corpus.fold(t(spark, d, "documents").select("doc_id", _lines(F.col("text")).alias("units")), "units", _opening)


def _block_docs(spark, d):
    """Documents with a type, and sentences that end as in Chinese text."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit("。"))
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("name"), "doc_id").alias("orig_name"), _kind().alias("type"), _lines(text).alias("units"))


def text_blocks(spark, d):
    return corpus.text_blocks(_block_docs(spark, d), _opening)


def block_counts(spark, d):
    docs = _block_docs(spark, d)
    return corpus.block_counts(docs, corpus.text_blocks(docs, _opening), docs.where(F.size("units") == 0))


def heading_units(spark, d):
    """Conversation turns with a clause mark, or none, before them."""
    marks = ("第三条 ", "（二）", "(二)", "12.5% ", "附 录", "一、", "第 十2 章", "3 ")
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(marks))) + 1).cast("int"))
    return t(spark, d, "conversations").select("conv_id", "turn", X.heading(F.concat(mark, "text")).alias("boundary"))


def secret_scan(spark, d):
    rows = corpus.secret_lines(t(spark, d, "documents"))
    return rows.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.min("found").alias("first_found"))


def secret_verdict(spark, d):
    """Secrets outside the documents of the first source, which are allowed to hold them."""
    docs = t(spark, d, "documents")
    first = docs.groupBy().agg(F.min("source").alias("source"))  # one row
    return corpus.secret_verdict(corpus.secret_lines(docs, allowed=docs.join(F.broadcast(first), "source")))


def _bm25(spark, d, k):
    """The best k documents of each passage, stored, as later steps read them several times."""
    blocks = t(spark, d, "documents").select(F.col("doc_id").alias("block_id"), "text")
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return stored(retrieve.bm25(blocks, asked, k=k))


def bm25_topk(spark, d):
    return _bm25(spark, d, 20)


def _dense(spark, d):
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), retrieve.unit(F.col("embedding")).alias("vector"))
    return retrieve.dense(rows, rows.where("block_id % 20 = 0").withColumnRenamed("block_id", "query_id"), k=50)


def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "block_id", "rank")


def han_terms(spark, d):
    """Terms of conversation turns some of whose letters are replaced by ideographs."""
    text = F.translate("text", "aeiou", "甲乙丙丁戊")
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(retrieve.tokens(text), " ").alias("terms"))


def _hybrid(spark, d, k=6, ranked=None):
    """The best k of the fused first 50 of either list; ranked: that of the words, where it is there already."""
    return retrieve.fuse(_bm25(spark, d, 50) if ranked is None else ranked, _dense(spark, d), k=k)


def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("query_id", "block_id", "score")


def ngram_coverage(spark, d):
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("a"))
    texts = bm25_topk(spark, d).select("query_id", "block_id").join(t(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("text").alias("t")), "block_id")
    return coverage.parts_coverage(asked, texts, "query_id").select("query_id", "block_id", F.round("coverage", 9).alias("coverage"))


def title_locate(spark, d):
    names = t(spark, d, "customer").select(F.col("c_custkey").alias("name_id"), F.col("c_name").alias("name"))
    titles = names.select(F.col("name_id").alias("title_id"), F.substring("name", -6, 5).alias("title"))
    return match.locate(titles, names)


def lcs_match(spark, d):
    pages = t(spark, d, "pages")
    labels = pages.select(F.col("page_id").alias("a_id"), F.expr("substring(url, 12)").alias("s"))
    return match.common_substring(labels, pages.select(F.col("page_id").alias("b_id"), F.col("url").alias("s")), 17)


def group_split(spark, d):
    sizes = t(spark, d, "conversations").groupBy((F.col("conv_id") % 3).alias("stratum"), F.col("conv_id").alias("grp")).agg(F.count("*").alias("n"))
    return evaluate.group_split(sizes)


def grade_rollup(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    rows = rows.withColumn("pred", (F.col("n_chars") > 600).cast("int")).withColumnRenamed("quality", "gold")
    return evaluate.accuracy(evaluate.grade(rows), ["lang", "source"])


def number_fidelity(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("[1] total "), F.col("l_partkey"), F.lit(" and 10.50")).alias("answer"), F.concat(F.col("l_suppkey"), F.lit(" of "), F.col("l_partkey") * 2, F.lit(" at 10.5")).alias("evidence"))
    gone = evaluate.missing_numbers(F.col("answer"), F.col("evidence"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(gone, ",").alias("missing"), F.when(F.size(gone) == 0, "ok").otherwise("warn").alias("status"))


def citation_check(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("text"), F.lit(" ["), F.col("turn"), F.lit("] ["), F.col("conv_id") % 5, F.lit("]")).alias("answer"))
    good, bad = evaluate.citations(F.col("answer"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(good), ",").alias("valid"), F.array_join(F.array_sort(bad), ",").alias("dangling"))


def uncited_claims(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\. ", ". [1] ").alias("answer"), "role")
    rows = rows.withColumn("answer", F.when(F.col("turn") % 2 == 0, F.replace("answer", F.lit(". [1] "), F.lit("[1]. "))).otherwise(F.concat("answer", F.lit(" "), "role", F.lit("!"))))
    return rows.select("conv_id", "turn", F.array_join(evaluate.uncited(F.col("answer"), "Th the."), "|").alias("uncited"))


def refusal_rate(spark, d):
    answer = F.when(F.col("text").rlike("th[ae]"), " no evidence ").otherwise(F.col("text"))
    rows = t(spark, d, "conversations").select(F.col("role").alias("kind"), answer.alias("answer"), F.when(F.col("turn") % 5 == 4, "refused").otherwise("ok").alias("status"))
    return evaluate.refusal_rates(rows, "no evidence")


def _values(spark, d):
    """Rounded order values by nation, segment, priority and year (c from 1)."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = (F.col("c_nationkey").cast("string").alias("doc_id"), F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("prio"), (F.year("o_orderdate") - 1991).alias("c"))
    return rows.groupBy(*keys).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("v"))


def _cells(spark, d, mark="年累计"):
    """A sheet for each nation: years as header, a category row for each segment, a row for each priority."""
    rows = _values(spark, d)
    own = W.partitionBy("doc_id")
    rows = rows.withColumn("r", F.dense_rank().over(own.orderBy("seg", "prio")) + F.dense_rank().over(own.orderBy("seg")))
    parts = [
        rows.select("doc_id", "r", "c", F.col("v").cast("string").alias("raw")),
        rows.select("doc_id", "r", F.lit(0).alias("c"), F.col("prio").alias("raw")).distinct(),
        rows.groupBy("doc_id", "seg").agg((F.min("r") - 1).alias("r")).select("doc_id", "r", F.lit(0).alias("c"), F.col("seg").alias("raw")),
        rows.select("doc_id", F.lit(0).alias("r"), "c", F.concat(F.col("c") + 1991, F.lit(mark)).alias("raw")).distinct(),
    ]
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells.withColumn("sheet", F.lit("S"))


def cells_to_facts(spark, d):
    return sheets.facts(_cells(spark, d)).select("doc_id", "row", "col", "indicator", "indicator_path", "family_root", "column_label", "value")


def fact_lookup(spark, d):
    asked = t(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.col("n_nationkey").cast("string").alias("doc_id"), F.lit("1-URGENT").alias("term"))
    return sheets.lookup(sheets.facts(_cells(spark, d)), asked).groupBy("q").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


QUERIES = {f.__name__: f for f in (cells_to_facts, fact_lookup, corpus_verify, corpus_problems, corpus_counts, exact_copies, units_to_blocks, text_blocks, block_counts, heading_units, secret_scan, secret_verdict, bm25_topk, han_terms, dense_topk, hybrid_rrf, ngram_coverage, title_locate, lcs_match, group_split, grade_rollup, number_fidelity, citation_check, uncited_claims, refusal_rate)}

_TOK = "list_filter(string_split_regex(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""
tf AS (SELECT doc_id AS block_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
tfc AS (SELECT block_id, len, term, count(*) AS tf FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len({_TOK})) AS avgdl FROM documents),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM tfc, st GROUP BY term, n),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, block_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN tfc USING (term) JOIN idf USING (term) GROUP BY ALL),
bm AS (SELECT query_id, block_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS INT) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 50)"""
_DENSE = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
v AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
ds AS (SELECT a.vec_id AS query_id, b.vec_id AS block_id, round(list_dot_product(a.v, b.v), 9) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
dn AS (SELECT query_id, block_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, block_id) AS INT) AS rank FROM ds QUALIFY rank <= 50)"""
_N = r"regexp_replace({}, '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', '', 'g')"

_CELLS = """a AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, c_mktsegment AS seg, o_orderpriority AS prio, year(o_orderdate) - 1991 AS c, sum(CAST(floor(o_totalprice) AS BIGINT)) AS v
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        b AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY seg, prio) + dense_rank() OVER (PARTITION BY doc_id ORDER BY seg) AS r, replace(prio, ' ', '') AS p, replace(seg, ' ', '') AS s FROM a)"""

_VERIFIED = """v AS (SELECT doc_id, ['doc', 'docx', 'pdf', 'xls'][doc_id % 4 + 1] AS type,
        CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'not_in_manifest' WHEN doc_id % 11 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM documents)"""
_FOLD = """u0 AS (SELECT doc_id, l, i - 1 AS unit_no FROM (SELECT doc_id, string_split({text}, chr(10)) AS ls FROM {docs}), unnest(range(1, len(ls) + 1)) t(i), LATERAL (SELECT trim(ls[i], ' ') AS l)),
        u AS (SELECT doc_id, unit_no, l AS text, length(l) AS n, regexp_matches(l, '^(The|In|A) ') AS cut, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS k FROM u0 WHERE l <> ''),
        f AS (SELECT doc_id, unit_no, text, k, n AS size, 0 AS block_no FROM u WHERE k = 1
          UNION ALL SELECT u.doc_id, u.unit_no, u.text, u.k, CASE WHEN (u.cut AND f.size > 120) OR f.size + u.n > 420 THEN u.n ELSE f.size + u.n END, f.block_no + CAST((u.cut AND f.size > 120) OR f.size + u.n > 420 AS INT)
          FROM f JOIN u ON u.doc_id = f.doc_id AND u.k = f.k + 1),
        b AS (SELECT doc_id, block_no, string_agg(text, chr(10) ORDER BY unit_no) AS text, CAST(count(*) AS INT) AS n_units,
          CASE WHEN count(*) = 1 THEN 'para' || min(unit_no) ELSE 'para' || min(unit_no) || '-para' || max(unit_no) END AS location FROM f GROUP BY doc_id, block_no)"""
_TYPED = "typed AS (SELECT doc_id, replace(text, '. ', '。') AS text FROM documents WHERE doc_id % 4 < 3)"
#: Texts of b(doc_id, block_no, text) cut between sentences.
_SPLIT = """sn AS (SELECT doc_id, block_no, list_transform(list_concat(regexp_extract_all(text, '[^。;；]*[。;；]|[^。;；]+'), CASE WHEN right(text, 1) IN ('。', ';', '；') THEN [''] ELSE [] END), lambda x: length(x)) AS ns FROM b WHERE length(text) > 420),
        rs AS (SELECT doc_id, block_no, ns, 0 AS k, 0 AS a, 0 AS b, NULL::INT AS oa, NULL::INT AS ob FROM sn
          UNION ALL SELECT doc_id, block_no, ns, k + 1, CASE WHEN b > a AND b - a + ns[k + 1] > 420 THEN greatest(a, b - 60) ELSE a END, b + ns[k + 1]::INT,
          CASE WHEN b > a AND b - a + ns[k + 1] > 420 THEN a END, CASE WHEN b > a AND b - a + ns[k + 1] > 420 THEN b END FROM rs WHERE k < len(ns)),
        pc AS (SELECT doc_id, block_no, k, oa AS a, ob AS b FROM rs WHERE oa IS NOT NULL UNION ALL SELECT doc_id, block_no, k + 1, a, b FROM rs WHERE k = len(ns)),
        pm AS (SELECT *, greatest(0, ceil((b - a - 672) / 360.0))::INT AS m FROM pc),
        pieces AS (SELECT p.doc_id, p.block_no, row_number() OVER (PARTITION BY p.doc_id, p.block_no ORDER BY k, i)::INT - 1 AS piece_no, substring(text, (p.a + i * 360 + 1)::INT, (CASE WHEN i < m THEN 420 ELSE p.b - p.a - i * 360 END)::INT) AS piece
          FROM pm p JOIN b ON b.doc_id = p.doc_id AND b.block_no = p.block_no, unnest(range(0, m + 1)) t(i)
          UNION ALL SELECT doc_id, block_no, 0, text FROM b WHERE length(text) <= 420)"""
_SECRETS = r"""h AS (SELECT doc_id, 'model key' AS label, unnest(regexp_extract_all(text, '(?i)sk-[A-Za-z0-9\-_.]{20,}')) AS m FROM documents
        UNION ALL SELECT doc_id, 'api key', unnest(regexp_extract_all(text, '(?i)api[_-]?key\s*[:=]\s*[''"][^''"]{8,}')) FROM documents
        UNION ALL SELECT doc_id, 'credential', unnest(regexp_extract_all(text, '(?i)(token|password|passwd|secret)\s*[:=]\s*[''"][^''"]{8,}')) FROM documents)"""

ORACLE_SQL = {
    "cells_to_facts": f"""WITH {_CELLS} SELECT doc_id, r + 1 AS row, c + 1 AS col, p AS indicator, s || '/' || p AS indicator_path, p AS family_root, (c + 1991) || '年累计' AS column_label, CAST(v AS DOUBLE) AS value FROM b""",
    "fact_lookup": f"""WITH {_CELLS} SELECT CAST(doc_id AS INT) AS q, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM b WHERE p = '1-URGENT' GROUP BY 1""",
    "corpus_verify": """SELECT d.doc_id, 'set/' || d.doc_id AS path, CASE WHEN d.doc_id % 7 <> 0 THEN n_chars END AS manifest_size, CASE WHEN d.doc_id % 13 <> 0 THEN sha256(text) END AS sha256,
        CASE WHEN d.doc_id % 13 = 0 THEN 'missing' WHEN d.doc_id % 7 = 0 THEN 'not_in_manifest' WHEN d.doc_id % 11 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM documents d""",
    "corpus_problems": f"WITH {_VERIFIED} SELECT doc_id, status AS issue, CASE WHEN status = 'not_in_manifest' THEN 'set/' ELSE 'short/' END || doc_id AS path FROM v WHERE status <> 'ok'",
    "corpus_counts": f"WITH {_VERIFIED} SELECT kind, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS other FROM (SELECT status, type AS kind FROM v UNION ALL SELECT status, 'all' FROM v) GROUP BY 1",
    "exact_copies": "SELECT sha256(text) AS sha256, arg_min(doc_id, (length(CAST(doc_id AS VARCHAR)), doc_id)) AS canonical, count(*) AS copies FROM documents GROUP BY 1",
    "units_to_blocks": f"WITH RECURSIVE {_FOLD.format(docs='documents', text='text')} SELECT doc_id, block_no, text, n_units, location FROM b",
    "text_blocks": f"""WITH RECURSIVE {_TYPED}, {_FOLD.format(docs='typed', text='text')}, {_SPLIT}
        SELECT doc_id || '-' || block_no || '-' || piece_no AS block_id, doc_id, 'name' || doc_id AS orig_name, CASE WHEN doc_id % 4 = 2 THEN 'pdf' ELSE 'word' END AS source_type, location, n_units, piece AS text FROM pieces JOIN b USING (doc_id, block_no)""",
    "block_counts": f"""WITH RECURSIVE {_TYPED}, {_FOLD.format(docs='typed', text='text')}, {_SPLIT}
        SELECT (SELECT count(*) FROM typed) AS docs, (SELECT count(*) FROM pieces) AS blocks, (SELECT count(*) FROM documents WHERE trim(replace(text, chr(10), ' '), ' ') = '') AS failed""",
    "heading_units": r"""WITH r AS (SELECT conv_id, turn, ['第三条 ', '（二）', '(二)', '12.5% ', '附 录', '一、', '第 十2 章', '3 '][(conv_id + turn) % 8 + 1] || text AS x FROM conversations)
        SELECT conv_id, turn, regexp_matches(regexp_replace(x, '[ \t\r\f\x0B]+', '', 'g'), '^(第[一二三四五六七八九十百千0-9]+[章节条款项]|附录|附件|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|[0-9]{1,2}\.)') AS boundary FROM r""",
    "secret_scan": f"WITH {_SECRETS} SELECT doc_id, label, count(*) AS n, min(m[1:60]) AS first_found FROM h GROUP BY ALL",
    "secret_verdict": f"WITH {_SECRETS} SELECT count(*) AS n, count(*) = 0 AS passed FROM h WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = (SELECT min(source) FROM documents))",
    "han_terms": r"""WITH r AS (SELECT conv_id, turn, regexp_extract_all(translate(text, 'aeiou', '甲乙丙丁戊'), '\p{Han}+|[\p{Latin}\p{N}]+') AS runs FROM conversations),
        w AS (SELECT conv_id, turn, flatten(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^\p{Han}') THEN list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: r[i : i + 1])) ELSE [r] END)) AS w FROM r)
        SELECT conv_id, turn, array_to_string(w, ' ') AS terms FROM w""",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM bm WHERE rank <= 20",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, block_id, rank FROM dn",
    "hybrid_rrf": f"""WITH {_BM25}, {_DENSE}, j AS (SELECT query_id, block_id, bm.rank AS r1, dn.rank AS r2, round(coalesce(1 / (bm.rank + 60), 0) + coalesce(1 / (dn.rank + 60), 0), 9) AS score FROM bm FULL JOIN dn USING (query_id, block_id))
        SELECT query_id, block_id, score FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 NULLS LAST, r2 NULLS LAST) <= 6""",
    "ngram_coverage": f"""WITH {_BM25}, p AS (SELECT query_id, block_id, {_N.format('b.text')} AS a, {_N.format('d.text')} AS t FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = block_id WHERE rank <= 20),
        g AS (SELECT query_id, block_id, t, list_transform(range(1, length(a) - 2), lambda i: a[i : i + 3]) AS g FROM p)
        SELECT query_id, block_id, round(len(list_filter(g, lambda x: contains(t, x))) / len(g), 9) AS coverage FROM g""",
    "title_locate": """WITH n AS (SELECT c_custkey AS name_id, c_name AS name FROM customer), ti AS (SELECT name_id AS title_id, name[-6:-2] AS title FROM n)
        SELECT title_id, name_id, CAST(row_number() OVER (PARTITION BY title_id ORDER BY length(name), CAST(name_id AS VARCHAR)) AS INT) AS cand_no FROM ti JOIN n ON contains(name, title)""",
    "lcs_match": """WITH a AS (SELECT page_id AS a_id, substring(url, 12) AS s FROM pages), b AS (SELECT page_id AS b_id, url AS s FROM pages),
        ga AS (SELECT a_id, i AS pos, s[i : i + 16] AS g FROM a, unnest(range(1, length(s) - 15)) t(i)), gb AS (SELECT b_id, i AS other, s[i : i + 16] AS g FROM b, unnest(range(1, length(s) - 15)) t(i)),
        m AS (SELECT a_id, b_id, pos, pos - other AS d FROM ga JOIN gb USING (g)), r AS (SELECT a_id, b_id, d, pos - row_number() OVER (PARTITION BY a_id, b_id, d ORDER BY pos) AS run FROM m),
        c AS (SELECT a_id, b_id, count(*) AS n FROM r GROUP BY a_id, b_id, d, run) SELECT a_id, b_id, max(n) + 16 AS lcs FROM c GROUP BY ALL""",
    "group_split": """WITH s AS (SELECT conv_id % 3 AS stratum, conv_id AS grp, count(*) AS n FROM conversations GROUP BY ALL),
        c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY n, CAST(grp AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, round(sum(n) OVER (PARTITION BY stratum) / 3) AS quota FROM s)
        SELECT stratum, grp, n, CASE WHEN ahead < quota AND ahead + n <= quota + 15 THEN 'dev' ELSE 'test' END AS split FROM c""",
    "grade_rollup": """WITH r AS (SELECT lang, source, CAST(n_chars > 600 AS INT) = quality AS ok FROM documents JOIN labels USING (doc_id)),
        x AS (SELECT 'all' AS grp, '' AS value, ok FROM r UNION ALL SELECT 'lang', lang, ok FROM r UNION ALL SELECT 'source', source, ok FROM r)
        SELECT grp, value, count(*) AS n, count(*) FILTER (ok) AS correct, round_even(count(*) FILTER (ok) * 100.0 / count(*), 1)::DOUBLE AS percent FROM x GROUP BY ALL""",
    "number_fidelity": """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS p, l_suppkey || ' of ' || l_partkey * 2 || ' at 10.5' AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN contains(e, p) THEN '' ELSE p END AS missing, CASE WHEN contains(e, p) THEN 'ok' ELSE 'warn' END AS status FROM r""",
    "citation_check": r"""WITH r AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text || ' [' || turn || '] [' || conv_id % 5 || ']', '\[(\d{1,2})\]', 1), lambda x: CAST(x AS INT))) AS c FROM conversations)
        SELECT conv_id, turn, array_to_string(list_sort(list_filter(c, lambda x: x IN (1, 2, 3))), ',') AS valid, array_to_string(list_sort(list_filter(c, lambda x: x NOT IN (1, 2, 3))), ',') AS dangling FROM r""",
    "uncited_claims": r"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(text, '. ', '[1]. ') ELSE replace(text, '. ', '. [1] ') || ' ' || role || '!' END AS a FROM conversations),
        p AS (SELECT conv_id, turn, a, list_transform(regexp_extract_all(a, '[^。！？.!?\n]+[。！？.!?]*(?:[ \t\n\r\f\x0B]*\[[0-9]{1,2}\])*'), lambda x: trim(x, ' ')) AS x FROM r)
        SELECT conv_id, turn, CASE WHEN contains(a, 'Th the.') THEN '' ELSE array_to_string(list_filter(x, lambda v: regexp_matches(v, '[\p{L}\p{N}]') AND NOT regexp_matches(v, '\[[0-9]{1,2}\]')), '|') END AS uncited FROM p""",
    "refusal_rate": """WITH r AS (SELECT role AS kind, regexp_matches(text, 'th[ae]') OR turn % 5 = 4 AS refused FROM conversations)
        SELECT kind, count(*) AS n, count(*) FILTER (refused) AS refused, round(count(*) FILTER (refused) / count(*), 6) AS rate FROM r GROUP BY 1""",
}
