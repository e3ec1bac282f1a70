"""Evidence of questions: numbered passages, prompts, and audits of what the evidence holds."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm
from ..sources.shared import stored
from .coverage import pair_coverage

ITEM = ["q", "no", "text", "source", "location"]


def unlocated(questions: DataFrame, located: DataFrame) -> DataFrame:
    """questions(q, title) with a title that located(q, ...) does not hold: to be refused without evidence."""
    return questions.where(F.coalesce(F.col("title"), F.lit("")) != "").join(located.select("q"), "q", "left_anti")


def document_evidence(located: DataFrame, blocks: DataFrame, most: int = 8, size: int = 600) -> DataFrame:
    """located(q, doc_id), blocks(doc_id, block_no, text, location): a document's first ``most`` blocks, white space gone.

    Only blocks of documents that are located are ranked, and a document's are cut to ``most`` before they meet its questions."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("block_no"))
    first = blocks.join(located.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("no", rank).where(F.col("no") <= most)
    first = first.select("doc_id", "no", F.substring(norm(F.col("text")), 1, size).alias("text"), "location")
    return located.join(first, "doc_id").withColumn("source", F.col("doc_id")).select(*ITEM)


def retrieved_evidence(hits: DataFrame, blocks: DataFrame, most: int = 6, size: int = 600) -> DataFrame:
    """hits(q, block_id, rank), blocks(block_id, text, source, location): the best ``most`` blocks as they are."""
    rows = hits.where(F.col("rank") <= most).join(blocks, "block_id")
    return rows.select("q", F.col("rank").alias("no"), F.substring("text", 1, size).alias("text"), "source", "location")


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """questions(q, question) with their evidence as lines ``[no] (location) text`` above; none: the question alone."""
    line = F.concat(F.lit("["), F.col("no"), F.lit("] ("), F.coalesce("location", F.lit("")), F.lit(") "), F.coalesce("text", F.lit("")))
    lines = evidence.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("lines"))
    rows = questions.join(lines, "q", "left")
    return rows.select("q", F.concat_ws("\n", F.transform("lines", lambda x: x.line), F.col("question")).alias("prompt"))


def file_hits(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions(id, doc_id, evidence_doc, fallback_doc), gold(id, doc_id, ...): gold with hit, whether the first
    document that the prediction names is the right one."""
    named = predictions.select("id", F.coalesce("doc_id", "evidence_doc", "fallback_doc").alias("named"))
    return gold.join(named, "id", "left").withColumn("hit", F.coalesce(F.col("named") == F.col("doc_id"), F.lit(False)))


def table_hits(rows: DataFrame, least: float = 0.01) -> DataFrame:
    """rows(cells, gold_cells: array<string>, numbers, gold_numbers: array<double>): hit by a shared address or value."""
    near = F.exists("gold_numbers", lambda g: F.exists("numbers", lambda v: F.abs(g - v) < least))
    return rows.withColumn("hit", F.coalesce(F.arrays_overlap("cells", "gold_cells"), F.lit(False)) | F.coalesce(near, F.lit(False)))


def hit_rates(rows: DataFrame, table_kind: str = "excel") -> DataFrame:
    """rows(qa_type, source_type, file_hit, content_hit): counts by type, all tables as one group, and over all."""
    group = F.when(F.col("source_type") == table_kind, table_kind).otherwise(F.col("qa_type"))
    marked = rows.select(F.explode(F.array(group, F.lit("all"))).alias("grp"), "file_hit", "content_hit")
    return marked.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("file_hit").alias("files"), F.count_if("content_hit").alias("contents"))


def extraction_audit(questions: DataFrame, units: DataFrame, least: float = 0.7) -> DataFrame:
    """questions(q, doc_id, source_type, evidence), units(doc_id, unit_no, text): coverage of the gold evidence in the
    document's whole text (null as empty) and a note, 'empty' for documents without text."""
    whole = units.join(questions.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda u: norm(u.text)), "").alias("t"))
    texts = questions.select("doc_id").distinct().join(whole, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit("")))
    texts = stored(texts)
    found = pair_coverage(questions.select("doc_id", F.col("evidence").alias("a")), texts, ["doc_id"], [])
    rows = questions.join(texts.select("doc_id", (F.col("t") == "").alias("blank")), "doc_id", "left").withColumn("a", norm(F.coalesce("evidence", F.lit(""))))
    rows = rows.join(found, ["doc_id", "a"], "left").withColumn("blank", F.coalesce("blank", F.lit(True)))
    rows = rows.withColumn("coverage", F.round(F.coalesce("coverage", F.lit(0.0)), 9))
    note = F.when(F.col("blank"), "empty").when(F.col("coverage") < least, "miss").otherwise("ok")
    return rows.select("q", "doc_id", "source_type", "coverage", note.alias("note"))


def audit_summary(audit: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Totals by source type, and the ``most`` documents (a report) with text and most misses."""
    totals = audit.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.col("note") == "ok").alias("ok"), F.round(F.avg("coverage"), 6).alias("mean"))
    misses = audit.where("note = 'miss'").groupBy("doc_id").agg(F.count("*").alias("misses"))
    return totals, misses.orderBy(F.desc("misses"), "doc_id").limit(most)
