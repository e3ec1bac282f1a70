"""Answers to multiple-choice questions: options by text coverage, and by number."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clauses, clean_title, norm, number, question_title, stem
from .coverage import pair_coverage, parts_coverage
from .match import locate


def scope(questions: DataFrame, names: DataFrame) -> DataFrame:
    """questions(q, question), names(doc_id, name): q and doc_id, the document whose file name holds the title that the question names.

    Of several names the shortest is taken, of equally short ones the smallest doc_id as text. Questions without a title, or with one that
    no name holds, are absent."""
    titles = questions.select(F.col("q").alias("title_id"), clean_title(question_title(F.col("question"))).alias("title"))
    found = locate(titles, names.select(F.col("doc_id").alias("name_id"), stem(F.col("name")).alias("name")))
    return found.where("cand_no = 1").select(F.col("title_id").alias("q"), F.col("name_id").alias("doc_id"))


def clause_coverage(options: DataFrame, blocks: DataFrame) -> DataFrame:
    """options(q, doc_id, letter, option), blocks(doc_id, block_no, text): q, letter, clause_no, block_no, coverage.

    block_no names one block of its document. Clauses and blocks meet by their n-grams, not text by text."""
    each = options.select("q", "doc_id", "letter", F.posexplode(clauses(F.col("option"))).alias("clause_no", "clause"))
    each = each.withColumn("a", norm(F.coalesce("clause", F.lit(""))))
    found = pair_coverage(each.select("doc_id", "a"), blocks.select("doc_id", "block_no", F.col("text").alias("t")), ["doc_id"], ["block_no"])
    return each.join(found, ["doc_id", "a"]).select("q", "letter", "clause_no", "block_no", "coverage")


def option_scores(coverage: DataFrame) -> DataFrame:
    """Of each option the mean over clauses of the best block's coverage, and whether it is the best (first letter of a tie)."""
    best = coverage.groupBy("q", "letter", "clause_no").agg(F.max("coverage").alias("m"))
    scores = best.groupBy("q", "letter").agg(F.round(F.avg("m"), 9).alias("score"))
    first = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "letter")) == 1
    return scores.withColumn("chosen", first)


def option_evidence(coverage: DataFrame, scores: DataFrame, each: int = 2, most: int = 4) -> DataFrame:
    """Blocks of the chosen option: the best ``each`` of every clause in clause order, without repeats, the first ``most``."""
    rows = coverage.join(scores.where("chosen").select("q", "letter"), ["q", "letter"])
    rank = F.row_number().over(W.partitionBy("q", "clause_no").orderBy(F.desc("coverage"), "block_no"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= each)
    rows = rows.groupBy("q", "block_no").agg(F.min(F.struct("clause_no", "rank")).alias("place"))
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("q").orderBy("place"))).where(F.col("ord") <= most).select("q", "ord", "block_no")


def option_number(option: Column) -> Column:
    """The first number of an option, thousands separators dropped, or null."""
    return number(F.nullif(F.regexp_extract(F.regexp_replace(option, "[,，]", ""), r"-?\d+(?:\.\d+)?", 0), F.lit("")))


def relative(value: Column, option: Column) -> Column:
    """Distance of an option from a computed value, relative to that value (1 at least)."""
    return F.abs(value - option) / F.greatest(F.lit(1.0), F.abs(value))


def nearest_option(value: Column, options: dict[str, Column], tolerance: float = 0.02) -> Column:
    """The letter of the nearest option (first of a tie) within the tolerance, or null; null options do not count."""
    near = F.array_min(F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(relative(value, x).alias("d"), F.lit(k).alias("k"))) for k, x in options.items()])))
    return F.when(near.getField("d") < tolerance, near.getField("k"))


def within(value: Column, options: dict[str, Column], tolerance: float = 0.02) -> Column:
    """Letters of all options within the tolerance."""
    return F.array_compact(F.array(*[F.when(relative(value, x) < tolerance, F.lit(k)) for k, x in options.items()]))


def pair_arithmetic(a: Column, b: Column, options: dict[str, Column]) -> Column:
    """The option that a-b, else b-a, else a+b finds."""
    return F.coalesce(*[nearest_option(v, options) for v in (a - b, b - a, a + b)])


def fallback_option(options: DataFrame, hits: DataFrame) -> DataFrame:
    """options(q, letter, option), hits(q, rank, block_id, text): the (option, hit) of best coverage of the whole option.

    Ties go to the first letter, then the better hit. Questions without hits are refused: a null letter."""
    pairs = parts_coverage(options.select("q", "letter", F.col("option").alias("a")), hits.select("q", "rank", "block_id", F.col("text").alias("t")), "q")
    pairs = pairs.withColumn("coverage", F.round("coverage", 9))
    order = W.partitionBy("q").orderBy(F.desc("coverage"), "letter", "rank")
    best = pairs.withColumn("place", F.row_number().over(order)).where("place = 1").select("q", "letter", "block_id", "coverage")
    return options.select("q").distinct().join(best, "q", "left").withColumn("refused", F.col("letter").isNull())


def sweep(options: DataFrame, hits: DataFrame, strength: DataFrame, variants: list[tuple[str, int, bool, bool]], weight: float = 0.25) -> DataFrame:
    """variants(name, hits taken, fused, by clauses): name, q, letter, score and chosen, in one pass over the widest hits.

    strength(q, letter, top) is the best BM25 score of an option as a query; fused scores take ``weight`` of
    top / max(top, 1)."""
    whole = options.select("q", "letter", F.lit(False).alias("by_clause"), F.lit(0).alias("clause_no"), F.col("option").alias("part"))
    parts = options.select("q", "letter", F.lit(True).alias("by_clause"), F.posexplode(clauses(F.col("option"))).alias("clause_no", "part"))
    pairs = parts_coverage(whole.union(parts).withColumnRenamed("part", "a"), hits.select("q", "rank", F.col("text").alias("t")), "q")
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), F.lit(f).alias("fused"), F.lit(c).alias("clauses")) for n, k, f, c in variants])
    rows = pairs.withColumn("v", F.explode(kinds)).where((F.col("rank") <= F.col("v.k")) & (F.col("by_clause") == F.col("v.clauses")))
    best = rows.groupBy("v.name", "v.fused", "q", "letter", "clause_no").agg(F.max("coverage").alias("m"))
    scores = best.groupBy("name", "fused", "q", "letter").agg(F.avg("m").alias("coverage")).join(strength, ["q", "letter"], "left")
    top = F.coalesce("top", F.lit(0.0))
    score = F.when(F.col("fused"), (1 - weight) * F.col("coverage") + weight * top / F.greatest(top, F.lit(1.0))).otherwise(F.col("coverage"))
    scores = scores.select("name", "q", "letter", F.round(score, 9).alias("score"))
    first = F.row_number().over(W.partitionBy("name", "q").orderBy(F.desc("score"), "letter")) == 1
    return scores.withColumn("chosen", first)


def sweep_accuracy(scores: DataFrame, questions: DataFrame, names: list[str]) -> DataFrame:
    """scores(name, q, letter, chosen) as ``sweep`` gives them, questions(q, qa_type, gold): for each variant of ``names``, overall and by
    type, n, refused, correct, percent. A question that a variant has no hits for is refused, not left out; a refusal is wrong."""
    asked = questions.select("q", "qa_type", "gold", F.explode(F.array(*map(F.lit, names))).alias("name"))
    rows = asked.join(scores.where("chosen").select("name", "q", "letter"), ["name", "q"], "left")
    each = rows.withColumn("value", F.explode(F.array(F.lit("all"), F.coalesce("qa_type", F.lit("")))))
    out = each.groupBy("name", "value").agg(F.count("*").alias("n"), F.count_if(F.col("letter").isNull()).alias("refused"), F.count_if(F.col("letter") == F.col("gold")).alias("correct"))
    return out.withColumn("percent", F.bround(F.col("correct") * 100 / F.col("n"), 1))


def first_solved(attempts: DataFrame) -> DataFrame:
    """attempts(q, cand_no, answer, reason): the first candidate with an answer, else the first one's failure."""
    order = W.partitionBy("q").orderBy(F.col("answer").isNull(), "cand_no", "answer", "reason")
    return attempts.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def routed(questions: DataFrame, by_table: DataFrame, by_text: DataFrame, table_kind: str = "excel") -> DataFrame:
    """questions(q, source_type): the table answer where there is one, else the text answer with the table's reason."""
    kind = F.col("source_type") == table_kind
    rows = questions.join(by_table.select("q", F.col("answer").alias("a"), "reason"), "q", "left").join(by_text.select("q", F.col("answer").alias("b")), "q", "left")
    a, reason = F.when(kind, F.col("a")), F.when(kind & F.col("a").isNull(), F.coalesce("reason", F.lit("doc_not_found")))
    return rows.select("q", F.coalesce(a, "b").alias("answer"), F.when(a.isNotNull(), "table").otherwise("text").alias("route"), reason.alias("reason"))
