"""Grading, roll-ups, splits, number fidelity and citations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import ranked


def grade(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    return rows.withColumn("correct", F.coalesce(F.col(pred) == F.col(gold), F.lit(False)))


def accuracy(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Overall and by each of groups: grp, value, n, correct, and percent to one decimal. The overall row is there for an empty table as well, with 0."""
    percent = F.coalesce(F.try_divide(F.col("correct") * 100, F.col("n")), F.lit(0.0))
    whole = rows.agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).select(F.lit("all").alias("grp"), F.lit("").alias("value"), "n", "correct")
    if groups:
        pairs = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).cast("string").alias("value")) for g in groups])
        each = rows.select("correct", F.explode(pairs).alias("p")).select("correct", "p.grp", "p.value")
        whole = whole.union(each.groupBy("grp", "value").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")))
    return whole.withColumn("percent", F.bround(percent, 1))


def choose(questions: DataFrame, split: str = "dev", text_only: bool = False, text_kinds: tuple[str, ...] = ("word", "pdf")) -> DataFrame:
    """The questions of one split; of text documents alone, if asked."""
    rows = questions.where(F.col("split") == split)
    return rows.where(F.col("source_type").isin(*text_kinds)) if text_only else rows


def group_split(sizes: DataFrame, share: int = 3, slack: int = 15) -> DataFrame:
    """sizes(stratum, grp, n) -> split: whole groups, smallest first, are dev while dev has less than its quota.

    The running sum is over a histogram of sizes. How many groups of a size are dev follows by arithmetic; only
    where that is some of them and not all do the groups of that size need an order, which ranges of them take, so no window
    holds all groups of a size. Strata and groups are not null."""
    order = W.partitionBy("stratum").orderBy("n")
    bins = sizes.groupBy("stratum", "n").agg(F.count("*").alias("groups"))
    bins = bins.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("groups")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    bins = bins.withColumn("quota", F.round(F.sum(F.col("n") * F.col("groups")).over(W.partitionBy("stratum")) / share).cast("bigint"))
    under, within = F.ceil((F.col("quota") - F.col("before")) / F.col("n")), F.floor((F.col("quota") + slack - F.col("before")) / F.col("n"))
    bins = bins.withColumn("dev", F.greatest(F.lit(0), F.least("groups", under, within)))
    rows = sizes.join(bins.select("stratum", "n", "groups", "dev"), ["stratum", "n"])
    some = (F.col("dev") > 0) & (F.col("dev") < F.col("groups"))
    names = ["stratum", "grp", "n"]
    whole = rows.where(~some).select(*names, F.when(F.col("dev") > 0, "dev").otherwise("test").alias("split"))
    part = ranked(rows.where(some), ["stratum", "n"], [F.col("grp").cast("string")])
    return whole.union(part.select(*names, F.when(F.col("place") <= F.col("dev"), "dev").otherwise("test").alias("split")))


def answer_numbers(answer: Column) -> Column:
    """Numbers of an answer outside citations and list numbers."""
    t = F.regexp_replace(answer, r"\[\d+\]", "")
    t = F.regexp_replace(t, r"(?m)^\s*\d+[.、)](?!\d)", "")
    return F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def missing_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence holds neither as they are, nor to two decimals without trailing zeros,
    nor, if they are not whole, as the nearest integer."""

    def absent(x: Column) -> Column:
        exact = x.try_cast("decimal(38,10)")
        short = F.regexp_replace(F.bround(exact, 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
        whole = F.when(exact != F.floor(exact), F.bround(exact, 0).cast("decimal(38,0)").cast("string"))
        return ~(F.contains(evidence, x) | F.coalesce(F.contains(evidence, short), F.lit(False)) | F.coalesce(F.contains(evidence, whole), F.lit(False)))

    return F.filter(answer_numbers(answer), absent)


def fidelity(answer: Column, evidence: Column, refusal: str) -> Column:
    """'refused' for an answer that holds the refusal phrase, 'warn' if the evidence lacks a number of it, else 'ok'."""
    lacking = F.size(missing_numbers(answer, evidence)) > 0
    return F.when(F.contains(answer, F.lit(refusal)), "refused").when(lacking, "warn").otherwise("ok")


def citations(answer: Column, available: Column) -> tuple[Column, Column]:
    """Valid and dangling citation numbers."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))
    return F.array_intersect(cited, available), F.array_except(cited, available)


def uncited(answer: Column, refusal: str) -> Column:
    """Sentences of an answer that cite nothing, white space at their ends gone; none of a refusal."""
    parts = F.transform(F.regexp_extract_all(answer, F.lit(r"[^。！？.!?\n]+[。！？.!?]*(?:\s*\[\d{1,2}\])*"), F.lit(0)), lambda x: F.trim(x))
    bare = F.filter(parts, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(r"\[\d{1,2}\]"))
    return F.when(F.contains(answer, F.lit(refusal)), F.array().cast("array<string>")).otherwise(bare)


def refusal_rates(answers: DataFrame, refusal: str) -> DataFrame:
    """answers(kind, answer, status): for each kind the answers, and those that are the refusal phrase or have status refused."""
    refused = (F.trim("answer") == refusal) | F.coalesce(F.col("status") == "refused", F.lit(False))
    rows = answers.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce(refused, F.lit(False))).alias("refused"))
    return rows.withColumn("rate", F.round(F.col("refused") / F.col("n"), 6))


def error_rows(rows: DataFrame) -> DataFrame:
    """The graded rows that are wrong."""
    return rows.where(~F.col("correct"))


def split_leaks(rows: DataFrame) -> DataFrame:
    """rows(grp, split): groups that are in more than one split."""
    return rows.groupBy("grp").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def split_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(split, grp, ...): rows and distinct groups of each split, in all and by each of the columns ``by``."""
    pairs = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in by])
    each = rows.select("split", "grp", F.explode(pairs).alias("p")).select("split", "grp", "p.*")
    return each.groupBy("split", "kind", "value").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))


def split_documents(rows: DataFrame) -> DataFrame:
    """rows(split, grp): the documents of each split, a row each."""
    return rows.select("split", "grp").distinct()


def inconsistent_answers(rows: DataFrame) -> DataFrame:
    """rows(answer, answer_text, option_a to option_d): those where the option named by the letter is not the answer's text."""
    named = F.element_at(F.create_map(*[x for k in "abcd" for x in (F.lit(k.upper()), F.col(f"option_{k}"))]), F.col("answer"))
    return rows.where(~F.coalesce(F.trim(named) == F.trim("answer_text"), F.lit(False)))


def statements_hit(coverage: DataFrame, least: float = 0.7, least_cosine: float = 0.6) -> DataFrame:
    """coverage(q, statement_no, coverage, maybe cosine), a row for each statement and block: hit if every statement of a
    question is in some block, by coverage or, where there is a cosine of their vectors, by that."""
    found = F.col("coverage") >= least
    if "cosine" in coverage.columns:
        found = found | F.coalesce(F.col("cosine") >= least_cosine, F.lit(False))
    best = coverage.groupBy("q", "statement_no").agg(F.coalesce(F.max(found), F.lit(False)).alias("found"))
    return best.groupBy("q").agg(F.min("found").alias("hit"))


def with_cosine(coverage: DataFrame, statements: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_no")) -> DataFrame:
    """coverage(q, statement_no, keys, ...) with the cosine of each statement's vector in statements(q, statement_no, v) and each block's
    in blocks(keys, v), all of unit length; null where either has none."""
    rows = coverage.join(statements.withColumnRenamed("v", "_s"), ["q", "statement_no"], "left").join(blocks.withColumnRenamed("v", "_b"), list(keys), "left")
    dot = F.aggregate(F.zip_with("_s", "_b", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("cosine", dot).drop("_s", "_b")


def cited_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, location, ord, ...): of the pieces that share a place the last one, as evidence names places."""
    return blocks.groupBy("doc_id", "location").agg(F.max_by(F.struct("*"), "ord").alias("b")).select("b.*")
