"""Multiple-choice questions answered from fact tables, from the text of the question to letter, reason and evidence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_address, clean_title, difference_terms, norm, question_sheet, question_terms, question_title
from ..sources.readers import checked, split_failures
from ..sources.shared import stored
from .answer import first_solved, nearest_option, option_number, relative, routed
from .evaluate import grade
from .match import locate
from .sheets import STOCK, place, term_hits

# Kinds of questions on tables.
LOOKUP, COMPARE, CALCULATE = "表格取数", "表格比较", "表格计算"

ATTEMPT = "q, doc_id, cand_no, answer, reason, sheet, address, indicator, value"


def parsed(questions: DataFrame, letters: str = "ABCD") -> DataFrame:
    """questions(q, question, qa_type, A, B, ...) with title, asked_sheet, quoted terms and change (term, col1, col2)."""
    text = F.col("question")
    parts = [clean_title(question_title(text)).alias("title"), question_sheet(text).alias("asked_sheet"), F.coalesce(question_terms(text), F.array().cast("array<string>")).alias("quoted"), difference_terms(text).alias("change")]
    return questions.select("q", "qa_type", *parts, *letters)


def _number(letter: str) -> str:
    return f"{letter}_number"


def numbered(asked: DataFrame, letters: str = "ABCD") -> DataFrame:
    """asked with the number of each option, which all ways to an answer compare with."""
    return asked.withColumns({_number(k): option_number(F.col(k)) for k in letters})


def candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked(q, title), names(doc_id, name) -> q, doc_id, cand_no: documents whose name holds the title, shortest name first.

    Each title is looked up once, however many questions share it."""
    titles = asked.where("title is not null").select(F.col("title").alias("title_id"), "title").distinct()
    found = locate(titles, names.select(F.col("doc_id").alias("name_id"), "name"))
    return asked.select("q", "title").join(found.withColumnRenamed("title_id", "title"), "title").select("q", F.col("name_id").alias("doc_id"), "cand_no")


def _asks(tries: DataFrame, letters: str) -> DataFrame:
    """q, doc_id, asked_sheet, kind, no, term: what a question of each type looks for in a document. Of kind c are the options of a
    comparison, of kind q quoted terms, of kind d the row of a change."""
    ask = lambda kind, no, term: F.struct(F.lit(kind).alias("kind"), no.cast("int").alias("no"), term.alias("term"))
    none = F.array().cast("array<struct<kind:string,no:int,term:string>>")
    options = F.array(*[ask("c", F.lit(i), F.col(k)) for i, k in enumerate(letters)])
    quoted = F.transform("quoted", lambda x, i: ask("q", i, x))
    change = F.when(F.col("change").isNotNull(), F.array(ask("d", F.lit(0), F.col("change.term")))).otherwise(none)
    each = F.when(F.col("qa_type") == COMPARE, options).when(F.col("qa_type") == LOOKUP, quoted).when(F.col("qa_type") == CALCULATE, F.concat(quoted, change))
    rows = tries.select("q", "doc_id", "asked_sheet", F.transform("quoted", norm).alias("bases"), F.explode(each).alias("ask"))
    return rows.select("q", "doc_id", "asked_sheet", "bases", "ask.*").where("term is not null")


def _firsts(hits: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Of each ask's best tier: rec, its first record, and based, the first whose column label holds a quoted basis."""
    record = F.struct("sheet", "row", "col", "indicator", "value")
    basis = F.exists("bases", lambda b: F.contains("column_label", b))
    tiers = hits.groupBy("q", "doc_id", "kind", "no", "tier").agg(F.min_by(record, F.struct(*order)).alias("rec"), F.min_by(record, F.when(basis, F.struct(*order))).alias("based"))
    return tiers.groupBy("q", "doc_id", "kind", "no").agg(F.min_by(F.struct("tier", "rec", "based"), "tier").alias("x")).select("q", "doc_id", "kind", "no", "x.*")


def _by_terms(firsts: DataFrame, letters: str, stock: str) -> DataFrame:
    """(q, doc_id): found, the first quoted term's record; best, the letter and record of the largest option; pair, those of the first two terms met."""
    indicator = F.col("tier") < 3
    rec = F.when(F.col("kind") == "c", F.coalesce("based", "rec")).otherwise(F.col("rec"))
    rows = firsts.withColumn("rec", rec)
    option = (F.col("kind") == "c") & indicator
    ahead = F.struct(F.col("rec.indicator").rlike(stock), -F.col("rec.value"), F.col("no"))
    letter = F.element_at(F.array(*map(F.lit, letters)), F.col("no") + 1)
    quoted = F.col("kind") == "q"
    met = F.array_sort(F.collect_list(F.when(quoted, F.struct("no", "rec"))))  # the quoted terms of one question
    return rows.groupBy("q", "doc_id").agg(
        F.min_by("rec", F.when(quoted & indicator, F.col("no"))).alias("found"),
        F.min_by(F.struct(letter.alias("letter"), "rec"), F.when(option, ahead)).alias("best"),
        F.transform(F.slice(met, 1, 2), lambda x: x.rec).alias("pair"),
    )


def _by_rows(hits: DataFrame, firsts: DataFrame, facts: DataFrame, tries: DataFrame, letters: str, order: tuple[str, ...]) -> DataFrame:
    """(q, doc_id): change, the first met row's difference between the two columns; span, last minus first number of the first
    row that has exactly one option near it."""
    best = firsts.where("kind = 'd' and tier < 3").select("q", "doc_id", "tier")
    met = hits.where("kind = 'd'").join(best, ["q", "doc_id", "tier"])
    met = met.groupBy("q", "doc_id", "sheet", "row").agg(F.min(order[0]).alias("at"), F.min("col").alias("hit"))
    numbers = [_number(k) for k in letters]
    asked = tries.where("change is not null").select("q", "doc_id", "change", *numbers)
    rows = facts.select("doc_id", "sheet", "row", "col", "column_label", "value").join(met, ["doc_id", "sheet", "row"]).join(asked, ["q", "doc_id"])
    under = lambda c: F.min_by("value", F.when(F.contains("column_label", F.col(c)), F.col("col")))
    ends = [F.min_by("value", "col").alias("first"), F.max_by("value", "col").alias("last"), F.min("col").alias("left"), F.max("col").alias("right"), F.count("*").alias("n")]
    rows = rows.groupBy("q", "doc_id", "sheet", "row", "at", "hit", *numbers).agg((under("change.col2") - under("change.col1")).alias("change"), *ends)
    span = F.col("last") - F.col("first")
    near = F.array_compact(F.array(*[F.when(relative(span, F.col(_number(k))) < 0.02, F.lit(k)) for k in letters]))
    rows = rows.withColumns({"span": span, "near": near})
    turn = F.struct("at", "row", "hit")
    cells = F.concat_ws(":", cell_address(F.col("row"), F.col("left")), cell_address(F.col("row"), F.col("right")))
    fits = (F.col("n") > 1) & (F.size("near") == 1)
    return rows.groupBy("q", "doc_id").agg(
        F.min_by(F.struct("sheet", cell_address(F.col("row"), F.col("hit")).alias("address"), F.col("change").alias("value")), turn).alias("row_change"),
        F.min_by(F.struct("sheet", cells.alias("address"), F.col("span").alias("value"), F.col("near")[0].alias("letter")), F.when(fits, turn)).alias("row_span"),
    )


def attempts(tries: DataFrame, facts: DataFrame, letters: str = "ABCD", stock: str = STOCK) -> DataFrame:
    """tries(q, doc_id, cand_no, and what ``parsed`` and ``numbered`` give): one attempt for each document and question, solved or with its reason.

    All terms of all types meet the facts in one join, whose hits are stored; facts are read once more for the rows of changes. A calculation goes on to the next of its three ways where one finds no option:
    the difference of two columns in a row, the span of a row, the arithmetic of two terms."""
    order = place(facts)
    asks = _asks(tries, letters)
    wanted = ("q", "doc_id", "kind", "no", "tier", "bases", "sheet", "row", "col", "indicator", "column_label", "value")
    hits = stored(term_hits(facts, asks).select(*dict.fromkeys([*wanted, *order])))
    firsts = _firsts(hits, order)
    rows = tries.join(_by_terms(firsts, letters, stock), ["q", "doc_id"], "left").join(_by_rows(hits, firsts, facts, tries, letters, order), ["q", "doc_id"], "left")
    nearest = lambda v: nearest_option(v, {k: F.col(_number(k)) for k in letters})
    a, b = F.try_element_at("pair", F.lit(1)), F.try_element_at("pair", F.lit(2))
    results = [a.value - b.value, b.value - a.value, a.value + b.value]
    rows = rows.withColumns({"by_look": nearest(F.col("found.value")), "by_row": nearest(F.col("row_change.value")), "fits": F.array(*[F.struct(nearest(v).alias("letter"), v.alias("value")) for v in results])})
    rows = rows.withColumn("fit", F.try_element_at(F.filter("fits", lambda x: x.letter.isNotNull()), F.lit(1)))
    at = lambda rec: cell_address(rec["row"], rec["col"])
    nothing = F.lit(None).cast("string")

    def outcome(answer: Column, reason: str, sheet: Column = nothing, address: Column = nothing, indicator: Column = nothing, value: Column | None = None) -> Column:
        return F.struct(
            answer.alias("answer"), F.lit(reason).alias("reason"), sheet.alias("sheet"), address.alias("address"), indicator.alias("indicator"),
            (F.lit(None).cast("double") if value is None else value).alias("value"),
        )

    found, best, change, span = F.col("found"), F.col("best"), F.col("row_change"), F.col("row_span")
    looked = F.when(found.isNull(), outcome(nothing, "indicator_not_found")).otherwise(outcome(F.col("by_look"), "table_lookup", found.sheet, at(found), found.indicator, found.value))
    compared = F.when(best.isNull(), outcome(nothing, "compare_no_values")).otherwise(outcome(best.letter, "table_compare_max", best.rec.sheet, at(best.rec), best.rec.indicator, best.rec.value))
    fit = F.col("fit")
    both = F.size(F.coalesce("pair", F.array())) > 1
    paired = outcome(fit.letter, "table_calc_fallback", address=F.concat_ws(",", at(a), at(b)), value=fit.value)
    by_row = F.col("by_row")
    calculated = (
        F.when(by_row.isNotNull(), outcome(by_row, "table_calc_row", change.sheet, change.address, F.col("change.term"), change.value))
        .when(span.isNotNull(), outcome(span.letter, "table_calc_span", span.sheet, span.address, F.col("change.term"), span.value))
        .when(both & fit.isNotNull(), paired)
        .when(both, outcome(nothing, "calc_no_match", address=F.concat_ws(",", at(a), at(b))))
        .otherwise(outcome(nothing, "calc_need_two_values"))
    )
    kind = F.col("qa_type")
    out = F.when(kind == LOOKUP, looked).when(kind == COMPARE, compared).when(kind == CALCULATE, calculated).otherwise(outcome(nothing, "unknown_qa_type"))
    return rows.select("q", "doc_id", "cand_no", out.alias("out")).select("q", "doc_id", "cand_no", "out.*")


def table_solve(questions: DataFrame, names: DataFrame, facts: DataFrame, letters: str = "ABCD", stock: str = STOCK) -> DataFrame:
    """questions(q, question, qa_type, A, B, ...), names(doc_id, name), facts -> one row a question: q, doc_id, answer, reason, and the
    evidence sheet, address, indicator, value.

    The first candidate document that gives an answer counts, else the first one's failure. Options are texts; their first number
    counts. A question without a title fails with no_title, one whose title no name holds (an empty title included) with doc_not_found."""
    asked = parsed(questions, letters)
    tries = stored(numbered(asked, letters).join(candidates(asked, names), "q"))
    best = first_solved(attempts(tries, facts, letters, stock)).drop("cand_no")
    rows = asked.select("q", "title").join(best, "q", "left")
    reason = F.coalesce("reason", F.when(F.col("title").isNull(), "no_title").otherwise("doc_not_found"))
    return rows.select("q", "doc_id", "answer", reason.alias("reason"), "sheet", "address", "indicator", "value")


def solved_or_failures(questions: DataFrame, names: DataFrame, facts: DataFrame, letters: str = "ABCD") -> tuple[DataFrame, DataFrame]:
    """``table_solve`` of the questions that can be asked, and (q, error) of those without text, without any option, or whose q is another's too."""
    twice = questions.groupBy("q").agg(F.count("*").alias("_n"))
    rules = {"no_question": F.col("question").isNull(), "no_options": F.coalesce(*[F.col(k) for k in letters]).isNull(), "repeated_id": F.col("_n") > 1}
    rows = checked(questions.join(twice, "q", "left"), rules)
    good, failed = split_failures(rows)
    return table_solve(good.drop("_n"), names, facts, letters), failed.select("q", "error")


def graded_batch(questions: DataFrame, names: DataFrame, facts: DataFrame, by_text: DataFrame, letters: str = "ABCD") -> DataFrame:
    """questions(q, question, qa_type, source_type, gold, A, B, ...) -> q, answer, route, reason, gold, correct.

    Questions on tables are solved from facts; where that fails, and for all others, by_text(q, answer) counts. An unanswered
    question is wrong."""
    tables = questions.where("source_type = 'excel'")
    solved = table_solve(tables, names, facts, letters).select("q", "answer", "reason")
    rows = routed(questions.select("q", "source_type"), solved, by_text)
    rows = rows.withColumn("reason", F.when(F.col("route") == "text", F.col("reason")))
    graded = grade(rows.join(questions.select("q", "qa_type", "gold"), "q").withColumn("pred", F.col("answer")))
    return graded
