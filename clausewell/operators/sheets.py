"""Spreadsheet cells to fact records, and fact lookup.

cells(doc_id, sheet, r, c, raw): 0-based places, blank cells kept. Order-dependent work is on rows, far fewer than cells."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cell_address, norm, number, number_text
from ..sources.readers import checked
from .answer import nearest_option, pair_arithmetic, within

KEY = ["doc_id", "sheet"]
# Periods and measure bases of header cells, unit mark, child mark.
PERIOD = r"20\d{2}\s*年"
BASIS = (
    r"本月|本年累计|累计|当期|本期|同比|同期|比年初|余额|发生额|上年末|年初|"
    r"[一二三四1-4]\s*季度|[一二三四]季度末|[1-9]\s*月(?:末|度)?"
)
HEADER = f"{PERIOD}|{BASIS}"
UNIT = r"单位\s*[:：]\s*(.+)"
CHILD = "其中"
# Fixed value: indicators of stocks and counts, which are not compared with flows.
STOCK = "总资产|总负债|资产总额|负债总额|净资产|余额|保险金额|保额|件数|机构数|人员数"


def grid_cells(grids: DataFrame) -> DataFrame:
    """grids(doc_id, sheet, rows array<array<string>>) -> cells; blank cells and rows keep their places."""
    each = grids.select(*KEY, F.posexplode("rows").alias("r", "row"))
    return each.select(*KEY, "r", F.posexplode("row").alias("c", "raw"))


def fill_merged(cells: DataFrame, merges: DataFrame, half_open: bool = False) -> DataFrame:
    """cells with every cell of a range in merges(doc_id, sheet, r1, r2, c1, c2) set to its top left value.

    Bounds are inclusive, or without the last row and column if ``half_open``. Cells that ranges add appear; of
    overlapping ranges that of largest (r1, c1) counts. Ranges become cells, so the join is an equality."""
    last = int(half_open)
    span = lambda a, b: F.when(F.col(b) - last >= F.col(a), F.sequence(F.col(a), F.col(b) - last))
    held = merges.select(*KEY, "r1", "c1", F.explode(span("r1", "r2")).alias("r"), span("c1", "c2").alias("cs"))
    held = held.select(*KEY, "r1", "c1", "r", F.explode("cs").alias("c"))
    corner = cells.select(*KEY, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("raw").alias("filled"))
    held = held.join(corner, [*KEY, "r1", "c1"]).groupBy(*KEY, "r", "c").agg(F.max_by(F.struct("filled"), F.struct("r1", "c1")).alias("f"))
    rows = cells.join(held, [*KEY, "r", "c"], "full_outer")
    return rows.select(*KEY, "r", "c", F.when(F.col("f").isNotNull(), F.col("f.filled")).otherwise(F.col("raw")).alias("raw"))


def facts(cells: DataFrame, header: str = HEADER, unit: str = UNIT, child: str = CHILD, gap: int = 3) -> DataFrame:
    """One row for each labelled number (the column num, where cells have it and it is not null, else what the raw text
    says): indicator with category and family root, column label, value, unit.

    A column sheet_no of cells, the sheet's number in its workbook, goes into the facts. A sheet without a header row takes the nearest of the ``gap`` rows above its first number that has two texts
    or more and no number; a sheet without that has no facts."""
    num = F.coalesce("num", number(F.col("raw"))) if "num" in cells.columns else number(F.col("raw"))
    x = cells.withColumns({"v": F.coalesce(norm(F.col("raw")), F.lit("")), "num": num})
    head = (F.col("v") != "") & (F.length("v") <= 16) & F.col("v").rlike(header)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s.v), "")
    rows = x.groupBy(*KEY, "r").agg(F.max(head).alias("head"), F.max(F.col("num").isNotNull()).alias("has_num"), F.count_if(F.col("v") != "").alias("filled"), whole.alias("whole"))
    order = W.partitionBy(*KEY).orderBy("r")
    rows = rows.withColumn("cand", F.col("head") & ~F.col("has_num"))
    rows = rows.withColumn("last_h", F.last(F.when(F.col("cand"), F.col("r")), True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    stop = F.when(~F.col("cand") & F.col("last_h").isNotNull() & (F.col("has_num") | (F.col("r") > F.col("last_h") + gap)), F.col("r"))
    rows = rows.withColumn("stop", F.min(stop).over(W.partitionBy(*KEY)))
    sheet = W.partitionBy(*KEY)
    rows = rows.withColumns({"first_num": F.min(F.when(F.col("has_num"), F.col("r"))).over(sheet), "headed": F.max("cand").over(sheet)})
    near = ~F.col("has_num") & (F.col("filled") >= 2) & F.col("r").between(F.col("first_num") - gap, F.col("first_num") - 1)
    rows = rows.withColumn("fallback", F.max(F.when(near, F.col("r"))).over(sheet))
    found = F.col("cand") & (F.col("r") < F.coalesce("stop", F.lit(2**31 - 1)))
    rows = rows.withColumn("is_header", F.when(F.col("headed"), found).otherwise(F.coalesce(F.col("r") == F.col("fallback"), F.lit(False))))
    named = F.when(F.col("whole").rlike(unit), F.struct("r", F.regexp_extract("whole", unit, 1).alias("u")))
    sheets = rows.groupBy(*KEY).agg(F.max(F.when(F.col("is_header"), F.col("r"))).alias("top"), F.min(named).getField("u").alias("sheet_unit")).where("top is not null")
    labels = x.join(rows.where("is_header").select(*KEY, "r"), [*KEY, "r"]).where("v not in ('', '—', '-')").groupBy(*KEY, "c")
    labels = labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s.v), "/").alias("column_label"))
    body = x.join(sheets, KEY).where("r > top")
    share = (F.avg((F.col("v") != "").cast("int")) * (1 - F.avg(F.col("num").isNotNull().cast("int")))).alias("score")
    name = body.where("c < 4").groupBy(*KEY, "c").agg(share).groupBy(*KEY).agg(F.max_by("c", F.struct("score", -F.col("c"))).alias("best"), F.max("score").alias("s"))
    name = name.select(*KEY, F.when(F.col("s") > 0, F.col("best")).otherwise(0).alias("name_c"))
    named_rows = body.join(name, KEY).where("c = name_c").select(*KEY, "r", "name_c", "sheet_unit", F.col("v").alias("indicator")).where("indicator <> ''")
    named_rows = named_rows.join(rows.select(*KEY, "r", "has_num", "whole"), [*KEY, "r"])
    unit_row, emitted = ~F.col("has_num") & F.col("whole").rlike(unit), F.col("has_num")
    seen = order.rowsBetween(W.unboundedPreceding, 0)
    named_rows = named_rows.withColumn("unit", F.coalesce(F.last(F.when(unit_row, F.regexp_extract("whole", unit, 1)), True).over(seen), "sheet_unit", F.lit("")))
    named_rows = named_rows.withColumn("category", F.coalesce(F.last(F.when(unit_row, "").when(~emitted, F.col("indicator")), True).over(seen), F.lit("")))
    first = F.min(F.when(emitted, F.col("r"))).over(W.partitionBy(*KEY))
    root = F.when(emitted & (~F.col("indicator").startswith(child) | (F.col("r") == first)), F.col("indicator"))
    named_rows = named_rows.withColumn("family_root", F.last(root, True).over(seen))
    path = F.when((F.col("category") == "") | (F.col("category") == F.col("indicator")), F.col("indicator")).otherwise(F.concat_ws("/", "category", "indicator"))
    out = x.where("num is not null").join(named_rows.where(emitted), [*KEY, "r"]).where("c <> name_c").join(labels, [*KEY, "c"])
    numbered = ["sheet_no"] if "sheet_no" in cells.columns else []
    return out.select(*KEY, *numbered, (F.col("r") + 1).alias("row"), (F.col("c") + 1).alias("col"), "indicator", path.alias("indicator_path"), "family_root", "column_label", F.col("num").alias("value"), "unit")


def facts_or_failures(cells: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``facts`` of the workbooks whose cells all have a place of their own, and (doc_id, error) of the others."""
    spots = cells.groupBy(*KEY, "r", "c").agg(F.count("*").alias("n"))
    rules = {"cell_without_place": F.col("sheet").isNull() | F.col("r").isNull() | F.col("c").isNull(), "two_cells_in_a_place": F.col("n") > 1}
    failed = checked(spots, rules).where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    return facts(cells.join(failed.select("doc_id"), "doc_id", "left_anti"), **options), failed


def place(facts_: DataFrame) -> tuple[str, str, str]:
    """The columns that order a document's records: the workbook's order where facts have the sheets' numbers, else by sheet name."""
    return ("sheet_no" if "sheet_no" in facts_.columns else "sheet", "row", "col")


def term_hits(facts_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(..., doc_id, term): facts and asks that meet, tier 1 (exact indicator), 2 (path) or 3 (column label).

    With a column asked_sheet that is not null only sheets whose name holds that one's, or is held by it, count."""
    rows = facts_.join(asked, "doc_id")
    if "asked_sheet" in asked.columns:
        own, named = norm(F.col("sheet")), norm(F.col("asked_sheet"))
        rows = rows.where(F.col("asked_sheet").isNull() | F.contains(own, named) | F.contains(named, own))
    term = norm(F.col("term"))
    tier = F.when(F.col("indicator") == term, 1).when(F.contains("indicator_path", term), 2).when(F.col("column_label") == term, 3)
    return rows.withColumn("tier", tier).where("tier is not null")


def lookup(facts_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(q, doc_id, term): the facts of the best tier (exact indicator, path, column label), in order."""
    rows = term_hits(facts_, asked)
    return rows.withColumn("least", F.min("tier").over(W.partitionBy("q", "doc_id", "term"))).where("tier = least").drop("least")


def row_difference(facts_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(q, doc_id, term, col1, col2): value under col2 minus value under col1 in the first hit's row."""
    hits = lookup(facts_, asked.select("q", "doc_id", "term")).where("tier < 3")
    first = hits.groupBy("q").agg(F.min_by(F.struct("doc_id", "sheet", "row"), F.struct("doc_id", *place(facts_)[:2])).alias("p")).select("q", "p.*")
    rows = facts_.join(first, ["doc_id", "sheet", "row"]).join(asked.select("q", "col1", "col2"), "q")
    value = lambda c: F.min_by("value", F.when(F.contains("column_label", c), F.col("col")))
    return rows.groupBy("q").agg((value("col2") - value("col1")).alias("difference"))


def indicator_hits(facts_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(q, ..., doc_id, term): lookups that met an indicator or its path."""
    return lookup(facts_, asked).where("tier < 3")


def lookup_answer(facts_: DataFrame, asked: DataFrame, letters: str = "ABCD") -> DataFrame:
    """asked(q, doc_id, term_no, term, A, B, ...): q, doc_id, address, value, answer by the first term with a hit."""
    first = indicator_hits(facts_, asked).groupBy("q").agg(F.min_by(F.struct("*"), F.struct("term_no", *place(facts_))).alias("h")).select("h.*")
    answer = nearest_option(F.col("value"), {k: F.col(k) for k in letters})
    return first.select("q", "doc_id", cell_address(F.col("row"), F.col("col")).alias("address"), "value", answer.alias("answer"))


def compare_answer(facts_: DataFrame, asked: DataFrame, stock: str = STOCK) -> DataFrame:
    """asked(q, doc_id, letter, term, bases array<string>): the option whose indicator has the largest value.

    Facts whose column label holds a basis come first; stock indicators count only where there is nothing else."""
    basis = F.exists("bases", lambda b: F.contains("column_label", b))
    hits = indicator_hits(facts_, asked).groupBy("q", "letter")
    first = hits.agg(F.min_by(F.struct("indicator", "value"), F.struct((~F.coalesce(basis, F.lit(False))).alias("other"), *place(facts_))).alias("h"))
    rows = first.select("q", "letter", "h.*").withColumn("core", ~F.col("indicator").rlike(stock))
    order = W.partitionBy("q").orderBy(F.desc("core"), F.desc("value"), "letter")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("q", F.col("letter").alias("answer"), "indicator", "value")


def row_span(facts_: DataFrame, asked: DataFrame, letters: str = "ABCD") -> DataFrame:
    """asked(q, doc_id, term, A, B, ...): last minus first column of the first hit's row of two numbers or more
    for which exactly one option is near."""
    hits = indicator_hits(facts_, asked).groupBy("q", "doc_id", "sheet", "row", *letters).agg(F.min("col").alias("hit_col"), F.min(place(facts_)[0]).alias("at"))
    rows = hits.join(facts_.select(*KEY, "row", "col", "value"), [*KEY, "row"])
    rows = rows.groupBy("q", "at", "sheet", "row", "hit_col", *letters).agg((F.max_by("value", "col") - F.min_by("value", "col")).alias("difference"), F.count("*").alias("n"))
    near = within(F.col("difference"), {k: F.col(k) for k in letters})
    rows = rows.where("n > 1").withColumn("near", near).where(F.size("near") == 1)
    order = W.partitionBy("q").orderBy("at", "row", "hit_col")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("q", "row", "difference", F.col("near")[0].alias("answer"))


def pair_answer(facts_: DataFrame, asked: DataFrame, letters: str = "ABCD") -> DataFrame:
    """asked(q, doc_id, term_no, term, A, B, ...): difference or sum of the first records of the first two terms found,
    as an indicator or as a column label."""
    first = lookup(facts_, asked).groupBy("q", "term_no", *letters).agg(F.min_by("value", F.struct(*place(facts_))).alias("value"))
    pairs = first.groupBy("q", *letters).agg(F.array_sort(F.collect_list(F.struct("term_no", "value"))).alias("v")).where(F.size("v") > 1)
    a, b = F.col("v")[0]["value"], F.col("v")[1]["value"]
    return pairs.select("q", a.alias("first"), b.alias("second"), pair_arithmetic(a, b, {k: F.col(k) for k in letters}).alias("answer"))


def table_evidence(facts_: DataFrame, asked: DataFrame, terms: int = 4, each: int = 2) -> DataFrame:
    """asked(q, doc_id, term_no, term): no, text, source, location of the first ``each`` records of the first ``terms`` terms."""
    hits = lookup(facts_, asked.where(F.col("term_no") < terms))
    rank = F.row_number().over(W.partitionBy("q", "term_no").orderBy(*place(facts_)))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= each)
    hits = hits.groupBy("q", "doc_id", "sheet", "row", "col").agg(F.min_by(F.struct("indicator", "family_root", "column_label", "value", "unit", "term_no", "rank"), F.struct("term_no", "rank")).alias("h"))
    no = F.row_number().over(W.partitionBy("q").orderBy("h.term_no", "h.rank"))
    spot = F.concat_ws("!", F.trim("sheet"), cell_address(F.col("row"), F.col("col")))
    root = F.when(F.col("h.family_root") == "", "").otherwise(F.concat(F.lit("("), F.col("h.family_root"), F.lit(")")))
    text = F.concat(spot, F.lit(": "), F.col("h.indicator"), root, F.lit(" ["), F.col("h.column_label"), F.lit("] = "), number_text(F.col("h.value")), F.lit(" "), F.col("h.unit"))
    return hits.select("q", no.alias("no"), F.rtrim(text).alias("text"), F.col("doc_id").alias("source"), spot.alias("location"))


def fact_counts(cells: DataFrame, facts_: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: workbooks, sheets, fact records, and failed workbooks."""
    n = cells.agg(F.count_distinct("doc_id").alias("workbooks"), F.count_distinct("doc_id", "sheet").alias("sheets"))
    rows = n.crossJoin(facts_.agg(F.count("*").alias("records")))  # one row each
    return rows.crossJoin(failed.agg(F.count("*").alias("failed"))) if failed is not None else rows.withColumn("failed", F.lit(0).cast("bigint"))
