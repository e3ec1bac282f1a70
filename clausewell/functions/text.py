"""Scalar text functions as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: all white space of Unicode, as in Python.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"


def norm(s: Column) -> Column:
    """s without any white space."""
    return F.regexp_replace(s, SPACE, "")


def clean_title(s: Column) -> Column:
    """norm, without a file kind in brackets."""
    return F.regexp_replace(norm(s), r"(?i)[（(](?:pdf|word|excel|docx|doc|xlsx|xls)[）)]", "")


def stem(name: Column) -> Column:
    """A file name without extension (letters and digits), leading number and white space."""
    return norm(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"^\d+_", ""))


def half_width(s: Column) -> Column:
    return F.translate(s, "０１２３４５６７８９", "0123456789")


def number(s: Column) -> Column:
    """A plain decimal number, thousands separators and outer white space dropped, or null."""
    t = F.regexp_replace(half_width(F.regexp_replace(s, f"^{SPACE}|{SPACE}$", "")), "[,，]", "")
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))


def number_text(x: Column) -> Column:
    """A number in plain decimal digits, six after the point at most."""
    return F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def grams(s: Column, n: int = 4) -> Column:
    """All runs of n characters. The text is taken apart once: taking each run out of it by its place would be quadratic, as
    places in UTF-8 are found by counting."""

    def runs(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), ""))

    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(F.transform(F.array(F.split(s, "")), runs)[0])


def ngram_coverage(a: Column, b: Column, n: int = 4) -> Column:
    """Share of a's n-grams, repeats counted, that b contains; short a: 1 if it is in b and not empty.

    The pair is bound as a lambda variable so that both texts are normalised once, not once for each n-gram."""

    def share(pair: Column) -> Column:
        x, y = pair.x, pair.y
        g = grams(x, n)
        short = F.when((F.length(x) > 0) & F.contains(y, x), 1.0).otherwise(0.0)
        return F.when(F.length(x) < n, short).otherwise(F.size(F.filter(g, lambda t: F.contains(y, t))) / F.size(g))

    return F.transform(F.array(F.struct(norm(a).alias("x"), norm(b).alias("y"))), share)[0]


def clauses(option: Column) -> Column:
    parts = F.filter(F.split(option, "[;；。]"), lambda x: norm(x) != "")
    return F.when(F.size(parts) == 0, F.array(option)).otherwise(parts)


def cell_address(row: Column, column: Column) -> Column:
    """Spreadsheet address of 1-based places, to column ZZZ."""
    letter = lambda k: F.char(F.lit(65) + k % 26)
    c = column - 1
    third = F.when(c >= 702, letter(F.floor((c - 702) / 676))).otherwise("")
    second = F.when(c >= 26, letter(F.floor((c - 26) / 26))).otherwise("")
    return F.concat(third, second, letter(c), row.cast("string"))


# Fixed value: what the first line of a clause begins with.
HEADING = (
    r"第[一二三四五六七八九十百千\d]+[章节条款项]|附录|附件|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d{1,2}\."
)


def heading(s: Column, pattern: str = HEADING) -> Column:
    """Whether a text, blanks within its lines gone, begins a clause."""
    return F.regexp_replace(s, r"[ \t\r\f\x0B]+", "").rlike(f"^(?:{pattern})")


def _found(s: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))


def question_title(question: Column) -> Column:
    """The first title in book marks, or null."""
    return _found(question, "《([^》]+)》")


def question_sheet(question: Column) -> Column:
    """The sheet that a question names, without punctuation and unpaired closing brackets at its end, or null."""

    def unpaired(s: Column, opening: str, closing: str) -> Column:
        count = lambda mark: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))
        at_end = F.length(s) - F.length(F.regexp_replace(s, f"[{closing}]+$", ""))
        return F.substring(s, F.lit(1), F.length(s) - F.least(at_end, F.greatest(count(closing) - count(opening), F.lit(0))))

    s = F.regexp_replace(_found(question, r"工作表\s*[:：]\s*(\S+)"), "[，。;；、.]+$", "")
    return unpaired(unpaired(s, "（", "）"), "(", ")")


def question_terms(question: Column) -> Column:
    """All strings of 2 to 30 characters in quotation marks."""
    return F.regexp_extract_all(question, F.lit('[“"]([^”"]{2,30})[”"]'), F.lit(1))


def difference_terms(question: Column) -> Column:
    """(row, col1, col2) of a question on a row's change from one column to another, or null."""
    pattern = '[“"]([^”"]+)[”"]从[“"]([^”"]+)[”"]到[“"]([^”"]+)[”"]'
    parts = F.struct(*[F.regexp_extract(question, pattern, k).alias(n) for k, n in enumerate(("term", "col1", "col2"), 1)])
    return F.when(question.rlike(pattern), parts)


def evidence_cells(text: Column) -> Column:
    """Cell addresses that a gold evidence names."""
    return F.array_union(F.regexp_extract_all(norm(text), F.lit(r"单元格[：:]([A-Z]+\d+)"), F.lit(1)), F.regexp_extract_all(norm(text), F.lit(r"[（(]([A-Z]+\d{1,3})[)）]"), F.lit(1)))


def evidence_numbers(text: Column) -> Column:
    """Values that a gold evidence states."""
    held = [F.regexp_extract_all(norm(text), F.lit(p), F.lit(1)) for p in (r"原始值[：:](-?[\d.]+)", r"=(-?\d[\d.]*)[（(]")]
    return F.array_compact(F.transform(F.array_union(*held), lambda x: x.try_cast("double")))


def statements(text: Column, least: int = 8) -> Column:
    """Statements of a gold evidence of ``least`` characters or more, white space gone."""
    return F.filter(F.split(norm(text), "[;；]"), lambda x: F.length(x) >= least)
