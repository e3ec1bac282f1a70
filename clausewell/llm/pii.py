"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Validated values are permuted within their own format, so that equal values stay equal across documents:
card numbers of 13 to 19 digits that satisfy the check digit (the new one does too), calendar dates
(YYYY-MM-DD of 1900 to 2099, again a date of those years), IPv4 addresses, telephone numbers with a
country code (punctuation and the country code stay) and the local parts of mail addresses. What does
not validate stays; where a whole run of digits is no card, the cards from separator to separator within it are
taken. The round function is SHA-256 of key, format, round and half; in strings each digit
or letter moves within its own class, so the place of every other character is kept.

No shuffle and no Python: texts without ``@`` and digits are passed by, a pattern splits the others, the pieces it takes
are permuted and the text is put together again. Values inside one another are taken leftmost first, in the order of ``FORMATS``.

Defined results: a null text stays null with zero counts, texts without values stay as they are,
repeated rows get equal pseudonyms, an empty table an empty result; other columns pass through, and count columns get
underscores where their names are taken.
The key is a parameter: keep a real one outside the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free, fresh, table

# The formats.
FORMATS = ("email", "ip", "date", "phone", "card")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
# Digits with single blanks or hyphens between them, as far as they go or up to another value; cards are read within it.
RUN = rf"(?<!\d)\d(?:(?![ -](?:{'|'.join(PATTERNS[k] for k in FORMATS[:3])}))[ -]?\d){{12,}}+(?!\d)"
# A mail address is tried where its run of characters begins or the value before it ended, not at each of its characters.
MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@" + PATTERNS["email"].partition("@")[2]
ANY = "|".join(f"(?:{x})" for x in (MAIL, *(PATTERNS[k] for k in FORMATS[1:4]), RUN))
# Every value has one of these, and most texts have none.
HINT = "[@0-9]"
ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _moved(s: Column, stream: Column, sign: int) -> Column:
    """Each letter or digit of s moved within its class by the bytes of a hex stream, used round and round."""
    by = lambda i: F.conv(F.substring(stream, F.pmod((i - 1) * 2, F.lit(64)).cast("int") + 1, F.lit(2)), 16, 10).cast("int") * sign

    def one(c, i):
        out = c
        for letters in (DIGITS, LOWER, UPPER):
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + by(i + 1), F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.split(s, ""), one), ""))


def permuted(s: Column, key: str, kind: str, back: bool = False) -> Column:
    """s permuted among the strings with the same classes of characters in the same places; back undoes it."""
    sign, rounds = -1 if back else 1, F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def halves(x):
        half = F.floor(F.length(x) / 2).cast("int")
        return F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))

    def turn(acc, r):
        n = F.length(acc.a) + F.length(acc.b)
        stream = lambda x: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), n.cast("string"), x), 256)
        a = F.when(r % 2 == 0, bound(stream(acc.b), lambda st: _moved(acc.a, st, sign))).otherwise(acc.a)
        b = F.when(r % 2 == 1, bound(stream(acc.a), lambda st: _moved(acc.b, st, sign))).otherwise(acc.b)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(rounds, bound(s, halves), turn, lambda acc: F.concat(acc.a, acc.b))


def _number(x: Column, n: tuple[int, int], limit: int, key: str, kind: str, back: bool = False) -> Column:
    """x of 0..limit-1 permuted there: Feistel over n[0] x n[1] >= limit, walked on until it is in range."""

    def once(v):
        def turn(acc, r):
            f = lambda h: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), h.cast("string")), 256), 1, 15), 16, 10).cast("bigint")
            sign = -1 if back else 1
            a = F.when(r % 2 == 0, F.pmod(acc.a + f(acc.b) % n[0] * sign, F.lit(n[0]).cast("bigint"))).otherwise(acc.a)
            b = F.when(r % 2 == 1, F.pmod(acc.b + f(acc.a) % n[1] * sign, F.lit(n[1]).cast("bigint"))).otherwise(acc.b)
            return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

        start = F.struct(F.floor(v / n[1]).cast("bigint").alias("a"), F.pmod(v, F.lit(n[1]).cast("bigint")).cast("bigint").alias("b"))
        rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
        return F.aggregate(rounds, start, turn, lambda acc: acc.a * n[1] + acc.b)

    x = x.cast("bigint")
    if n[0] * n[1] == limit:
        return once(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(limit).cast("bigint"), lambda v, i: F.when((i > 1) & (v < limit), v).otherwise(once(F.when(i == 1, x).otherwise(v))))
    return walk


def check_digit(digits: Column) -> Column:
    """The digit that completes digits to a number with a valid Luhn sum."""

    def total(x):
        twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
        each = F.transform(F.split(x, ""), lambda c, i: F.when((F.length(x) - 1 - i) % 2 == 0, twice(c.try_cast("int"))).otherwise(c.try_cast("int")))
        return F.pmod(-F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))), F.lit(10)).cast("string")

    return bound(digits, total)


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def fill(own):
        def put(acc, c):
            d = c.rlike("^[0-9]$")
            return F.struct(F.concat(acc.out, F.when(d, F.substring(own, acc.at, F.lit(1))).otherwise(c)).alias("out"), (acc.at + d.cast("int")).alias("at"))

        return F.aggregate(F.split(shape, ""), start, put, lambda acc: acc.out)

    return bound(digits, fill)


def valid_card(digits: Column) -> Column:
    """Whether 13 to 19 digits end in their check digit."""
    return F.length(digits).between(13, 19) & (F.substring(digits, -1, 1) == check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)))


def kind_of(value: Column) -> Column:
    """The format that a value validates in, or null."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.forall(F.split(value, r"\."), lambda o: o.rlike(r"^(0|[1-9]\d{0,2})$") & (F.length(o) <= 3) & (F.coalesce(o.try_cast("int"), F.lit(999)) < 256))
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(whole("email"), "email").when(whole("ip") & octets, "ip").when(whole("date") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), "date")
        .when(whole("phone") & (F.length(digits) >= 8), "phone").when(whole("card") & bound(digits, valid_card), "card")
    )


def _read(run: Column) -> Column:
    """A run of digits as pieces (value, kind): from the left the longest valid cards from separator to separator, and the rest.

    The walk over the groups of digits carries only the places of the cards found so far; texts are cut out after it."""
    piece = lambda value, kind: F.struct(value.alias("value"), kind.cast("string").alias("kind"))
    joined = lambda groups, a, b: F.array_join(F.slice(groups, a, F.greatest(b - a + 1, F.lit(0))), "")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def cards(groups):
        def turn(acc, i):
            valid = lambda j: F.exists(F.array(F.regexp_replace(joined(groups, i, j), "[^0-9]", "")), valid_card)
            ends = F.filter(F.sequence(F.least(i + 18, F.size(groups)), i, F.lit(-1)), valid)
            taken = lambda j: F.struct(F.when(j > 0, F.concat(acc.out, F.array(F.struct(i.alias("a"), j.alias("b"))))).otherwise(acc.out).alias("out"), F.when(j > 0, j + 1).otherwise(i + 1).alias("at"))
            return F.when(i < acc.at, acc).otherwise(bound(F.coalesce(F.get(ends, F.lit(0)), F.lit(0)), taken))

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), F.struct(none.alias("out"), F.lit(1).alias("at")), turn, lambda acc: acc.out)

    def pieces(groups):
        def cut(found):
            def one(c, k):
                before = F.when(k > 0, F.get(found, k - 1).b).otherwise(0)
                lead = F.regexp_extract(F.get(groups, c.a - 1), "^[ -]?", 0)
                card = joined(groups, c.a, c.b)
                return F.array(piece(F.concat(joined(groups, before + 1, c.a - 1), lead), F.lit(None)), piece(F.substring(card, F.length(lead) + 1, F.length(card)), F.lit("card")))

            last = F.when(F.size(found) > 0, F.element_at(found, -1).b).otherwise(0)
            return F.concat(F.flatten(F.transform(found, one)), F.array(piece(joined(groups, last + 1, F.size(groups)), F.lit(None))))

        return bound(cards(groups), cut)

    return bound(F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0)), pieces)


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a value of a format; back gives the value of a pseudonym."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    local = F.regexp_extract(value, "^([^@]*)@", 1)
    email = F.concat(permuted(local, key, "email", back), F.substring(value, F.length(local) + 1, F.length(value)))
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = _refilled(value, bound(permuted(head, key, "card", back), lambda new: F.concat(new, check_digit(new))))
    code = F.regexp_extract(value, r"^\+\d{1,3}", 0)
    own = F.regexp_replace(F.substring(value, F.length(code) + 1, F.length(value)), "[^0-9]", "")
    phone = F.concat(code, _refilled(F.substring(value, F.length(code) + 1, F.length(value)), permuted(own, key, "phone", back)))
    octets = F.split(value, r"\.")
    part = lambda i: F.get(octets, F.lit(i)).cast("bigint")
    x = _number(part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3), (65536, 65536), 1 << 32, key, "ip", back)
    ip = F.element_at(F.transform(F.array(x), lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / d), F.lit(256)).cast("int").cast("string") for d in (16777216, 65536, 256, 1)])), 1)
    # 73,049 days from 1900-01-01 to 2099-12-31; 271 x 270 is the next product of two near numbers
    day = _number(F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")), (271, 270), 73049, key, "date", back)
    date = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd")
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date).when(kind == "phone", phone).when(kind == "card", card).otherwise(value)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = "change-me", counts: tuple[str, ...] | None = None) -> DataFrame:
    """docs with the validated values in the text replaced, and a count for each of FORMATS (named by counts)."""
    names = tuple(free(docs.columns, n) for n in counts) if counts else tuple(fresh(docs, f"n_{k}") for k in FORMATS)
    hits, made = fresh(docs, "pii_hits"), fresh(docs, "pii_made")
    t = col(text)
    rows = docs.withColumn(hits, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    known = F.transform(col(hits), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    pieces = F.transform(known, lambda x: F.when(x.kind.isNull() & x.value.rlike(r"^\d[\d -]{12,}$"), _read(x.value)).otherwise(F.array(x)))
    rows = rows.withColumn(made, pieces)
    new = F.transform(col(made), lambda p: F.array_join(F.transform(p, lambda x: F.when(x.kind.isNull(), x.value).otherwise(pseudonym(x.value, x.kind, key))), ""))
    joined = F.array_join(F.flatten(F.zip_with(F.split(t, ANY, -1), new, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    text_ = F.when(F.exists(made, lambda p: F.exists(p, lambda x: x.kind.isNotNull())), joined).otherwise(t)
    count = lambda kind: F.size(F.filter(F.flatten(made), lambda x: x.kind == kind)).cast("bigint")
    n = [count(k).alias(name) for k, name in zip(FORMATS, names, strict=True)]
    return rows.select(*[text_.alias(c) if c == text else col(c) for c in docs.columns], *n)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with pseudonyms in its text, and how many of each format."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, counts=tuple(f"n_{k}" for k in FORMATS))
