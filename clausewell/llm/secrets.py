"""Secret scanning: three base patterns, and character Markov models for random strings. DataFrame functions only.

Two first-order Markov chains over the characters of ``ALPHABET`` are counted from labelled samples: random
strings (the digests of a hash, in the alphabets that keys are written in, and what the base patterns find in the
documents) against ordinary identifiers (all words of the documents outside base matches). A candidate, a run of
``min_length`` characters or more, is a secret when the mean log-likelihood ratio of its transitions
exceeds ``threshold``. The model is len(ALPHABET)^2 numbers, whatever the input; it is counted over all documents, summed
within each task before anything is shuffled.

Scanning needs no shuffle: offsets come from the lengths of what a pattern leaves and what it takes, in code points.

Defined results: a null text is scanned as an empty one and stays null; an empty table trains on the
random side and uniform identifiers; repeated rows are each scanned, ids are not read; other columns pass through under
any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
SPAN = "array<struct<start:int,end:int,kind:int>>"


def found(text: Column, pattern: str, kind: int, keep=None, chunk: int = 64) -> Column:
    """Spans of the leftmost non-overlapping matches, those only for which keep(match) holds.

    Matches are laid out ``chunk`` at a time and the chunks one after another, so the work stays near the number of matches."""
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc, pair):
        a = acc.at + F.length(pair.gap)
        b = a + F.length(pair.hit)
        span = F.array(F.struct(a.alias("start"), b.alias("end"), F.lit(kind).alias("kind")))
        good = pair.hit.isNotNull() & (F.lit(True) if keep is None else keep(pair.hit))
        return F.struct(F.coalesce(b, a).alias("at"), F.when(good, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    def lay(acc, part):
        return F.struct((acc.at + part.at).alias("at"), F.concat(acc.starts, F.array(acc.at)).alias("starts"))

    def laid_out(pairs):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / chunk).cast("int")), lambda k: F.slice(pairs, k * chunk + 1, chunk))
        return F.transform(chunks, lambda c: F.aggregate(c, start, add))

    def joined(parts):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, zero, lay, lambda acc: acc.starts)
        moved = lambda s, o: F.struct((s.start + o).alias("start"), (s.end + o).alias("end"), s.kind.alias("kind"))
        return F.flatten(F.zip_with(parts, starts, lambda p, o: F.transform(p.spans, lambda s: moved(s, o))))

    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), bind(bind(pairs, laid_out), joined)).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    return [found(text, ASSIGN, 0, value), found(text, ACCESS, 1), found(text, HEX, 2)]


def transitions(strings: DataFrame, s: str) -> DataFrame:
    """(label, pair, n): how often each two characters of ALPHABET follow one another in strings(label, s).

    Equal strings are counted first, within tasks and then over all, so only distinct ones are taken apart."""
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(col(s), i, F.lit(2)))
    each = strings.where(F.length(s) > 1).groupBy("label", s).agg(F.count("*").alias("times"))
    rows = each.select("label", "times", F.explode(grams).alias("pair"))
    return rows.groupBy("label", "pair").agg(F.sum("times").alias("n")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))


def train(docs: DataFrame, text: str = "text", random_strings: int = 4000) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of the transitions, in the order of ALPHABET x ALPHABET, from all documents."""
    texts = docs.select(F.coalesce(col(text), F.lit("")).alias("t"))
    spark = docs.sparkSession
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    made = spark.range(random_strings).select(F.explode(F.array(
        digest("a"), F.upper(digest("b")), F.base64(F.unhex(digest("c"))), F.translate(F.base64(F.unhex(digest("d"))), "+/=", "-_"),
        F.regexp_replace(F.base64(F.unhex(digest("e"))), "[^A-Za-z0-9]", ""), F.regexp_replace(F.upper(F.base64(F.unhex(digest("f")))), "[^A-Z0-9]", ""),
    )).alias("s"))
    plain, hits = F.col("t"), []
    for pattern, group in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0)):
        hits.append(F.regexp_extract_all(plain, F.lit(pattern), F.lit(group)))
        plain = F.regexp_replace(plain, pattern, " ")
    given = F.transform(F.filter(F.concat(*hits), lambda s: F.length(s) >= 6), lambda s: F.struct(F.lit(1).alias("label"), s.alias("s")))
    ordinary = F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0)), lambda s: F.struct(F.lit(0).alias("label"), s.alias("s")))
    strings = texts.select(F.explode(F.concat(given, ordinary)).alias("x")).select("x.label", "x.s")
    counts = transitions(strings.unionByName(made.withColumn("label", F.lit(1))), "s")
    n = [[1.0] * len(ALPHABET) ** 2 for _ in range(2)]
    for r in counts.collect():  # at most 2 x len(ALPHABET)^2 rows
        n[r.label][ALPHABET.index(r.pair[0]) * len(ALPHABET) + ALPHABET.index(r.pair[1])] += r.n
    size = len(ALPHABET)
    of = [[sum(side[a * size : (a + 1) * size]) for a in range(size)] for side in n]
    return [math.log(n[1][k] / of[1][k // size]) - math.log(n[0][k] / of[0][k // size]) for k in range(size * size)]


def ratio(s: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of s, which has characters of ALPHABET alone."""
    table_ = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1))) - 1
    each = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.get(table_, at(i) * len(ALPHABET) + at(i + 1)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.length(s) - 1)


def all_spans(text: Column, model: list[float], min_length: int = 20, threshold: float = 0.5) -> Column:
    """Base spans and Markov spans of a text that is not null, by start and kind."""
    markov = found(text, CANDIDATE % min_length, 3, lambda hit: ratio(hit, model) > threshold)
    return F.array_sort(F.concat(*base_spans(text), markov), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.kind - b.kind))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start, s.end)), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", model: list[float] | None = None, **options) -> DataFrame:
    """docs with every span (base or Markov) in the text replaced by mark; overlapping spans by one mark."""
    spans = fresh(docs, "secret_spans")
    t = F.coalesce(col(text), F.lit(""))
    rows = docs.withColumn(spans, all_spans(t, model or train(docs, text), **options))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, s):
        fore = F.concat(acc.out, F.substring(col(text), acc.at + 1, s.start - acc.at), F.lit(mark))
        return F.struct(F.when(s.start >= acc.at, fore).otherwise(acc.out).alias("out"), F.greatest(acc.at, s.end).alias("at"))

    clean = F.aggregate(col(spans), start, put, lambda acc: F.concat(acc.out, F.substring(col(text), acc.at + 1, F.length(col(text)))))
    new = F.when(col(text).isNotNull() & (F.size(col(spans)) > 0), clean).otherwise(col(text))
    return rows.select(*[new.alias(c) if c == text else col(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", all_spans(F.coalesce("text", F.lit("")), train(docs)).alias("all"))
    n = lambda kind: F.size(F.filter("all", lambda s: s.kind == kind)).cast("bigint")
    return rows.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(told(F.filter("all", lambda s: s.kind < 3)), 256).alias("base_sha256"), told(F.col("all")).alias("spans"),
    )
