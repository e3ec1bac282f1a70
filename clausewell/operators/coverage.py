"""Coverage of texts by texts, set-wise: n-grams meet by joins, or in one pass over a text for all that is asked of it, so the work is
linear in both, not their product.

The figures are those of ``functions.text.ngram_coverage`` on each pair."""

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, norm
from ..sources.shared import stored


def pair_coverage(asked: DataFrame, texts: DataFrame, on: list[str], by: list[str], n: int = 4) -> DataFrame:
    """asked(on, a), texts(on, by, t): on, by, a (white space gone, null as empty) and coverage, a row for each distinct a and each
    text of equal ``on``.

    ``on`` and ``by`` together name one text, null as empty. An a shorter than n is in t or not, and an empty one never. Grams
    of texts are made only for the ``on`` that are asked; a text's grams are dealt by themselves too, so a long one is split."""
    own = stored(asked.select(*on, norm(F.coalesce("a", F.lit(""))).alias("a")).distinct().withColumn("_id", F.sha2("a", 256)))
    held = stored(texts.select(*on, *by, norm(F.coalesce("t", F.lit(""))).alias("t")).join(own.select(*on).distinct(), on, "left_semi"))
    pairs = own.join(held.select(*on, *by), on)
    long = own.where(F.length("a") >= n)
    want = long.select(*on, "_id", F.explode(grams(F.col("a"), n)).alias("gram")).groupBy(*on, "_id", "gram").agg(F.count("*").alias("times"))
    has = held.select(*on, *by, F.explode(F.array_distinct(grams(F.col("t"), n))).alias("gram"))
    met = want.join(has, [*on, "gram"]).groupBy(*on, *by, "_id").agg(F.sum("times").alias("_met"))
    short = own.where(F.length("a") < n).join(held, on)
    short = short.select(*on, *by, "_id", F.when((F.length("a") > 0) & F.contains("t", "a"), 1).otherwise(0).cast("bigint").alias("_met"))
    share = F.coalesce("_met", F.lit(0)) / F.greatest(F.length("a") - n + 1, F.lit(1))
    rows = pairs.join(met.unionByName(short), [*on, *by, "_id"], "left")
    return rows.select(*on, *by, "a", share.alias("coverage"))


def parts_coverage(parts: DataFrame, texts: DataFrame, on: str, n: int = 4) -> DataFrame:
    """parts(on, a, ...), texts(on, t, ...), without other columns in common: every pair of equal ``on`` with coverage, null where a or t is.

    A text is read once for all parts of its ``on``, which are few, as a question's are."""
    kept = [c for c in parts.columns if c not in (on, "a")]
    asked = parts.select(on, norm(F.col("a")).alias("a"), *kept).groupBy(on).agg(F.collect_list(F.struct("a", *kept)).alias("_parts"))
    others = [c for c in texts.columns if c not in (on, "t")]
    rows = texts.select(on, *others, norm(F.col("t")).alias("t")).join(asked, on)
    rows = rows.select(on, *others, "_parts", _shares(n)(F.transform("_parts", lambda p: p.a), F.col("t")).alias("_shares"))
    rows = rows.select(on, *others, F.explode(F.arrays_zip("_parts", "_shares")).alias("_x"))
    return rows.select(on, *others, *[F.col(f"_x._parts.{c}").alias(c) for c in kept], F.col("_x._shares").alias("coverage"))


def _shares(n: int):
    """(array of texts, text) -> the coverage of each by the text."""

    def shares(asked: list, text: str | None) -> list:
        if text is None:
            return [None] * len(asked)
        grams = [None if a is None else Counter(a[i : i + n] for i in range(len(a) - n + 1)) for a in asked]
        met = set().union(*filter(None, grams)).intersection(text[i : i + n] for i in range(len(text) - n + 1))
        out = []
        for a, own in zip(asked, grams, strict=True):
            short = a is not None and len(a) < n
            out.append(None if a is None else float(a != "" and a in text) if short else sum(k for g, k in own.items() if g in met) / (len(a) - n + 1))
        return out

    @F.pandas_udf("array<double>")
    def each(asked: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([shares(list(a), t) for a, t in zip(asked, text, strict=True)], dtype=object)

    return each
