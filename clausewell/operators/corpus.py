"""Corpus reconciliation, exact copies and text blocks."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading
from ..sources.readers import checked, split_failures


def verify(mapping: DataFrame, manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """mapping(doc_id, zip_path, local_path) against manifest(path, size, sha256) and hashes(local_path, actual)."""
    key = F.regexp_replace("zip_path", "^.*?data/", "")
    rows = mapping.withColumn("path", key).join(manifest, "path", "left").join(hashes, "local_path", "left")
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok")
        .when(F.col("sha256").isNotNull(), "hash_mismatch").otherwise("not_in_manifest")
    )
    more = ["local_path", *(c for c in ("type",) if c in mapping.columns)]
    return rows.select("doc_id", "path", F.col("size").alias("manifest_size"), F.col("actual").alias("sha256"), status.alias("status"), *more)


def problems(verified: DataFrame) -> DataFrame:
    """doc_id, issue and path of what is not ok: the local path, or the manifest's key where the manifest lacks it."""
    where = F.when(F.col("status") == "not_in_manifest", F.col("path")).otherwise(F.col("local_path"))
    return verified.where("status <> 'ok'").select("doc_id", F.col("status").alias("issue"), where.alias("path"))


def verify_counts(verified: DataFrame) -> DataFrame:
    """verified(status, type): documents, those ok and others, in all (kind 'all') and by type."""
    kinds = F.explode(F.array(F.lit("all"), F.col("type")))
    rows = verified.select("status", kinds.alias("kind")).groupBy("kind")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("other"))


def exact_copies(files: DataFrame, path: str, sha: str) -> DataFrame:
    """One row for each content: the canonical path (the shortest as text, then the smallest) and the number of copies."""
    first = F.min_by(path, F.struct(F.length(F.col(path).cast("string")), F.col(path)))
    return files.groupBy(F.col(sha).alias("sha256")).agg(first.alias("canonical"), F.count("*").alias("copies"))


def starts(units: Column, cut: Callable[[Column], Column], limit: int = 420, least: int = 120) -> Column:
    """The places (from 1) in an array of texts where blocks begin: a text for which ``cut`` holds closes a block of
    over ``least`` characters, and a block does not grow over ``limit``. No shuffle; linear in a document's units: a lambda that
    carries a growing array copies it at each step, so a walk over the sizes gives the places."""

    @F.pandas_udf("array<int>")
    def walk(sizes: pd.Series, marks: pd.Series) -> pd.Series:
        def places(own, marked):
            out, size = [], 0
            for i, (n, cut_) in enumerate(zip(own, marked, strict=True)):
                if not out or size > 0 and (cut_ and size > least or size + n > limit):
                    out.append(i + 1)
                    size = 0
                size += n
            return out

        return pd.Series([None if a is None else places(a.tolist(), b.tolist()) for a, b in zip(sizes, marks, strict=True)], dtype=object)

    return walk(F.transform(units, F.length), F.transform(units, lambda u: F.coalesce(cut(u), F.lit(False))))


def fold(docs: DataFrame, units: str, cut: Callable[[Column], Column] = heading, **options) -> DataFrame:
    """docs with an array column of (unit_no, location, text) -> the other columns, block_no, text, n_units and location.

    Texts of a block are joined by line ends; its location is that of its units, or first-last. A document is one
    row, and nothing is shuffled."""
    rest = [c for c in docs.columns if c != units]
    rows = docs.where(F.size(units) > 0).withColumn("_at", starts(F.transform(units, lambda u: u.text), cut, **options))
    ends = F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size(units) + 1))
    chunks = F.zip_with("_at", ends, lambda a, b: F.slice(units, a, b - a))
    rows = rows.select(*rest, F.posexplode(chunks).alias("block_no", "_own"))
    first, last = F.element_at("_own", 1).location, F.element_at("_own", -1).location
    return rows.select(
        *rest, "block_no", F.array_join(F.transform("_own", lambda u: u.text), "\n").alias("text"), F.size("_own").alias("n_units"),
        F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last)).alias("location"),
    )


def collected(units: DataFrame) -> DataFrame:
    """units(doc_id, unit_no, location, text) as one row a document: doc_id, units in order."""
    return units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "location", "text"))).alias("units"))


# Patterns of secrets, upper or lower case, under labels.
SECRETS = {
    "model key": r"sk-[A-Za-z0-9\-_.]{20,}",
    "api key": r"api[_-]?key\s*[:=]\s*['\"][^'\"]{8,}",
    "credential": r"(token|password|passwd|secret)\s*[:=]\s*['\"][^'\"]{8,}",
}


def secret_lines(docs: DataFrame, text: str = "text", patterns: dict[str, str] = SECRETS, allowed: DataFrame | None = None) -> DataFrame:
    """Every match of the patterns: doc_id, label, found (first 60 characters); documents of allowed(doc_id) are left out."""
    docs = docs if allowed is None else docs.join(allowed.select("doc_id"), "doc_id", "left_anti")
    each = [F.struct(F.lit(k).alias("label"), F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)).alias("m")) for k, p in patterns.items()]
    rows = docs.select("doc_id", F.explode(F.array(*each)).alias("h")).select("doc_id", "h.label", F.explode("h.m").alias("m"))
    return rows.select("doc_id", "label", F.substring("m", 1, 60).alias("found"))


def secret_verdict(found: DataFrame) -> DataFrame:
    """One row: the number of matches, and passed, whether there are none."""
    return found.agg(F.count("*").alias("n")).select("n", (F.col("n") == 0).alias("passed"))


def cuts(sizes: Column, limit: int, overlap: int, longest: int) -> Column:
    """Where pieces of a text lie, as array<struct<a, b>> of places from 0, given the sizes of its sentences.

    Sentences are packed while a piece stays within ``limit``; the next piece begins ``overlap`` characters earlier. A piece
    over ``longest`` is cut every limit - overlap characters into pieces of ``limit``, until the rest is not. Linear in the sentences."""
    piece = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def walk(sizes: pd.Series) -> pd.Series:
        def spans(own):
            out, a, b = [], 0, 0
            for n in own:
                if b > a and b - a + n > limit:
                    out.append({"a": a, "b": b})
                    a = max(a, b - overlap)
                b += n
            return [*out, {"a": a, "b": b}]

        return pd.Series([None if x is None else spans(x.tolist()) for x in sizes], dtype=object)

    packed = walk(sizes)
    step = limit - overlap
    more = lambda p: F.greatest(F.lit(0), F.ceil((p.b - p.a - longest) / step)).cast("int")
    part = lambda p, k: piece(p.a + k * step, F.when(k < more(p), p.a + k * step + limit).otherwise(p.b))
    return F.flatten(F.transform(packed, lambda p: F.transform(F.sequence(F.lit(0), more(p)), lambda k: part(p, k))))


def split_long(blocks: DataFrame, limit: int = 420, overlap: int = 60, factor: float = 1.6) -> DataFrame:
    """blocks(text, ...) -> their other columns, piece_no and piece: texts over ``limit`` characters cut between sentences, with
    an overlap. Column arithmetic on the sentences' lengths; null texts have no pieces."""
    rest = [c for c in blocks.columns if c != "text"]
    places = cuts(F.transform(F.split("text", "(?<=[。;；])"), F.length), limit, overlap, int(factor * limit))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.length("text").alias("b")))
    rows = blocks.where("text is not null").select(*rest, "text", F.posexplode(F.when(F.length("text") > limit, places).otherwise(whole)).alias("piece_no", "_p"))
    return rows.select(*rest, "piece_no", F.substring(F.col("text"), F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a")).alias("piece"))


# File types of text documents, and their kinds.
KINDS = {"doc": "word", "docx": "word", "pdf": "pdf"}


def text_blocks(docs: DataFrame, cut: Callable[[Column], Column] = heading) -> DataFrame:
    """docs(doc_id, orig_name, type, units array<struct<unit_no, location, text>>) -> block_id (document-block-piece), doc_id,
    orig_name, source_type, location, n_units, text. Documents of other types than KINDS have no blocks."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("type"))
    rows = docs.where(F.col("type").isin(*KINDS)).select("doc_id", "orig_name", kind.alias("source_type"), "units")
    pieces = split_long(fold(rows, "units", cut))
    return pieces.select(F.concat_ws("-", "doc_id", "block_no", "piece_no").alias("block_id"), "doc_id", "orig_name", "source_type", "location", "n_units", F.col("piece").alias("text"))


def text_blocks_or_failures(docs: DataFrame, cut: Callable[[Column], Column] = heading) -> tuple[DataFrame, DataFrame]:
    """``text_blocks`` of the documents that can be cut, and (doc_id, error) of those of a text kind that cannot; the others go on."""
    some = docs.where(F.col("type").isin(*KINDS))
    rules = {"no_units": F.col("units").isNull(), "unit_without_text": F.exists("units", lambda u: u.isNull() | u.text.isNull()), "unit_without_place": F.exists("units", lambda u: u.location.isNull())}
    good, failed = split_failures(checked(some, rules))
    return text_blocks(good, cut), failed.select("doc_id", "error")


def block_counts(docs: DataFrame, blocks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: text documents of docs(doc_id, type), blocks, and failed documents."""
    n = docs.agg(F.count_if(F.col("type").isin(*KINDS)).alias("docs"))
    rows = n.crossJoin(blocks.agg(F.count("*").alias("blocks")))  # one row each
    return rows.crossJoin(failed.agg(F.count("*").alias("failed"))) if failed is not None else rows.withColumn("failed", F.lit(0).cast("bigint"))
