"""Readers and writers of the question answering tables, and file hashes."""

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "struct<files:array<struct<path:string,size:bigint,sha256:string>>>"
MAPPING = "num string, orig_name string, ext string, local_path string, zip_path string"
UNITS = "doc_id string, unit_no int, location string, text string"
CELLS = "doc_id string, sheet string, sheet_no int, r int, c int, raw string, num double"
FACTS = "doc_id string, sheet string, row int, col int, indicator string, indicator_path string, family_root string, column_label string, value double, unit string"
QUESTIONS = (
    "id string, question string, option_a string, option_b string, option_c string, option_d string, answer string, answer_text string, "
    "evidence string, file_label string, qa_type string, difficulty string, source_type string"
)


def manifest_files(documents: DataFrame) -> DataFrame:
    """documents(value), each a manifest as one JSON text: path, size, sha256; the last entry of a repeated path counts."""
    rows = documents.select(F.posexplode(F.from_json("value", MANIFEST)["files"]).alias("pos", "f"))
    return rows.groupBy("f.path").agg(F.max_by("f", "pos").alias("f")).select("f.path", "f.size", "f.sha256")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of a manifest file, which is one JSON document."""
    return manifest_files(spark.read.text(path, wholetext=True))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """The file name mapping, an array in one JSON document."""
    return spark.read.option("multiLine", True).schema(MAPPING).json(path)


def digests(files: DataFrame) -> DataFrame:
    """files(path, length, content): local_path, size, actual (SHA-256 in hex)."""
    return files.select(F.col("path").alias("local_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("actual"))


#: Bytes that a task holds of a file.
CHUNK = 8 << 20


def _opened(path: str):
    """A file's bytes as a stream, from the store that its address names; a bare path is a local one."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_stream("/" + re.sub("^(file:)?/+", "", path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def streamed_digests(files: DataFrame) -> DataFrame:
    """files(path), of any size: local_path, size, actual (SHA-256 in hex), error. A task streams its files in chunks, so none has to fit
    a row; a file that cannot be read has an error in place of a digest, for ``split_failures``."""

    def run(frames):
        for frame in frames:
            out = []
            for path in frame["path"]:
                digest, size = hashlib.sha256(), 0
                try:
                    with _opened(path) as stream:
                        while chunk := stream.read(CHUNK):
                            digest.update(chunk)
                            size += len(chunk)
                    out.append((path, size, digest.hexdigest(), None))
                except (OSError, ValueError) as broken:
                    out.append((path, None, None, f"{type(broken).__name__}: {broken}"[:300]))
            yield pd.DataFrame(out, columns=["local_path", "size", "actual", "error"]).astype({"size": "Int64"})

    return files.select("path").mapInPandas(run, "local_path string, size bigint, actual string, error string")


def file_hashes(spark: SparkSession, path: str, whole: int = 1 << 28) -> DataFrame:
    """Digests of every file under path: local_path, size, actual, error. Files of at most ``whole`` bytes are rows of Spark's own reader;
    larger ones, which a row may not hold, are streamed."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = digests(listed.where(F.col("length") <= whole)).withColumn("error", F.lit(None).cast("string"))
    large = listed.where(F.col("length") > whole).select("path")  # no content is read
    return small.unionByName(streamed_digests(large))


def json_rows(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """lines(value), one object each: their rows, and the lines that are not such objects, as line."""
    parsed = lines.where("trim(value) <> ''")
    parsed = parsed.select("value", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("row"))
    failed = parsed.where("row._broken is not null").select(F.col("value").alias("line"))
    return parsed.where("row._broken is null").select("row.*").drop("_broken"), failed


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a file of one object a line, and its broken lines for a list of failures."""
    return json_rows(spark.read.text(path), schema)


def sheet_rows(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """Rows of a question sheet without those that lack an id. ``expected`` rows, or an error."""
    rows = rows.where("id is not null")
    found = rows.count() if expected is not None else None
    if found != expected:
        raise ValueError(f"{found} questions in place of {expected}")
    return rows


def questions(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Questions of a CSV sheet with a header."""
    return sheet_rows(spark.read.schema(QUESTIONS).option("header", True).option("multiLine", True).option("escape", '"').csv(path), expected)


def options(questions_: DataFrame, letters: str = "abcd") -> DataFrame:
    """A row for each option of each question: id, letter, option."""
    each = F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("letter"), F.col(f"option_{k}").alias("option")) for k in letters]))
    return questions_.select("id", each.alias("o")).select("id", "o.letter", "o.option")


def document_units(paragraphs: DataFrame, table_rows: DataFrame) -> DataFrame:
    """paragraphs(doc_id, i, text), table_rows(doc_id, t, r, cells array<string>): the document's units in order.

    Blank paragraphs and rows without text go; paragraphs come first, then rows with their cells joined by a bar."""
    text = F.trim(F.coalesce("text", F.lit("")))
    place = lambda kind, a, b, location: (F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.concat(*location).alias("location"))
    own = paragraphs.select("doc_id", *place(0, F.col("i"), F.lit(0), (F.lit("para"), "i")), text.alias("text")).where("text <> ''")
    trimmed = F.transform("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    rows = table_rows.withColumn("cells", trimmed).where(F.exists("cells", lambda x: x != ""))
    rows = rows.select("doc_id", *place(1, F.col("t"), F.col("r"), (F.lit("tbl"), "t", F.lit("r"), "r")), F.array_join("cells", " | ").alias("text"))
    order = W.partitionBy("doc_id").orderBy("kind", "a", "b")
    return own.union(rows).withColumn("unit_no", F.row_number().over(order) - 1).select("doc_id", "unit_no", "location", "text")


def page_units(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text), pages from 1: a unit for each page with text."""
    rows = pages.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    return rows.select("doc_id", F.col("page").alias("unit_no"), F.concat(F.lit("page"), "page").alias("location"), "text")


def write_facts(facts: DataFrame, path: str, buckets: int = 64) -> None:
    """Facts as Parquet in folders of a hash of doc_id, so that a lookup of some documents reads few files."""
    rows = facts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    rows.repartition("bucket").sortWithinPartitions("doc_id", "sheet", "row", "col").write.partitionBy("bucket").mode("overwrite").parquet(path)


def split_failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the failed ones; the job goes on with the former."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def write_rows(rows: DataFrame, path: str) -> None:
    """Blocks, questions, predictions or error rows as JSON lines, one object a row, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(totals: dict[str, DataFrame], path: str) -> None:
    """A job's summary as one JSON object: under each name the rows of a small table of totals, one for a group at most."""
    rows = {name: [r.asDict(True) for r in df.collect()] for name, df in totals.items()}
    spark = next(iter(totals.values())).sparkSession
    spark.createDataFrame([(json.dumps(rows, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def exit_status(failed: DataFrame, path: str | None = None) -> int:
    """0 without failures, else 1, the failures being written as JSON lines if there is a path."""
    if path is not None:
        write_rows(failed, path)
    return int(not failed.isEmpty())


def checked(rows: DataFrame, rules: dict[str, Column], error: str = "error") -> DataFrame:
    """rows with ``error``: the name of the first rule that a row breaks (its condition holds), or null. A condition that is null counts as broken."""
    broken = F.coalesce(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn(error, broken)
