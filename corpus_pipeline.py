"""A training corpus from ``documents``: quality, near-duplicates, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns of docs. No stage samples or caps its rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewell.llm import decontaminate, mixing, quality, secrets, simhash
from clausewell.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), least=0.3)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return simhash.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in shards that are shuffled locally."""
    return mixing.shuffled(mixing.mixed(docs))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as long as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
]

#: A network, automata and components are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
