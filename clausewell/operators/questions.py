"""Question sets: labels to documents, out-of-corpus questions, type repair of a split, samples."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm
from ..sources.shared import stored
from .match import best_common, best_names, located


def match_labels(labels: DataFrame, names: DataFrame, least: int = 15) -> DataFrame:
    """labels(label_id, label, label_ext), names(name_id, name, ext): label_id, name_id, stage.

    Stage 1: the best name that holds the label. Stage 2, for the others: the longest common substring of ``least``
    characters or more, the smallest name_id of a tie. Labels that neither finds are absent."""
    one = stored(best_names(labels, names))
    rest = labels.join(one, "label_id", "left_anti")
    two = best_common(rest.select(F.col("label_id").alias("a_id"), F.col("label").alias("s")), names.select(F.col("name_id").alias("b_id"), F.col("name").alias("s")), least)
    two = two.select(F.col("a_id").alias("label_id"), F.col("b_id").alias("name_id"))
    return one.withColumn("stage", F.lit(1)).union(two.withColumn("stage", F.lit(2)))


def label_issues(labels: DataFrame, names: DataFrame, matched: DataFrame) -> DataFrame:
    """label_id, issue: labels without a name, and those whose name does not hold them (repaired cuts)."""
    rows = labels.select("label_id", "label").join(matched, "label_id", "left").join(names.select("name_id", "name"), "name_id", "left")
    issue = F.when(F.col("name_id").isNull(), "unmatched").when(~F.contains("name", "label"), "repaired")
    return rows.select("label_id", issue.alias("issue")).where("issue is not null")


def absent_topics(topics: DataFrame, names: DataFrame) -> DataFrame:
    """topics(topic_id, topic, question) whose normalised words are in no name."""
    held = located(topics.select("topic_id", norm(F.col("topic")).alias("title")), names)
    return topics.join(held, "topic_id", "left_anti")


def outside_questions(
    titles: DataFrame, kept_titles: DataFrame, topics: DataFrame, kept_topics: DataFrame, forms: tuple[str, ...], prefix: str = "S5-"
) -> DataFrame:
    """titles(title_id, title) and topics(topic_id, topic, question), numbered from 1: id, question, kind, topic, kept.

    ``forms`` are questions with {} for the title, taken in turn by a title's own number, whether or not others before it are
    kept; rejected rows have no question."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.pmod(F.col("title_id") - 1, F.lit(len(forms))) + 1).cast("int"))
    name = lambda letter, k: F.format_string(f"{prefix}{letter}%02d", k)
    a = titles.join(kept_titles.select("title_id", F.lit(True).alias("kept")), "title_id", "left")
    a = a.select(name("D", "title_id").alias("id"), F.replace(form, F.lit("{}"), F.col("title")).alias("question"), F.lit("title").alias("kind"), F.col("title").alias("topic"), "kept")
    b = topics.join(kept_topics.select("topic_id", F.lit(True).alias("kept")), "topic_id", "left")
    b = b.select(name("T", "topic_id").alias("id"), "question", F.lit("natural").alias("kind"), "topic", "kept")
    rows = a.unionByName(b).withColumn("kept", F.coalesce("kept", F.lit(False)))
    return rows.withColumn("question", F.when(F.col("kept"), F.col("question")))


def kind_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("kind").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"))


def repair_types(rows: DataFrame, rounds: int = 5) -> DataFrame:
    """rows(grp, qa_type, split), split being dev or test: in each of ``rounds`` one type that a side lacks moves there
    with its smallest group (smallest grp of a tie): the alphabetically first that dev lacks, else the first that test lacks.

    A round asks one aggregate for it, of which one group reaches the driver."""
    sizes = rows.groupBy("grp", "qa_type").agg(F.count("*").alias("n"), F.first("split").alias("split")).withColumn("size", F.sum("n").over(W.partitionBy("grp")))
    moved: dict = {}

    def current(split):
        for grp, side in moved.items():
            split = F.when(F.col("grp") == F.lit(grp), side).otherwise(split)
        return split

    for _ in range(rounds):
        now = sizes.withColumn("split", current(F.col("split")))
        types = now.groupBy("qa_type").agg(F.collect_set("split").alias("held")).where(F.size("held") == 1)
        lacks = F.when(F.col("held")[0] == "test", "dev").otherwise("test")
        first = types.agg(F.min(F.struct(lacks.alias("side"), "qa_type")).alias("x")).select("x.*").where("side is not null")
        mine = now.join(F.broadcast(first), "qa_type")  # one row
        pick = mine.groupBy("side").agg(F.min(F.struct("size", "grp")).alias("g")).select("side", "g.grp").first()
        if pick is None:
            break
        moved[pick.grp] = pick.side
    return rows.withColumn("split", current(F.col("split")))


def one_each(rows: DataFrame, key: str, id_: str, seed: int = 7) -> DataFrame:
    """One row of each value of key, the one of smallest hash of (id, seed): the same in every run."""
    pick = F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))
    return rows.join(rows.groupBy(key).agg(F.min_by(id_, F.struct(pick, id_)).alias(id_)), [key, id_], "left_semi")
