"""Reply trees to formatted conversations with a loss mask, and back.

Root-to-leaf paths come from self-joins that double: each round joins the paths so far with the ancestors 1, 2, 4, ... replies up, so a
tree of any depth takes its logarithm in rounds. Branches of a tree are ranked by the sum of their messages' scores; each one chosen
is a conversation.

A turn is written as <|im_start|>role, a line feed, the text, <|im_end|> and a line feed. A control string inside a role or text
gets a backslash after its first character; one that has backslashes there already gets one more, so nothing else changes and
reading takes one away. In roles line feeds and backslashes are escaped as well. The loss mask holds the spans (code
points, end exclusive) of the texts of the trained roles.

Scale: only ids take part in the joins; texts meet the chosen paths once. A row of output holds at most ``segment`` turns, so a
conversation of any length is rows of bounded size, in order of ``segment_no``; ranks and turn numbers come from ranges (``ordered.placed``).
Reading back takes a conversation's rows one after another, as its digests are hashes of the whole.

Defined results: null roles and texts are empty; a message whose parent is null or missing is a root; of rows with equal ids one stays (the
smallest by role, text, score); null scores count 0; ties of branches go to the smallest leaf id; rows with a null id
go; an empty table has no conversation. Parents that form a ring raise.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, written
from .ordered import placed, streamed

# Control strings of public chat templates.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>",
    "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """text with one backslash more after the first character of each control string."""
    firsts: dict[str, list[str]] = {}
    for c in CONTROLS:
        firsts.setdefault(c[0], []).append(c[1:])
    for first, rest in firsts.items():
        tails = "|".join(re.sub(r"([^\w/<>])", r"\\\1", r) for r in rest)
        text = F.regexp_replace(text, rf"({re.escape(first)})(\\*)({tails})", r"$1\\$2$3")
    return text


_CONTROL = re.compile("|".join(rf"(?:{re.escape(c[0])})\\+(?:{re.escape(c[1:])})" for c in CONTROLS))


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0].replace("\\", "", 1), text)


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def branches(messages: DataFrame, most: int | None = 1) -> DataFrame:
    """messages(tree, id, parent, score) -> (tree, leaf, branch, id, turn): the best ``most`` branches of each tree (None: all), by score,
    and their messages from the root, turn from 0."""
    ids = written(messages.where("id is not null").select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    known = ids.select(F.col("id").alias("parent")).distinct()
    up = written(ids.select("id", "parent").where("parent is not null").join(known, "parent", "left_semi").select("id", F.col("parent").alias("over")))
    leaves = ids.join(up.select(F.col("over").alias("id")).distinct(), "id", "left_anti")
    paths = written(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("back")))
    step, rounds = 1, max(1, ids.count()).bit_length() + 1
    while not up.isEmpty():
        if rounds == 0:
            raise ValueError("parents of messages form a ring")
        further = paths.join(up, "id").select("tree", "leaf", F.col("over").alias("id"), (F.col("back") + step).alias("back"))
        paths = written(paths.union(further))
        over = up.select(F.col("id").alias("over"), F.col("over").alias("higher"))
        up, step, rounds = written(up.join(over, "over").select("id", F.col("higher").alias("over"))), 2 * step, rounds - 1
    each = paths.join(ids.select("id", "score"), "id").groupBy("tree", "leaf").agg(F.round(F.sum("score"), 9).alias("total"), F.max("back").alias("last"))
    ranked = placed(written(each), ["tree"], [F.desc("total"), F.asc("leaf")], place="branch")
    ranked = ranked if most is None else ranked.where(F.col("branch") < most)
    return paths.join(ranked.select("leaf", "branch", "last"), "leaf").select("tree", "leaf", "branch", "id", (F.col("last") - F.col("back")).alias("turn"))


def formatted(turns: DataFrame, key: str, trained: tuple[str, ...] = ("assistant",), segment: int = 64) -> DataFrame:
    """turns(key, turn, role, text) -> key, segment_no, text, loss array<struct<start, end>>: ``segment`` turns a row, turn from 0."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), _role(role), F.lit("\n"))
    piece = F.struct("turn", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), role.isin(*trained).alias("trained"))
    rows = turns.select(key, F.floor(F.col("turn") / segment).alias("segment_no"), piece.alias("piece")).groupBy(key, "segment_no")
    rows = rows.agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # ``segment`` turns at most
    size = lambda p: F.length(p.head) + F.length(p.body) + len(END) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    span = lambda a, p: F.array(F.struct((a.at + F.length(p.head)).alias("start"), (a.at + F.length(p.head) + F.length(p.body)).alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    loss = F.aggregate("pieces", start, lambda a, p: F.struct((a.at + size(p)).alias("at"), F.concat(a.loss, F.when(p.trained, span(a, p)).otherwise(none)).alias("loss"))).loss
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit(END + "\n"))), "")
    return rows.select(key, "segment_no", text.alias("text"), loss.alias("loss"))


def conversations_of(messages: DataFrame, most: int | None = 1, trained: tuple[str, ...] = ("assistant",), segment: int = 64) -> DataFrame:
    """messages(tree, id, parent, role, text, score) -> tree, branch, segment_no, text, loss: the chosen branches, formatted."""
    best = F.min(F.struct("tree", "parent", "role", "text", "score")).alias("m")
    once = messages.where("id is not null").groupBy("id").agg(best).select("id", "m.*")
    chosen = branches(once.select("tree", "id", "parent", "score"), most)
    turns = chosen.join(once.select("id", "role", "text"), "id").select(F.struct("tree", "branch").alias("key"), "turn", "role", "text")
    return formatted(turns, "key", trained, segment).select("key.tree", "key.branch", "segment_no", "text", "loss")


_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted row."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        found.append((_role_back(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text after the last turn")
    return found


class _Read:
    """Digests of one conversation's rows."""

    def __init__(self):
        self.turns, self.loss, self.counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def add(self, row: dict) -> None:
        for role, text in parsed(row["text"]):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.counts[0] += 1
        for span in row["loss"]:
            part = unescaped(row["text"][span["start"] : span["end"]])
            self.loss.update(part.encode())
            self.counts[1] += len(part)
        self.counts[2] += len(row["text"])

    def done(self) -> tuple:
        return (self.counts[0], self.turns.hexdigest(), self.counts[1], self.loss.hexdigest(), self.counts[2])


def read_back(rows: DataFrame, key: str) -> DataFrame:
    """Formatted rows, read again: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    fields = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return streamed(rows.select(key, "segment_no", "text", "loss"), key, ["segment_no"], fields, _Read)


def messages_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: a turn replies to the turn before it; equal turns go by role, then text
    (its first 64 characters, then a hash)."""
    rows = conversations.select(col(conv_id).alias("tree"), col(turn).alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text"))
    rows = placed(rows, ["tree"], [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first(F.left("text", F.lit(64))), F.xxhash64("text").asc()], place="at")
    name = lambda n: F.struct(F.col("tree").alias("tree"), (F.col("at") - n).alias("at"))
    return rows.select("tree", name(0).alias("id"), F.when(F.col("at") > 0, name(1)).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    rows = rows.union(spark.createDataFrame(planted, "conv_id bigint, turn bigint, role string, text string"))
    out = written(conversations_of(messages_of(rows)))
    return read_back(out, "tree").withColumnRenamed("tree", "conv_id")
