"""Prefix trie of conversations with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns. It is known by its depth and the exclusive or of the SHA-256 values of its (place, turn)
pairs, four 64-bit lanes wide, which Spark sums up along any number of tasks; texts are hashed where they are read and
go no further. Nodes are counted by grouping on these, so a first turn that a third of all conversations share is partial
sums.

Subtree sums work on the forest of edges to parents. A component is split at its centroid, the node of fewest nodes below it among
those that hold half of it or more: the centroid's child components have their totals aggregated, and the centroid's total is
added to it and to each node on the path from it to the component's top, whose sizes drop by it. Components of
more than ``local_nodes`` nodes are split so in rounds of joins, all at once: a round at least halves them. Smaller ones go whole to
tasks that split on in memory; none of them has more than ``local_nodes`` rows. A path from node to top is the
prefixes of the node's smallest member, so it is one join. First sizes come from sums over 2, 4, 8, ... generations.

Defined results: null roles and texts are empty; turns that are equal in turn go by the digest of role and text; rows without a conv_id
are left out; a repeated row is a turn of its own; a conversation whose source and own turns leave none is a member of the
root; an empty table has no node. conv_id % 5 has the sign of conv_id.

The digest of a node's conversations is one SHA-256 over all of them, which only one task after another can take: the
ids are joined into pieces of IDS where they are sorted, and the pieces go past the hash, one after another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, written
from .ordered import Joined, placed, streamed

LANES = ("x0", "x1", "x2", "x3")
#: Conversation ids of a piece that is hashed as one row.
IDS = 4096


def turn_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, digest, bytes): the one pass over the texts."""
    r, t = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r), F.lit(":"), r, t), 256))
    return rows.where(col(conv_id).isNotNull()).select(col(conv_id).cast("bigint").alias("c"), col(turn).alias("turn"), digest.alias("digest"), F.octet_length(t).cast("bigint").alias("bytes"))


def taken_turns(c: Column, most: int = 9) -> Column:
    """How many turns a conversation takes from its source: 0 to most - 1 by crc32 of its decimal id."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most))


def rebuilt(turns: DataFrame, ids: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """turns(c, place, digest, bytes) -> (c, depth, digest, bytes): c's first turns are those of c - c % group, then its own follow.

    Only ``most`` - 1 turns of a conversation are ever given to others, ``group`` at most."""
    h, base = taken_turns(F.col("c"), most), F.col("c") - F.col("c") % group
    heads = turns.where((F.col("c") % group == 0) & (F.col("place") < most - 1))
    given = heads.select(F.col("c").alias("of"), "place", "digest", "bytes").withColumn("c", F.explode(F.array(*[F.col("of") + k for k in range(1 - group, group)])))
    given = given.where((base == F.col("of")) & (F.col("place") < h)).join(ids, "c", "left_semi").select("c", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    lengths = heads.groupBy(F.col("c").alias("of")).agg(F.count("*").alias("n"))
    own = turns.where(F.col("place") >= h).withColumn("of", base).join(lengths, "of", "left")
    own = own.select("c", (F.col("place") + 1 - h + F.least(h, F.coalesce("n", F.lit(0)))).alias("depth"), "digest", "bytes")
    return given.union(own)


def _key(lanes: list[Column]) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in lanes]))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, digest, bytes) -> (c, depth, key, parent, bytes): the nodes that a conversation passes, without the root."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), "digest"), 256)
    lanes = {x: F.conv(F.substring(mixed, 16 * j + 1, 16), 16, -10).cast("bigint") for j, x in enumerate(LANES)}
    rows = turns.select("c", "depth", "bytes", *[v.alias(x) for x, v in lanes.items()], *[v.alias(f"own_{x}") for x, v in lanes.items()])
    rows = placed(rows, ["c"], [F.asc("depth")], LANES)
    before = [F.col(x).bitwiseXOR(F.col(f"own_{x}")) for x in LANES]
    return rows.select("c", "depth", _key([F.col(x) for x in LANES]).alias("key"), _key(before).alias("parent"), "bytes")


def split(parents: list[int], values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of a forest, by centroid decomposition. Parents come before their children; roots have -1."""
    sums = np.zeros_like(values)
    tops = np.array([i if p < 0 else -1 for i, p in enumerate(parents)])
    for i, p in enumerate(parents):
        if p >= 0:
            tops[i] = tops[p]
    order = np.argsort(tops, kind="stable")
    todo = [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(tops[order])) + 1)] if len(order) else []
    place = np.full(len(parents), -1)  # in the component at hand
    while todo:
        nodes = todo.pop()
        if len(nodes) == 1:
            sums[nodes[0]] += values[nodes[0]]
            continue
        place[nodes] = np.arange(len(nodes))
        up = [int(place[parents[v]]) if parents[v] >= 0 else -1 for v in nodes]
        sizes = [1] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            sizes[up[i]] += sizes[i]
        centroid = min((i for i in range(len(nodes)) if 2 * sizes[i] >= len(nodes)), key=sizes.__getitem__)
        part = [-1] * len(nodes)  # the child of the centroid that a node is below, or -1
        parts: dict[int, list[int]] = {}
        above, total = [], values[nodes[centroid]].copy()
        for i, v in enumerate(nodes):
            if i == centroid:
                continue
            part[i] = i if up[i] == centroid else part[up[i]] if i else -1
            (parts.setdefault(part[i], []) if part[i] >= 0 else above).append(v)
        for own in parts.values():
            total += values[own].sum(0)
        at = centroid
        while at >= 0:
            sums[nodes[at]] += total
            at = up[at]
        place[nodes] = -1
        todo += [*parts.values(), *([above] if above else [])]
    return sums


def _sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with size, the nodes of its subtree: after k rounds those of 2 ** k generations."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    nodes, step = nodes.withColumn("size", F.lit(1).cast("bigint")), 1
    line = paths.select("c", F.col("depth").alias("up"), F.col("key").alias("over"))
    while step <= deepest:
        below = nodes.select("c", (F.col("depth") - step).alias("up"), "size").where("up >= 0").join(line, ["c", "up"])
        below = below.groupBy(F.col("over").alias("key")).agg(F.sum("size").alias("more"))
        nodes = written(nodes.join(below, "key", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"))
        step *= 2
    return nodes


def rolled(nodes: DataFrame, paths: DataFrame, values: list[str], local_nodes: int = 20_000) -> DataFrame:
    """(key, and for each of ``values`` its sum over the node's subtree).

    nodes(key, c, depth, parent, values...): c is a conversation that passes the node, and paths(c, depth, key) names the
    node that it passes at each depth, from 0."""
    rows = _sizes(nodes, paths)
    roots = paths.where("depth = 0").select("c", F.col("key").alias("comp"), F.col("depth").alias("top"))
    rows = rows.join(roots, "c")
    sums = [f"{v}_sum" for v in values]
    rows = rows.withColumns({s: F.lit(0).cast("bigint") for s in sums} | {"done": F.lit(False)})
    rows = written(rows)
    while True:
        tops = rows.where((F.col("key") == F.col("comp")) & ~F.col("done") & (F.col("size") > local_nodes))
        large = tops.select("comp", F.col("size").alias("whole"))
        if large.isEmpty():
            break
        rows = written(_round(rows, large, paths, values, sums))
    return _finished(rows, values, sums)


def _round(rows: DataFrame, large: DataFrame, paths: DataFrame, values: list[str], sums: list[str]) -> DataFrame:
    """rows after the split of each component of ``large`` at its centroid."""
    mine = rows.where("not done").join(large, "comp")
    heavy = mine.where(2 * F.col("size") >= F.col("whole")).groupBy("comp")
    kept = F.struct("key", "c", "depth", "size", "top", *values)
    z = written(heavy.agg(F.min_by(kept, "size").alias("z")).select("comp", *[F.col(f"z.{n}").alias(f"z_{n}") for n in ("key", "c", "depth", "size", "top", *values)]))
    # where a node is: below the centroid, under which of its children
    deeper = mine.join(z, "comp").where(F.col("depth") > F.col("z_depth")).select("key", "c", "depth", "z_key", "z_depth", *values, "comp")
    line = paths.select("c", F.col("depth").alias("z_depth"), F.col("key").alias("at"))
    below = deeper.join(line, ["c", "z_depth"]).where(F.col("at") == F.col("z_key")).drop("at")
    child = paths.select("c", (F.col("depth") - 1).alias("z_depth"), F.col("key").alias("now"))
    below = written(below.join(child, ["c", "z_depth"]))
    totals = below.groupBy("comp").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    z = written(z.join(totals, "comp", "left").withColumns({f"t_{v}": F.col(f"z_{v}") + F.coalesce(f"t_{v}", F.lit(0)) for v in values}))
    # the path from the centroid to the top of its component
    ends = z.select(F.col("z_c").alias("c"), "z_depth", "z_top", "z_size", *[f"t_{v}" for v in values])
    path = paths.join(ends, "c").where((F.col("depth") <= F.col("z_depth")) & (F.col("depth") >= F.col("z_top")))
    path = path.select("key", (F.col("depth") == F.col("z_depth")).alias("is_z"), "z_size", *[f"t_{v}" for v in values])
    moved = below.select("key", "now", (F.col("z_depth") + 1).alias("now_top"))
    rows = rows.join(path, "key", "left").join(moved, "key", "left")
    on = F.col("is_z").isNotNull()
    new = {s: F.col(s) + F.coalesce(f"t_{v}", F.lit(0)) for s, v in zip(sums, values, strict=True)}
    new["size"] = F.when(on & ~F.col("is_z"), F.col("size") - F.col("z_size")).otherwise(F.col("size"))
    new["done"] = F.col("done") | F.coalesce("is_z", F.lit(False))
    new["comp"], new["top"] = F.coalesce("now", "comp"), F.coalesce("now_top", "top")
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns if c not in ("is_z", "z_size", "now", "now_top", *[f"t_{v}" for v in values])])


def _finished(rows: DataFrame, values: list[str], sums: list[str]) -> DataFrame:
    """The components that are left, each whole in a task and of a bounded size, split to the end."""
    fields = "key binary, " + ", ".join(f"{v} bigint" for v in values)
    left = rows.where("not done").select("comp", "depth", "key", "parent", *values, *sums)
    k = len(values)

    def run(batches):
        kept: list[list] = []

        def flush(held):
            at = {key: i for i, key in enumerate(held[2])}
            parents = [at.get(p, -1) if p is not None else -1 for p in held[3]]
            own = np.array(held[4 : 4 + k], np.int64).T
            found = split(parents, own) + np.array(held[4 + k :], np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(held[2], pa.binary()), *[pa.array(found[:, j]) for j in range(k)]], names=["key", *values])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            kept = [a + b for a, b in zip(kept, columns, strict=True)] if kept else columns
            comps = kept[0]
            cut = len(comps)
            while cut and comps[cut - 1] == comps[-1]:  # the last component may go on
                cut -= 1
            if cut:
                yield flush([c[:cut] for c in kept])
                kept = [c[cut:] for c in kept]
        if kept and kept[0]:
            yield flush(kept)

    split_ = left.repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(run, fields)
    return split_.union(rows.where("done").select("key", *[F.col(s).alias(v) for s, v in zip(sums, values, strict=True)]))


def end_digests(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """ends(key, c) -> (key, ends_sha256): SHA-256 of a node's decimal ids, ascending, comma-joined."""
    rows = placed(ends, ["key"], [F.asc("c")]).withColumn("no", F.floor(F.col("place") / ids))
    pieces = rows.groupBy("key", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("piece"))
    pieces = written(pieces)
    many = pieces.where("no > 0").select("key").distinct()
    one = pieces.join(many, "key", "left_anti").select("key", F.sha2("piece", 256).alias("ends_sha256"))
    return one.union(streamed(pieces.join(many, "key", "left_semi"), "key", ["no"], "ends_sha256 string", Joined))


def trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: Callable[[DataFrame, DataFrame], DataFrame] | None = None, local_nodes: int = 20_000
) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rebuild`` turns (c, place, digest, bytes) and the ids into (c, depth, digest, bytes), depths from 1; None keeps each
    conversation as it is."""
    turns = written(turn_rows(conversations, conv_id, turn, role, text))
    ids = written(turns.select("c").distinct())
    turns = placed(turns, ["c"], [F.asc_nulls_first("turn"), F.asc("digest")])
    rows = rebuild(turns, ids) if rebuild else turns.withColumn("depth", F.col("place") + 1)
    rows = prefixes(rows.select("c", "depth", "digest", "bytes"))
    zero, root = F.lit(b"\0" * 32), ids.select("c", F.lit(0).cast("bigint").alias("depth"))
    whole = rows.select("c", "depth", "key", "parent", "bytes").union(root.select("c", "depth", zero, F.lit(None).cast("binary"), F.lit(0).cast("bigint")))
    whole = written(whole)
    nodes = whole.groupBy("key").agg(F.min("c").alias("c"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = written(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    paths = whole.select("c", "depth", "key").join(nodes.select("c").distinct(), "c", "left_semi")
    totals = rolled(nodes.select("key", "c", "depth", "parent", "n_leaves", "saved_tokens"), written(paths), ["n_leaves", "saved_tokens"], local_nodes)
    ends = end_digests(whole.groupBy("c").agg(F.max_by("key", "depth").alias("key")))
    over = nodes.select(F.col("key").alias("parent"), F.col("c").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "key").join(over, "parent", "left").join(ends, "key", "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    return out.select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt rows of ``conversations``."""
    return trie(table(spark, sf_dir, "conversations"), rebuild=rebuilt)
