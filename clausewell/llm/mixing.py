"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Sources get word targets by water-filling (weights, a ceiling of ``max_epochs`` times their size). The
documents of each source are dealt into blocks by hash; blocks are permuted, whole blocks are taken up to
the target, and inside the one block where the target falls the documents are taken in permuted order,
passing over those that no longer fit (``passes`` times), then the one further document that comes
nearest to the words still missing. A splitting tree halves the
sources' counts of taken blocks again and again among the output shards, drawing each node's quotas from the multivariate
hypergeometric law; then each source's own blocks, permuted, are dealt out by its exact quotas. ``shuffled`` orders a shard locally.

Scale: texts are read once and never shuffled for the plan. Ranks and running sums, of blocks and of sources, are taken
in ``BUCKETS`` hash buckets (or ranges) at a time: a window holds one bucket, and what lies before a bucket comes from a table
of bucket totals, so no window holds a whole source or node. Windows over documents hold one block. Everything
is a function of (id, seed), so reruns agree.

Defined results: a null text has no words; the null source is a source of its own, last in order; the
rows of an id (without an id: of a text) and source are one unit, of their words together, and are taken equally often; an empty table gives an empty mix. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, table, written

BLANK = "[ \\t-\\r]"


def word_count(text: Column) -> Column:
    """Maximal runs without U+0020 and U+0009-U+000D; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    ends = lambda at: F.when(F.substring(t, at, 1).rlike(BLANK), 1).otherwise(0)
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, BLANK + "+", -1)) - ends(1) - ends(-1)).cast("bigint")


#: Hash buckets of a rank or running sum.
BUCKETS = 256


def bucketed(rows: DataFrame, order: Column) -> DataFrame:
    """rows with h, their hash, and bucket, its leading bits: what ``running`` orders by."""
    return rows.withColumn("h", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 56), F.lit(BUCKETS)).cast("int"))


def running(rows: DataFrame, keys: list[str], value: Column, ties: list[str]) -> DataFrame:
    """bucketed rows with ``before``, the sum of value over the rows of equal keys that come earlier by (bucket, h, ties), and
    ``whole``, the sum over all of them. rows are read twice, so they should be cut from their lineage."""
    own = rows.withColumn("own", value.cast("bigint"))
    totals = own.groupBy(*keys, "bucket").agg(F.sum("own").alias("part"))
    every = W.partitionBy(*keys)
    ahead = F.sum("part").over(every.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"), F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("part").over(every).alias("whole"))
    inside = W.partitionBy(*keys, "bucket").orderBy("h", *ties).rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("own").over(inside), F.lit(0)))
    same = F.col("bucket") == F.col("_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(totals, same).withColumn("before", F.col("ahead") + F.col("inside")).drop("own", "inside", "ahead", "_bucket", *[f"_{k}" for k in keys])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same and target. Shares by weight; sources above their ceiling stop there, and what
    is left is shared by the others, until none is above. One row per source; sums alone reach the driver."""
    ordered = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ordered = written(ordered)  # the ranges are fixed from here on
    before = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a partition
    n = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("ahead")
    rows = ordered.join(F.broadcast(before), F.col("part") == F.col("of"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(n, F.lit(len(weights))).cast("int") + 1))
    rows = written(rows.select("source", "source_size", "weight", (F.col("source_size") * float(max_epochs)).alias("cap")))
    budget = float((rows.agg(F.sum("source_size")).first()[0] or 0) * share)
    level, full = 0.0, -1
    while True:
        at = F.col("cap") <= F.lit(level) * F.col("weight")
        r = rows.agg(F.count_if(at), F.sum(F.when(at, F.col("cap"))), F.sum(F.when(~at, F.col("weight")))).first()
        if r[0] == full or not r[2]:
            break
        full, level = r[0], (budget - (r[1] or 0.0)) / r[2]
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def source_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """blocks(source, ...) -> source, quotas array<bigint>: how many of a source's blocks go to each shard.

    The multivariate hypergeometric splitting tree: a node holds counts of blocks of each source and is halved (in proportion to
    the shards below) until one shard is left. What a half takes of each source is drawn as from an urn: tokens, one a block, that say
    only a source, lie in one keyed random order; a node is a range of it and its left half the first part, so counts of tokens by source
    in a part follow the hypergeometric law given the node's, and parts sum to their node exactly."""
    names = [c for c in blocks.columns if c != "source"]
    urn = written(bucketed(blocks.withColumn("urn", F.lit(0)), F.xxhash64(F.lit(seed), "source", *names)))
    drawn = running(urn, ["urn"], F.lit(1), blocks.columns)
    node = lambda lo, hi, a, b: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(at, depth):
        mid = F.floor((at.lo + at.hi) / 2)
        cut = at.a + F.round((at.b - at.a) * (mid - at.lo) / (at.hi - at.lo))
        left = F.col("before") < cut
        below = node(F.when(left, at.lo).otherwise(mid), F.when(left, mid).otherwise(at.hi), F.when(left, at.a).otherwise(cut), F.when(left, cut).otherwise(at.b))
        return F.when(at.hi - at.lo > 1, below).otherwise(at)

    depths = F.sequence(F.lit(1), F.lit(max(1, (shards - 1).bit_length())))
    leaf = F.aggregate(depths, node(F.lit(0), F.lit(shards), F.lit(0), F.col("whole")), turn, lambda at: at.lo)
    counts = drawn.select("source", leaf.alias("shard")).groupBy("source", "shard").agg(F.count("*").alias("n"))
    held = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))  # a row a shard at most
    quota = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.element_at("held", k), F.lit(0)))
    return held.select("source", quota.alias("quotas"))


def splitting_tree(blocks: DataFrame, key: list[str], shards: int, seed: int) -> DataFrame:
    """blocks, of which "source" is a key, with ``shard``: each source's own blocks, permuted by a second keyed order, are dealt out by its exact quotas."""
    quotas = written(source_quotas(blocks.select(*key), shards, seed))
    own = written(bucketed(blocks, F.xxhash64(F.lit(seed + 1), *key)))
    ranked = running(own, ["source"], F.lit(1), key)
    ranked = ranked.join(quotas, ranked["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    ends = F.transform("quotas", lambda q, k: F.aggregate(F.slice("quotas", F.lit(1), k + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return ranked.select(*blocks.columns, F.size(F.filter(ends, lambda e: e <= F.col("before"))).alias("shard"))


def mix_plan(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
    max_epochs: float = 2.0, shards: int = 16, block_docs: int = 256, passes: int = 2, seed: int = 42,
) -> DataFrame:
    """One row per row of docs: doc_id, unit, source, size, source_size, target, taken, and ``shards``, the shard of each copy taken."""
    each = docs.select(col(doc_id).alias("doc_id"), unit_of(docs, doc_id, text).alias("unit"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size"))
    each = written(each)  # the one pass over the texts: narrow columns are kept
    plan = _unit_plan(each.groupBy("unit", "source").agg(F.sum("size").alias("size")), weights, share, max_epochs, shards, block_docs, passes, seed)
    plan = plan.select(F.col("unit").alias("_unit"), F.col("source").alias("_source"), "source_size", "target", "shards")
    rows = each.join(plan, (F.col("unit") == F.col("_unit")) & F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "unit", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("bigint").alias("taken"), "shards")


def unit_of(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What is taken or left together: the rows of an id, or without an id the rows of a text."""
    return F.coalesce(col(doc_id).cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(col(text), F.lit("")), 256)))


def _unit_plan(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, shards: int, block_docs: int, passes: int, seed: int) -> DataFrame:
    """rows(unit, source, size), a row a unit of each source, with source_size, target, and ``shards``, the shard of each copy taken."""
    rows = written(rows)
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    counts = by.select("source", F.ceil(F.col("n") / block_docs).cast("int").alias("n_blocks"), F.col("n"))
    targets = source_targets(by.drop("n"), weights, share, max_epochs)
    facts = targets.join(counts, targets["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    facts = written(facts.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    rows = rows.join(facts, rows["source"].eqNullSafe(facts["source"]), "left").drop(facts["source"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.col("n_blocks")).cast("int"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("epochs").alias("epochs"))
    blocks = written(bucketed(blocks, F.xxhash64(F.lit(seed + 1), "source", "block")))
    blocks = running(blocks, ["source"], F.col("words"), ["block"])
    room = F.col("rest") - F.col("before")
    state = F.when(room >= F.col("words"), 2).when(room > 0, 1).otherwise(0)
    blocks = written(blocks.select("source", "block", "epochs", state.alias("state"), F.greatest(F.lit(0.0), room).alias("room")))
    copies = blocks.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("copy"), "epochs", "state").where("copy < epochs or state > 0")
    tree = splitting_tree(copies.select("source", "block", "copy"), ["source", "block", "copy"], shards, seed + 2)
    dealt = tree.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["block"] == b["block"])
    blocks = written(blocks.join(dealt, same(blocks, dealt), "left").drop(dealt["source"], dealt["block"]))
    rows = rows.drop("epochs", "rest", "n_blocks", "n")
    rows = rows.join(blocks, same(rows, blocks), "left").drop(blocks["source"], blocks["block"])
    whole = rows.where("state is null or state <> 1").withColumn("last", F.coalesce(F.col("state") == 2, F.lit(False)))
    part = rows.where("state = 1")
    own = W.partitionBy("source", "block")
    turn = own.orderBy(F.xxhash64(F.lit(seed + 3), "unit"), "unit").rowsBetween(W.unboundedPreceding, 0)
    part = part.withColumn("last", F.lit(False)).withColumn("gap", F.col("room"))
    for _ in range(passes):
        small = ~F.col("last") & (F.col("size") <= F.col("gap"))
        part = part.withColumn("last", F.col("last") | (small & (F.sum(F.when(small, F.col("size")).otherwise(0)).over(turn) <= F.col("gap"))))
        part = part.withColumn("gap", F.col("room") - F.coalesce(F.sum(F.when(F.col("last"), F.col("size"))).over(own), F.lit(0)))
    off = F.when(~F.col("last"), F.abs(F.col("gap") - F.col("size")))
    nearest = F.row_number().over(own.orderBy(off.asc_nulls_last(), F.xxhash64(F.lit(seed + 3), "unit"), "unit"))
    part = part.withColumn("nearest", nearest)
    part = part.withColumn("last", F.col("last") | ((F.col("nearest") == 1) & F.coalesce(off < F.col("gap"), F.lit(False)))).drop("gap", "nearest")
    rows = whole.unionByName(part)
    epochs, last = F.coalesce(F.col("epochs"), F.lit(0)), F.col("last")
    drawn = F.transform(F.when(epochs + last.cast("int") > 0, F.sequence(F.lit(0), epochs + last.cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.element_at("dealt", k))
    return rows.select("unit", "source", "source_size", "target", drawn.alias("shards"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", seed: int = 42, **options) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, with shard, copy and a local order, partitioned by
    shard and sorted in it. New columns: shard, copy, position_key (their names get underscores where docs has them)."""
    text, source = options.get("text", "text"), options.get("source", "source")
    plan = mix_plan(docs, doc_id=doc_id, seed=seed, **options)
    key, of, shards = fresh(docs, "mix_unit"), fresh(docs, "mix_source"), fresh(docs, "shards")
    names = {n: n if n not in {c.lower() for c in docs.columns} else fresh(docs, n) for n in ("shard", "copy", "position_key")}
    plan = plan.groupBy(F.col("unit").alias(key), F.col("source").alias(of)).agg(F.first("shards").alias(shards))  # equal in all rows of a unit
    rows = docs.join(plan, (unit_of(docs, doc_id, text) == col(key)) & col(source).cast("string").eqNullSafe(col(of))).drop(key, of)
    rows = rows.select("*", F.posexplode(shards).alias(names["copy"], names["shard"])).drop(shards)
    rows = rows.withColumn(names["position_key"], F.xxhash64(F.lit(seed + 4), col(names["shard"]), col(names["copy"]), col(doc_id)))
    return rows


def shuffled(mix: DataFrame, shard: str = "shard", position_key: str = "position_key") -> DataFrame:
    """The mix with each shard together and in its own random order. Shards larger than a task are split by Spark's rebalancing."""
    return mix.hint("rebalance", col(shard)).sortWithinPartitions(shard, position_key)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its words, its source's words and target, and the words the mix takes of it."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "shards")
