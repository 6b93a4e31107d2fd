"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Links are groups (here: equal texts): every member of a group is a neighbour of every other, and a group is held
as its counts by shard, never as pairs. Documents start in a shard by hash, so sizes are even. In a round each group
picks the shard, among those with room, where most of its members are, and the members elsewhere ask to move there.
A shard takes in no more linked documents than its quota of rows has left: the largest gains first, by gain class,
and of the class at the edge a share by hash. Documents without links fill up the rest, so a move costs them
nothing. Last, ranks within a shard (linked ones first) send what is over the quota to shards below it.

Law "rows": sizes differ by one row at most. Groups larger than a shard's quota are spread over as few shards as
their turn allows.

Scale: a round is a partial aggregate by (group, shard), a join on the group and a table of at most shards x gain
classes on the driver; Spark splits a hot group's join partition. Ranks come from hash buckets, never from one sort
of a shard.

Defined cases: null text: size 1, crc of the empty string, no links. Empty texts form a group. Repeated rows are
rows of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, gapless_rank, shuffle_width, table


def propagate(nodes: DataFrame, shards: int, rounds: int, quota: list[int], scratch: Scratch) -> DataFrame:
    """(node, g1, g2) -> the same with shard: balanced label propagation over groups (g1, g2), under ``quota`` rows a shard."""
    spark = nodes.sparkSession
    cur = scratch.put(nodes.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int")), "round0")
    size = {r.shard: r.n for r in cur.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = [size.get(s, 0) for s in range(shards)]
    for k in range(1, rounds + 1):
        room = [max(0, quota[s] - used[s]) for s in range(shards)]
        has = F.array(*[F.lit(r > 0) for r in room])
        cells = cur.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
        lure = F.when(F.element_at(has, F.col("shard") + 1), F.struct("n", F.xxhash64("g1", "g2", "shard").alias("tie"), "shard"))
        best = cells.groupBy("g1", "g2").agg(F.max(lure).alias("to"), F.max(F.struct("n", F.xxhash64("g1", "g2", "shard").alias("tie"), "shard")).alias("top"))
        # members of the shard that holds most stay, even if it is full
        asks = cells.join(best.where("to is not null"), ["g1", "g2"]).where((F.col("shard") != F.col("to.shard")) & (F.col("shard") != F.col("top.shard")) & (F.col("to.n") >= F.col("n")))
        asks = asks.select("g1", "g2", "shard", F.col("to.shard").alias("to"), F.floor(F.log2(F.col("to.n") - F.col("n") + 2)).cast("int").alias("gain"), "n")
        wish = asks.groupBy("to", "gain").agg(F.sum("n").alias("n")).collect()
        if not wish:
            break
        share, left = [], list(room)
        for r in sorted(wish, key=lambda r: (r.to, -r.gain)):
            take = min(r.n, left[r.to])
            left[r.to] -= take
            share.append((r.to, r.gain, take / r.n))
        shares = F.broadcast(spark.createDataFrame(share, "to int, gain int, share double"))  # shards x gain classes
        asks = scratch.put(asks.join(shares, ["to", "gain"]).where("share > 0").select("g1", "g2", "shard", "to", "share"), f"asks{k}")
        draw = F.pmod(F.xxhash64("node", F.lit(100 + k)), F.lit(1 << 30)) / float(1 << 30)
        cur = cur.join(asks, ["g1", "g2", "shard"], "left").select("node", "g1", "g2", F.when(draw < F.col("share"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        cur = scratch.put(cur, f"round{k}")
        scratch.drop(f"round{k - 1}")
        size = {r.shard: r.n for r in cur.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        used = [size.get(s, 0) for s in range(shards)]
    return cur


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size; shards differ by one row at most."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.col("text").cast("string")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("g1"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text", F.lit(2))).alias("g2"),
    )
    base = scratch.put(base.withColumn("node", F.xxhash64("doc_id", "g1", F.lit(5))), "base")
    # written first: a join of two tables, not of an aggregate, is one whose hot groups Spark can split
    groups = scratch.put(base.where("g2 is not null").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    rows = scratch.put(base.join(groups, ["g1", "g2"], "left"), "rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    linked = propagate(rows.where("group_size is not null").select("node", "g1", "g2"), shards, rounds, quota, scratch)
    # equal (node, group) rows are repeats of one row and go where their group goes: one of their shards serves for all
    where = scratch.put(linked.groupBy("node", "g1", "g2").agg(F.min("shard").alias("to")), "where")
    loose = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int")
    placed = rows.join(where, ["node", "g1", "g2"], "left").withColumn("shard", F.coalesce("to", loose)).withColumn("last", F.when(F.col("group_size").isNull(), 1).otherwise(0))
    placed = placed.select("doc_id", "size", "text_crc32", "node", "group_size", "shard", "last")
    buckets = shuffle_width(docs.sparkSession)
    ranked = scratch.put(gapless_rank(placed, ["shard"], F.col("node"), ["node", "doc_id"], "rank", buckets, first="last"), "ranked")

    have = {r.shard: r.n for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    stay = ranked.where(F.col("rank") < limit).withColumn("slot", F.col("rank"))
    gaps, at = [], 0
    for s in range(shards):
        n = max(0, quota[s] - have.get(s, 0))
        if n:
            gaps.append((at, at + n, s, have.get(s, 0)))
            at += n
    over = ranked.where(F.col("rank") >= limit)
    if gaps:
        over = gapless_rank(over.withColumn("all", F.lit(0)), ["all"], F.col("node"), ["node", "doc_id"], "nth", buckets)
        to = F.coalesce(*[F.when((F.col("nth") >= a) & (F.col("nth") < e), F.lit(s)) for a, e, s, _ in gaps])
        slot = F.coalesce(*[F.when((F.col("nth") >= a) & (F.col("nth") < e), F.col("nth") - a + h) for a, e, _, h in gaps])
        over = over.withColumn("slot", slot.cast("long")).withColumn("shard", to.cast("int"))
        stay = stay.unionByName(over.select(*stay.columns))
    return stay.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
