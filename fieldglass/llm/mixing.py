"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks of about ``block_docs`` documents by a hash. The mix draws a source's
blocks again and again, each pass (epoch) in a permutation of its own: whole passes first, then blocks of the last
pass until the target is met, the block at the edge document by document and the document at the edge by words, so
each source is exact to a word. A tree over the output shards splits the exact numbers of drawn blocks: at each
node a multivariate-hypergeometric draw says how many blocks of each group of sources go left, and within a group the
same law deals each source's blocks. Blocks are dealt disjointly by those quotas and shuffled locally by a hash.

Sources are a table like any other, however many: targets come from a few aggregates over it (a level that all open
sources share is lowered until no source is above its limit), and the driver holds a number a group of sources (GROUPS
of them) and a number a task. A hot source is many blocks, and no task sorts more than a block or a range of blocks.

Defined cases: null text or no word: size 0, nothing is taken. A null source is a source of its own, last in order.
Null or repeated doc_ids are ordinary rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import WORD, Scratch, arrow, shuffle_width, table

#: Groups of sources at the top of the splitting tree.
GROUPS = 1024
#: Ranges of a source's blocks in order of their hash; a task sorts one.
RANGES = 256


def ordered_sources(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """stats (source, ...) with ``s``, the source's number by code point from 0, null last, without one sort of all."""
    null = F.col("source").isNull()
    seq = stats.withColumn("_null", null).repartitionByRange(shuffle_width(stats.sparkSession), "_null", "source").sortWithinPartitions("_null", "source").drop("_null")

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "_part", "_at"])
            at += b.num_rows

    schema = ", ".join([f"`{c}` {t}" for c, t in stats.dtypes] + ["_part int, _at long"])
    seq = scratch.put(seq.transform(arrow, number, schema), "ordered")
    before, at = {}, 0
    for r in sorted(seq.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a task
        before[r[0]], at = at, at + r.n
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    return seq.withColumn("s", (shift + F.col("_at")).cast("long")).drop("_part", "_at")


def water_level(sources: DataFrame, most: float) -> float:
    """The target per weight of the sources (size, weight) below their limit of ``most`` times their size."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > most * F.col("size")
        r = sources.agg(F.sum("size").alias("all"), F.sum(F.when(full, F.col("size"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if not r["open"]:
            return float("inf")
        now = ((r["all"] or 0) - most * (r["full"] or 0)) / r["open"]
        if now == level:
            return now
        level = now


def splitting_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """groups x shards: how many of each group's drawn blocks a shard gets; shards differ by one block at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have * 0
        split(lo, mid, left)
        split(mid, hi, have - left)

    if counts:
        split(0, shards, np.array(counts, np.int64))
    return out


def deal(counts: list[int], quota: np.ndarray, seed: int) -> np.ndarray:
    """sources x shards: a group's quotas dealt to its sources, each source's draw from what the ones before left."""
    rng, left = np.random.default_rng(seed), quota.copy()
    out = np.zeros((len(counts), len(quota)), np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left = left - out[i]
    return out


def running(df: DataFrame, keys: list[str], order: list[str], value, out: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before in the order of the hash ``order[0]`` (ties by the rest), by keys;
    a task sorts a range of a key's hashes."""
    ranged = df.withColumn("_range", F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(2**63))), 56)).withColumn("_value", value)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    up = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_shift"))  # RANGES rows a key
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = ranged.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0))).join(sums, [*keys, "_range"])
    return got.withColumn(out, F.col("_shift") + F.col("_own")).select(*df.columns, out)


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, shards: int = 8, block_docs: int = 1024, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken, and draws: (shard, epoch, words, place in it).

    ``weights`` repeat over the sources in code point order. ``explode('draws')`` gives the mix's rows.
    Columns of ``keep`` are returned too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select("doc_id", *keep, F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"))
    base = scratch.put(base, "sizes")  # texts are read once
    stats = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    named = ordered_sources(stats, scratch).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    level = water_level(named, most)
    words = F.least(F.rint("target"), F.floor(most * F.col("source_size"))).cast("long")
    per = F.greatest("source_size", F.lit(1))
    side = named.select("s", F.col("source").alias("name"), F.col("size").alias("source_size"), F.least(F.lit(level) * F.col("weight"), most * F.col("size")).alias("target"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    side = side.withColumn("words", words).select("s", "name", "source_size", "target", "blocks", F.floor(F.col("words") / per).alias("epochs"), (F.col("words") % per).alias("part"))
    side = scratch.put(side, "sources")  # written, so that Spark's measured size decides how it is joined
    at = base.join(side, base.source.eqNullSafe(side.name), "left").drop("name")
    at = at.withColumn("order", F.xxhash64("doc_id", "size", "_text", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + 1)), "blocks").cast("long"))

    blocks = at.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("part").alias("part"))
    blocks = running(blocks.withColumn("h", F.xxhash64("block", "s", F.lit(seed + 2))), ["s"], ["h", "block"], F.col("words"), "before")
    blocks = blocks.withColumn("room", F.col("part") - F.col("before")).withColumn("passes", F.col("epochs") + F.when((F.col("room") > 0) & (F.col("words") > 0), 1).otherwise(0))
    blocks = scratch.put(blocks.select("s", "block", "room", "passes"), "blocks")

    counts = blocks.groupBy("s").agg(F.sum("passes").alias("n")).where("n > 0").withColumn("g", F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(GROUPS)).cast("int"))
    groups = sorted((r.g, r.n) for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect())
    quota = dict(zip([g for g, _ in groups], splitting_tree([n for _, n in groups], shards, seed), strict=True))

    def dealt_group(key, t):
        import pyarrow as pa

        t = t.sort_by("s")
        ends = deal(t["n"].to_pylist(), quota[key[0].as_py()], seed * 1_000_003 + key[0].as_py()).cumsum(axis=1)
        return pa.table({"s": t["s"], "ends": pa.array(ends.tolist(), pa.list_(pa.int64()))})

    cuts = scratch.put(counts.groupBy("g").applyInArrow(dealt_group, "s long, ends array<long>"), "cuts")
    draws = blocks.where("passes > 0").select("s", "block", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))).alias("epoch"))
    draws = running(draws.withColumn("h", F.xxhash64("block", "epoch", F.lit(seed + 3))), ["s"], ["h", "block", "epoch"], F.lit(1), "before")
    dealt = draws.join(cuts, "s").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("before"))))
    dealt = dealt.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("to"))  # an entry a pass
    blocks = scratch.put(blocks.select("s", "block", "room").join(dealt, ["s", "block"], "left"), "dealt")

    own = Window.partitionBy("s", "block").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    got = at.withColumn("ahead", F.coalesce(F.sum("size").over(own), F.lit(0))).join(blocks, ["s", "block"])
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("ahead")))
    words = lambda e: F.when(e["epoch"] < F.col("epochs"), F.col("size")).otherwise(F.col("last"))
    got = got.withColumn("last", last.cast("long"))
    drawn = F.transform(F.col("to"), lambda e: F.struct(e["shard"].alias("shard"), e["epoch"].alias("epoch"), words(e).alias("words"), F.xxhash64("order", e["epoch"]).alias("place")))
    got = got.withColumn("draws", F.filter(F.coalesce(drawn, F.array().cast("array<struct<shard:int,epoch:int,words:bigint,place:bigint>>")), lambda d: d["words"] > 0))
    return got.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"), "draws", *keep)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
