"""Shared helpers of the corpus operators: scratch tables, gapless ranks, components.

Nothing here imports the rest of the library, and nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that part words, as a Java/regex class; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own if unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="fieldglass-"))
        root = _OWN[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    # with its scheme, so that readers and writers outside Spark mean the same store
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return (full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


#: A function over Arrow batches gets at most so many rows and bytes at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded memory: f gets slices of BATCH_ROWS rows or BATCH_BYTES (a longer row alone), whatever
    the session's batches, and what a task has freed is given back to the system, as idle workers live on."""
    return df.mapInArrow(_bounded(f), schema)


def slices(batches, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """The batches cut into slices, without a copy."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            step = min(rows, b.num_rows - at)
            while step > 1 and b.slice(at, step).nbytes > size:
                step = -(-step // 2)
            yield b.slice(at, step)
            at += step


def _bounded(f):
    def run(batches):
        try:
            yield from f(slices(batches))
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


class Scratch:
    """Tables written to the shared folder to cut lineage and survive lost executors.

    Tables whose readers are done can be dropped at once; the rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self, *names: str) -> None:
        """Drop tables that are read no more, and let Spark's cleaner see that finished plans' shuffles aren't needed."""
        import gc

        for name in names:
            self.drop(name)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may already be down; the folder is the cluster's to clear then
            pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, keys: list[str], spread, order: list, out: str, buckets: int, first=None) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without ever sorting a whole key in one task.

    ``spread`` is a column to hash into ``buckets`` sub-groups of a key; rows are numbered within a sub-group and
    shifted by the sizes of the sub-groups before it. ``first`` may name a small integer column that takes
    precedence over the sub-group. The table of shifts has at most (keys x values of first x buckets) rows.
    """
    pre = [first] if first else []
    b = df.withColumn("_b", F.pmod(F.xxhash64(spread, F.lit(77)), F.lit(buckets)).cast("int"))
    sizes = b.groupBy(*keys, *pre, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(*pre, "_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, *pre, "_b").orderBy(*order)
    ranked = b.withColumn("_r", F.row_number().over(own) - 1)
    on = None
    for k in [*keys, *pre, "_b"]:
        c = ranked[k].eqNullSafe(shift[k])
        on = c if on is None else on & c
    joined = ranked.join(shift, on, "left")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_s") + F.col("_r")).cast("long").alias(out))


def _forest(batches):
    """Union-find over one partition's edges: a star for each local component, so at most one edge a node is left."""
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    def flush():
        nodes = np.fromiter(parent.keys(), np.int64, len(parent))
        roots = np.fromiter((find(x) for x in list(parent)), np.int64, len(parent))
        keep = nodes != roots
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:
            yield flush()
    yield flush()


#: Rounds of large-star and small-star, which settle in the order of log(nodes) squared; a chain of 2**40 nodes needs fewer.
ROUNDS = 200


def connected_components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, label) of every node of the edges (a, b); label is the smallest id reachable.

    A union-find pass in each partition leaves local stars; large-star and small-star rounds then join them until
    nothing changes. Each round is a partial aggregate and joins on node ids, and its edges are written to the
    shared folder; the driver only sees a count and a checksum. Labels that don't settle raise an error.
    """
    cur = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").transform(arrow, _forest, "a long, b long").distinct()
    cur = scratch.put(cur, f"{tag}-0")
    seen = None
    for k in range(1, ROUNDS + 1):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        cur = scratch.put(small, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        mark = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
