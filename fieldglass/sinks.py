"""Writers: Parquet, one-file and exact-float CSV, row splices, fingerprints, pointers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_rows(df: DataFrame, order: list[Column], out: str, keep: list[str] | None = None) -> DataFrame:
    """Number all rows from 0 in an order: a range-partitioned sort, then each partition's start is a sum of the sizes
    before it. No window over the whole table; the driver sees a count a partition. The sorted rows (of ``keep``, these
    columns only) are kept in the shared folder with their places, as a second sort might cut partitions elsewhere."""
    from fieldglass.store import stored

    keep = df.columns if keep is None else keep
    at = df.orderBy(*order).select(*keep, F.monotonically_increasing_id().alias("_at"))  # its high bits are the sorted partition
    at = stored(at, "ordered").select("*", F.shiftright("_at", 33).cast("int").alias("_p"))
    sizes = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.array(*[F.lit(s) for s in starts or [0]]), F.col("_p") + 1)
    return at.select((base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(out), *keep)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_ordered(df: DataFrame, path: str, keys: list[str], files: int = 1) -> None:
    """Parquet in zstd, range-partitioned and sorted by unique keys; readers find the order within and between files."""
    from fieldglass.operators.joins import duplicates, require_empty

    require_empty(duplicates(df, keys), f"keys {keys} are not unique")
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def splice_lines(spark, template: str, out: str, fresh: DataFrame, is_fresh: str) -> None:
    """A CSV (ID,Pred) with the lines of ids that match ``is_fresh`` replaced by ``fresh`` (ID, Pred as text), in the template's
    order; every other line keeps its bytes. Lines are numbered by their place in the file, not by a sort of their content."""
    from fieldglass.operators.joins import require_empty

    lines = spark.read.text(template).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("row_ord long, line string")
    lines = lines.withColumn("ID", F.split("line", ",")[0])
    new = fresh.select("ID", F.concat_ws(",", "ID", "Pred").alias("_new"))
    hit = (F.col("row_ord") > 0) & F.col("ID").rlike(is_fresh)
    both = lines.join(new, "ID", "left")
    require_empty(both.where(hit & F.col("_new").isNull()).select("ID"), "a line to replace has no value")
    both.select("row_ord", F.when(hit, F.col("_new")).otherwise(F.col("line")).alias("line")).coalesce(1).sortWithinPartitions("row_ord").select("line").write.mode("errorifexists").text(out)


def write_pairs(men: DataFrame, women: DataFrame, path: str, stream: str = "stream") -> DataFrame:
    """Every stream of one population with every stream of the other: one folder of rows a pair (``candidate``), written in one
    job; the pairs (names only). Rows are (stream, ID, p)."""
    names = men.select(F.col(stream).alias("_m")).distinct().crossJoin(women.select(F.col(stream).alias("_w")).distinct()).withColumn("candidate", F.concat_ws("-", "_m", "_w"))
    sides = [t.join(names, F.col(stream) == F.col(c)).select("candidate", "ID", "p") for t, c in ((men, "_m"), (women, "_w"))]
    sides[0].unionByName(sides[1]).repartition("candidate").sortWithinPartitions("candidate", "ID").write.mode("errorifexists").partitionBy("candidate").parquet(path)
    return names.select("candidate")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file with a header, in the frame's order; for reports."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def exact_floats(df: DataFrame) -> DataFrame:
    """Doubles as text with 17 significant digits, which read back to the same bits."""
    return df.select(*[F.format_string("%.17g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def splice(template: DataFrame, fresh: DataFrame, key: str, is_fresh: Column, value: str) -> DataFrame:
    """The template's rows in its order (``row_ord``), with values of the chosen population from ``fresh``; the others' untouched."""
    new = fresh.select(key, F.col(value).alias("_new"))
    return template.join(new, key, "left").withColumn(value, F.when(is_fresh, F.col("_new")).otherwise(F.col(value))).drop("_new").orderBy("row_ord")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
