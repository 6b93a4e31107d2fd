"""CSV catalogues with declared schemas, exact floats, gzip; strict JSON; Parquet with pushdown."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from fieldglass.schema import SCHEMAS


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Sorted paths of a folder's files with the suffix, through Hadoop, so any store works; none is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        raise FileNotFoundError(folder)
    found = sorted(s.getPath().toString() for s in store.listStatus(path) if s.getPath().getName().endswith(suffix))
    if not found:
        raise FileNotFoundError(f"no {suffix} files in {folder}")
    return found


def csv_catalog(spark: SparkSession, folder: str, views: bool = False) -> dict[str, DataFrame]:
    """Every CSV of the folder by its stem. Known stems have declared schemas and fail on bad rows; others are strings."""
    out = {}
    for path in list_files(spark, folder, ".csv"):
        stem = PurePosixPath(path).stem
        reader = spark.read.option("header", True).option("mode", "FAILFAST")
        schema = SCHEMAS.get(stem.lstrip("MW")) or SCHEMAS.get(stem)
        out[stem] = (reader.schema(schema) if schema else reader).csv(path)
        if views:
            out[stem].createOrReplaceTempView(stem)
    return out


def latin1_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)


def strict_json(text: str, most: int = 16 << 20):
    """Parse JSON that has no repeated keys, NaN or Infinity and at most ``most`` bytes."""
    if len(text.encode()) > most:
        raise ValueError("the JSON document is too large")

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("a JSON object repeats a key")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
