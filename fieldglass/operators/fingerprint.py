"""Exact fingerprints of ordered vectors: a tree of SHA-256 over their little-endian doubles."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.sinks import ordered_rows
from fieldglass.store import stored

#: Doubles of a leaf, and digests of a node.
LEAF, NODE = 65_536, 1024


def _leaf(t):
    import pyarrow as pa

    t = t.sort_by("_place")
    values = t.column("value").combine_chunks().fill_null(float("nan")).to_numpy().astype("<f8")
    return pa.table({"key": t.column("key")[:1], "at": t.column("at")[:1], "digest": pa.array([hashlib.sha256(values.tobytes()).digest()], pa.binary())})


def _node(t):
    import pyarrow as pa

    t = t.sort_by("at")
    digest = hashlib.sha256(b"".join(t.column("digest").to_pylist())).digest()
    return pa.table({"key": t.column("key")[:1], "at": t.column("up")[:1], "digest": pa.array([digest], pa.binary())})


def vector_fingerprint(df: DataFrame, key: str, order: list[Column], value: str, leaf: int = LEAF, node: int = NODE) -> DataFrame:
    """(key, n, fingerprint): SHA-256 of a key's doubles in order, unknown ones as NaN.

    Up to ``leaf`` values it is the digest of their bytes. Longer vectors are cut into leaves, and digests are hashed
    ``node`` at a time until one is left; so equal vectors have equal fingerprints, and no task holds more than a leaf or a
    node, however long a key's vector is. One range-partitioned sort numbers the rows; levels are tables of digests."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    rows = ordered_rows(rows, [F.col("key"), *[F.col(f"_o{i}") for i in range(len(order))]], "_n").select("key", "value", "_n")
    starts = stored(rows.groupBy("key").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("n")), "starts")
    placed = rows.join(starts.select(F.col("key").alias("_k"), "_first"), F.col("key").eqNullSafe(F.col("_k"))).withColumn("_place", F.col("_n") - F.col("_first"))
    placed = placed.select("key", "value", "_place", F.expr(f"_place div {leaf}").alias("at"))
    schema = "key string, at long, digest binary"
    level = stored(placed.groupBy("key", "at").applyInArrow(_leaf, schema), "leaves")
    size = -(-(starts.agg(F.max("n")).first()[0] or 0) // leaf)
    while size > 1:
        level = stored(level.withColumn("up", F.expr(f"at div {node}")).groupBy("key", "up").applyInArrow(_node, schema), "level")
        size = -(-size // node)
    out = level.select(F.col("key").alias("_k"), F.lower(F.hex("digest")).alias("fingerprint"))
    return starts.join(out, F.col("key").eqNullSafe(F.col("_k"))).select(F.col("key").alias(key), "n", "fingerprint")
