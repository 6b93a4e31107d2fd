"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at cosine >= t are at distance <= eps = sqrt(2 - 2 t). Vectors of a label are sorted by the cells of an eps
grid on 16 leading principal directions (learned on a bounded sample), so that what is near in space is near in the
sequence. The sequence is cut into blocks; two blocks meet only if their boxes in the leading directions are within
eps, and the join then halves both intervals recursively, skipping pairs of intervals whose boxes are provably
further apart. In what is left, a pair's distance in the leading directions is a lower bound too: only pairs within
eps there get their cosine, in double precision.

Scale: equal vectors are one class with a count, so copies never meet. A task holds two blocks. It returns counts of
links and a union-find forest of them, at most one edge a vector, never the pairs. Where the vectors of a label have
no structure in any direction, boxes overlap and all pairs of that label's blocks meet, which is quadratic in them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link
with nothing (n_links 0, component their own id). Vectors of different dimensions don't link. Repeated vec_ids count
once (of several vectors or labels the least, in Spark's order) and are returned each. A null vec_id has a null
component and is kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, connected_components, shuffle_width, table
from fieldglass.llm.neighbours import sample_of, unit_rows, usable

SLACK = 1e-9


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, eps: float, same: bool, leaf: int = 256):
    """Blocks (i0, i1, j0, j1) of the two sequences that may hold a pair within eps; ``same``: only i0 <= j0."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1 or same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(px[a0:a1].min(axis=0) - py[b0:b1].max(axis=0), py[b0:b1].min(axis=0) - px[a0:a1].max(axis=0)))
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            yield a0, a1, b0, b1
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
        else:
            m = (b0 + b1) // 2
            stack += [(a0, a1, b0, m), (a0, a1, m, b1)]


def within(p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs of rows of p and q are within eps in the leading directions, give or take SLACK."""
    gap = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
    return gap <= eps * eps + SLACK


def links(xa, pa_, wa, xb, pb, wb, threshold: float, eps: float, same: bool, exact):
    """Counts of links of both sides (weighted by the other side's class sizes), and forest edges (i in a, j in b)."""
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    parent = np.arange(len(xa) + (0 if same else len(xb)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for a0, a1, b0, b1 in join_intervals(xa, pa_, xb, pb, eps, same):
        near = within(pa_[a0:a1], pb[b0:b1], eps)
        if not near.any():
            continue
        if near.mean() > 0.1:
            s = xa[a0:a1] @ xb[b0:b1].T
        else:
            s = np.full(near.shape, -2.0)
            i, j = np.nonzero(near)
            s[i, j] = (xa[a0 + i] * xb[b0 + j]).sum(axis=1)
        hit = s >= threshold
        for i, j in np.argwhere(np.abs(s - threshold) < SLACK):
            hit[i, j] = exact(a0 + i, b0 + j) >= threshold
        if same:
            hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not hit.any():
            continue
        na[a0:a1] += hit @ wb[b0:b1]
        nb[b0:b1] += wa[a0:a1] @ hit
        roots = np.array([find(j) for j in range(b0 if same else len(xa) + b0, b1 if same else len(xa) + b1)])
        for i in np.flatnonzero(hit.any(axis=1)):
            for r in np.unique(roots[hit[i]]):
                p, q = find(a0 + i), find(r)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    edges.append((a0 + i, b0 + int(np.flatnonzero(hit[i] & (roots == r))[0])))
    return na, nb, edges


def similar_embeddings(embeddings: DataFrame, threshold: float = 0.93, leading: int = 16, sample_rows: int = 8000, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ego")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kind = embeddings.schema["label"].dataType.simpleString()
    rows = usable(embeddings, "label").where("label is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    key = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(9), "v", "label").alias("h2")]
    rows = scratch.put(rows.select("vec_id", "label", "v", *key), "rows")
    classes = rows.groupBy("h1", "h2", "label", F.size("v").alias("dim")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    sample = sample_of(rows, sample_rows)
    if not len(sample):
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sample.shape[1]
    _, v = np.linalg.eigh(np.cov(unit_rows(sample).T) if len(sample) > 1 else np.eye(dim))
    axes = np.atleast_2d(v)[:, ::-1][:, :leading]

    def placed(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(4).to_pylist():
                u = np.array(x)
                u = u / np.sqrt((u * u).sum())
                # of another dimension: no leading directions, so boxes never part such vectors
                out.append((u @ axes).tolist() if len(x) == dim else [0.0] * axes.shape[1])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(out, pa.list_(pa.float64()))], ["rep", "n", "label", "dim", "v", "p"])

    lead = scratch.put(classes.select("rep", "n", "label", "dim", "v").transform(arrow, placed, f"rep long, n long, label {kind}, dim int, v array<double>, p array<double>"), "lead")
    cells = [F.floor(F.col("p")[i] / eps).alias(f"g{i}") for i in range(axes.shape[1])]
    order = ["label", "dim", *[f"g{i}" for i in range(axes.shape[1])], "rep"]

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, last, at = TaskContext.get().partitionId(), -1, None, 0
        for b in batches:
            out = []
            for group in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if group != last or at == block:
                    number, last, at = number + 1, group, 0
                at += 1
                out.append(part << 32 | number)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(out, pa.int64())], ["rep", "n", "label", "dim", "v", "p", "block"])

    seq = lead.select("*", *cells).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    seq = scratch.put(seq.select("rep", "n", "label", "dim", "v", "p").transform(arrow, cut, f"rep long, n long, label {kind}, dim int, v array<double>, p array<double>, block long"), "sequence")
    dims = range(axes.shape[1])
    low, high = (F.array(*[f(F.col("p")[i]) for i in dims]) for f in (F.min, F.max))
    boxes = scratch.put(seq.groupBy("label", "dim", "block").agg(low.alias("low"), high.alias("high")), "boxes")
    salts = max(1, min(256, boxes.count() // 512))  # so a label's blocks meet in several tasks
    a = boxes.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).alias("a")
    b = boxes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).alias("b")
    meet = F.lit(True)
    for c in ("label", "dim", "salt"):
        meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    gap = lambda x, y: F.zip_with(x, y, lambda l, h: F.greatest(l - h, F.lit(0.0)))  # noqa: E731, E741
    apart = F.zip_with(gap(F.col("a.low"), F.col("b.high")), gap(F.col("b.low"), F.col("a.high")), lambda x, y: F.greatest(x, y))
    meet = meet & (F.col("a.block") <= F.col("b.block")) & (F.aggregate(apart, F.lit(0.0), lambda t, x: t + x * x) <= (eps + SLACK) ** 2)
    pairs = scratch.put(a.join(b, meet).select(F.col("a.block").alias("x"), F.col("b.block").alias("y")), "pairs")
    sides = pairs.select("x", "y", F.col("x").alias("block")).unionByName(pairs.select("x", "y", F.col("y").alias("block"))).distinct()

    def joined(t):
        import pyarrow as pa

        x, blk = t.column("x")[0].as_py(), t.column("block").to_numpy()
        rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        p = t.column("p").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        g = np.floor(p / eps)
        by = np.lexsort((rep, *g.T[::-1]))
        ia = by[blk[by] == x]
        same = t.column("x")[0].as_py() == t.column("y")[0].as_py()
        ib = ia if same else by[blk[by] != x]
        u = unit_rows(v)
        exact = lambda i, j: float((v[ia[i]] * v[ib[j]]).sum() / (np.sqrt((v[ia[i]] ** 2).sum()) * np.sqrt((v[ib[j]] ** 2).sum())))
        na, nb, edges = links(u[ia], p[ia], n[ia], u[ib], p[ib], n[ib], threshold, eps, same, exact)
        total = np.zeros(len(rep), np.int64)
        total[ia] += na
        total[ib] += nb
        some = np.flatnonzero(total)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"edge": np.r_[np.zeros(len(some), bool), np.ones(len(e), bool)], "a": np.r_[rep[some], rep[ia[e[:, 0]]]], "b": np.r_[total[some], rep[ib[e[:, 1]]]]})

    out = sides.join(seq, "block").select("x", "y", "block", "rep", "n", "v", "p").groupBy("x", "y").applyInArrow(joined, "edge boolean, a long, b long")
    out = scratch.put(out, "found")
    counts = out.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    labels = connected_components(out.where("edge").select("a", "b"), scratch, "cc")
    per = classes.select("h1", "h2", "rep", "n").join(counts, "rep", "left").join(labels, F.col("rep") == F.col("id"), "left")
    per = per.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    known = rows.select(F.col("vec_id").alias("known"), "h1", "h2").join(per, ["h1", "h2"])
    got = embeddings.select("vec_id").join(known, F.col("vec_id") == F.col("known"), "left")
    got = got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_embeddings(table(spark, sf_dir, "embeddings"))
