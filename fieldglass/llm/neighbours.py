"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations learned on a bounded sample (principal directions, then iterative quantisation) turn vectors into binary
codes. A code is split into substrings of 32 bits, and each substring has a directory of its values with the rows of
each. Of codes within Hamming distance R some substring s differs in at most r[s] bits, where r[0] + ... + r[m - 1] =
R - m + 1 (the tight form of the pigeonhole), so probing every value of the directories within those radii finds all
codes within R. What is found is kept if its whole code is within R and ranked by cosine in double precision. R is set
on the sample, so that a share ``reach`` of true neighbours lies within it.

Scale: rows stay where they are read: a task gathers ``shard_rows`` of them, indexes them and streams the queries, which
are a table in the shared folder, past the index in blocks. Only each query's best k of a shard are shuffled. So all
rows are searched for the stated queries, in blocks, and nothing grows with a bucket's size. A query that finds fewer
than k rows within R in a shard takes the shard's k nearest codes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id. Vectors are compared with those of their own dimension; a dimension that the sample lacks is ranked
in full. A vec_id that repeats counts once: the best score of its vectors, as a query or as a row, stands. Equal scores
go to the smaller vec_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, table

#: Queries that go past an index together.
TOGETHER = 64


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Codes:
    """Mean, rotations to codes of 32-bit substrings, and the radius within which ``reach`` of a sample's true neighbours lie."""

    def __init__(self, sample: np.ndarray, k: int, reach: float, rotations: int = 2, seed: int = 1):
        x = unit_rows(sample)
        self.mean = x.mean(axis=0)
        c = x - self.mean
        _, v = np.linalg.eigh(c.T @ c)
        v = v[:, ::-1][:, :64]
        z, rng, maps = c @ v, np.random.default_rng(seed), []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
            for _ in range(30):
                u, _, t = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
                r = (u @ t).T
            maps.append(v @ r)
        self.map = np.concatenate(maps, axis=1)
        q = x[: min(512, len(x))]
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -9
        best = np.argsort(-s, axis=1)[:, : max(1, min(k, len(x) - 1))]
        code = self.of(sample)
        far = np.bitwise_count(code[: len(q), None, :] ^ code[best]).sum(axis=2) if len(x) > 1 else np.array([self.map.shape[1]])
        self.radius = int(np.quantile(far, reach, method="higher"))
        m = code.shape[1]
        spare = self.radius - m + 1
        #: How far each substring is probed; negative: not at all.
        self.each = [spare // m + (i < spare % m) for i in range(m)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """rows x substrings of 32-bit numbers."""
        bits = (unit_rows(vectors) - self.mean) @ self.map > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 32)))
        return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u4").astype(np.uint32)


class Index:
    """The directories of a shard's substrings: distinct values, and the rows that have each."""

    def __init__(self, codes: Codes, vectors: np.ndarray):
        self.codes, self.code = codes, codes.of(vectors)
        self.directories = [np.unique(self.code[:, s], return_inverse=True) for s in range(self.code.shape[1])]

    def probe(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """queries x rows: which rows a substring within its radius leads to, and which of them are within R."""
        met = np.zeros((len(asked), len(self.code)), bool)
        for s, (values, rows) in enumerate(self.directories):
            met |= (np.bitwise_count(values[None, :] ^ asked[:, s, None]) <= self.codes.each[s])[:, rows]
        return met, met & (self.distances(asked) <= self.codes.radius)

    def distances(self, asked: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asked), len(self.code)), np.uint16)
        for s in range(self.code.shape[1]):
            out += np.bitwise_count(self.code[None, :, s] ^ asked[:, s, None])
        return out


def search(index: Index | None, ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """(query number, row number, score) of each query's best k rows of different ids; without an index of all rows."""
    out = []
    squares, qsquares = (vectors * vectors).sum(axis=1), (queries * queries).sum(axis=1)
    enough = k + len(ids) - len(np.unique(ids))  # so many rows have k ids, the query's own left out
    for at in range(0, len(qids), TOGETHER):
        part = slice(at, at + TOGETHER)
        other = ids[None, :] != qids[part, None]
        if index is None:
            hit = other
        else:
            asked = index.codes.of(queries[part])
            hit = index.probe(asked)[1] & other
            for i in np.flatnonzero(hit.sum(axis=1) < enough):
                far = np.where(other[i], index.distances(asked[i : i + 1])[0], 60_000)
                hit[i] = other[i] & (far <= (np.partition(far, enough - 1)[enough - 1] if len(far) > enough else 60_000))
        i, j = np.nonzero(hit)
        # the root of the product: of equal vectors the score is 1, not near it
        score = (vectors[j] * queries[at + i]).sum(axis=1) / np.sqrt(squares[j] * qsquares[at + i])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        if enough > k:  # of an id's vectors the best
            _, first = np.unique(np.stack([i, ids[j]]), axis=1, return_index=True)
            first.sort()
            i, j, score = i[first], j[first], score[first]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((at + i[nth < k], j[nth < k], score[nth < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def by_dimension(ids, lists):
    """dimension -> (ids, vectors as doubles) of Arrow columns of ids and lists."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    starts, ids = np.r_[0, np.cumsum(sizes)[:-1]], ids.to_numpy(zero_copy_only=False)
    return {int(d): (ids[sizes == d], flat[starts[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def usable(embeddings: DataFrame, *more: str) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select("vec_id", *more, v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def samples_of(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """dimension -> vectors of a sample of at most 2 * ``most`` rows, chosen by a hash of vec_id."""
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, most / max(n, 1)) + 1))
    got = part.select("vec_id", "v").orderBy("vec_id", "v").limit(2 * most).toArrow().combine_chunks()
    return {d: x for d, (_, x) in by_dimension(got["vec_id"].chunk(0), got["v"].chunk(0)).items()} if got.num_rows else {}


def sample_of(rows: DataFrame, most: int) -> np.ndarray:
    """The sample's vectors of its most frequent dimension; of equals the larger."""
    found = samples_of(rows, most)
    return max(found.values(), key=lambda x: (len(x), x.shape[1])) if found else np.zeros((0, 0))


def stored_blocks(path: str, rows: int):
    """(vec_id, v) of a table in the shared folder, as Arrow batches of at most so many rows."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    for b in ds.dataset(root, filesystem=store, format="parquet").to_batches(columns=["vec_id", "v"], batch_size=rows):
        if b.num_rows:
            yield b


def nearest(embeddings: DataFrame, is_query, k: int = 5, sample_rows: int = 8000, reach: float = 0.95, shard_rows: int = 16384, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (a column over vec_id) holds."""
    rows = usable(embeddings)
    models = {d: Codes(x, k, reach) for d, x in samples_of(rows, sample_rows).items()}
    asked = Scratch(embeddings.sparkSession, "queries")
    asked.put(rows.where(is_query).select("vec_id", "v"), "asked")
    path = asked.path("asked")

    def run(batches):
        import pyarrow as pa

        def shard(held):
            t = pa.Table.from_batches(held).combine_chunks()
            sides = by_dimension(t["vec_id"].chunk(0), t["v"].chunk(0))
            made = {d: Index(models[d], v) if d in models else None for d, (_, v) in sides.items()}
            for b in stored_blocks(path, block_queries):
                for d, (qids, q) in by_dimension(b.column(0), b.column(1)).items():
                    if d in sides:
                        ids, v = sides[d]
                        i, j, s = search(made[d], ids, v, qids, q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(qids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= shard_rows:
                yield from shard(held)
                held, n = [], 0
        if held:
            yield from shard(held)

    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").transform(arrow, run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
