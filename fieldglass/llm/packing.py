"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacities.

Lengths are at most the capacity, so all that best-fit decreasing looks at is how many pieces have each length.
The driver takes that histogram (at most ``capacity`` rows whatever the input), runs best fit over runs of equal
bins, and returns a table of runs: pieces number lo..hi of a length go to consecutive bins from ``first`` on, at an
offset. That is what placing the pieces one by one gives, as equal lengths are interchangeable. The tree holds
which remaining capacities have open bins, so the tightest that fits is found in log(capacity) steps. Pieces are
numbered within their length in parallel and looked up in the runs; no task sees more than its share.

Defined cases: null text is an empty one: just the end id. Repeated rows are packed each. Null doc_ids are ordinary.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, gapless_rank, shuffle_width, table
from fieldglass.llm.tokens import coder, text_batches


#: Runs follow from the lengths that occur, not from the input's size; more of them than this (20 MB) are not broadcast.
MOST_RUNS = 500_000


class CapacityTree:
    """Which remaining capacities have open bins; ``tightest(need)`` is the smallest that fits, or None."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.width
        self.open[at] = int(is_open)
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        at = need + self.width
        if self.open[at]:
            return need
        while at > 1:  # up to the first right sibling with an open bin, then down its left edge
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first bin, offset): pieces lo..hi-1 of that length, one to each bin from ``first`` on."""
    tree, bins, runs = CapacityTree(capacity), {}, []
    fresh = 0

    def keep(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            bins.setdefault(remaining, []).append((first, count))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        done, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            fits = (capacity if room is None else room) // length
            if room is None:
                first, count = fresh, -(-left // fits)
                fresh += count
                room = capacity
            else:
                first, count = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
            full = min(count, left // fits)
            for layer in range(fits if full else 0):
                runs.append((length, done, done + full, first, capacity - room + layer * length))
                done += full
            left -= full * fits
            keep(room - fits * length, first, full)
            if full < count:  # fewer pieces are left than the next bin holds
                some = left
                for layer in range(some):
                    runs.append((length, done, done + 1, first + full, capacity - room + layer * length))
                    done += 1
                left = 0
                keep(room - some * length, first + full, 1 if some else 0)
                keep(room, first + full + (1 if some else 0), count - full - (1 if some else 0))
    return runs


def _pieces(vocabulary: str, end_id: int, capacity: int, specials_as_text: bool):
    def run(batches):
        import pyarrow as pa

        code, end = coder(vocabulary, True, specials_as_text), end_id.to_bytes(4, "little")
        for ids, texts in text_batches(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, data in enumerate(code.encode(texts)):
                data += end
                n = len(data) // 4
                at, k = 0, 0
                size = n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = 2048, specials_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Longer documents are cut, their first piece is the shorter.

    ``specials_as_text``: strings of special tokens (``<|endoftext|>``) are text; else they become those tokens.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    pieces = scratch.put(texts.transform(arrow, _pieces(vocabulary, end_id, capacity, specials_as_text), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = best_fit_runs(histogram, capacity)
    runs = spark.createDataFrame(found, "of long, lo long, hi long, first long, offset long")
    if len(found) <= MOST_RUNS:
        runs = F.broadcast(runs)
    ranked = gapless_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"], "rank", shuffle_width(spark))
    placed = ranked.join(runs, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
