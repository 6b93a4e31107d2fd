"""Spelling variant grouping: words within one edit of each other, by dense prefix-suffix tiling.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least ``least`` code points that occur at least twice
(A-Z lower-cased). Two are near if one inserted, deleted or replaced code point makes them equal. A word's form is its
most frequent near word (ties: smallest), if that is at least ``ratio`` times as frequent; its root is the end of the
chain of forms.

Tiles: the code points of a shorter word of s are parted into at most eight windows of two or more. Two words within one
edit agree on all before and all behind the window of the edit, so they meet in the tile of that prefix and suffix; a
word is in the tiles of s = its length and s = its length less one. In a tile words are rows of padded code-point
matrices, aligned left and right, and common prefix plus common suffix tells which pairs are one edit apart. Such a pair is
taken only in the tile of the window where its words first differ, so it comes once and nothing is made distinct afterwards.

Scale: texts give counts by word within a chunk, then partial aggregates; words of a task cross the shuffle once. Tiles are
keyed by a hash and stream in the order of their keys; words that differ only within two code points are few, and a
tile with more than ``BLOCK`` is dealt over pairs of blocks, a task's unit. No pair but near ones leaves a task. Chains are
followed by doubling; as counts grow at least tenfold a step, a few rounds end them.

Defined cases: null or empty text: no words. A null doc_id counts as the empty string where runs are altered by id. Repeated
rows count as often as they stand. Very long runs are words like others. An empty table gives no rows. Other columns
don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import kernels as K
from fieldglass.llm.common import Scratch, arrow, table

#: Words of a tile that one block holds on average.
BLOCK = 2048
#: Rows that are compared at once, and bytes of their words.
ROWS, BYTES = 20_000, 8 << 20
#: The longest runs of which checksums are taken side by side, a byte a step.
SIDE_BY_SIDE = 64


def _checksum_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


CHECKSUM = _checksum_table()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of a text whose crc32 is ``before`` and that goes on with data[start:end]."""
    out = np.empty(len(start), np.int64)
    size = end - start
    for r in np.flatnonzero(size > SIDE_BY_SIDE):
        out[r] = zlib.crc32(data[start[r] : end[r]], int(before[r]))
    some = np.flatnonzero(size <= SIDE_BY_SIDE)
    some = some[np.argsort(-size[some], kind="stable")]
    state, first = before[some].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), start[some]
    going = np.searchsorted(-size[some], -np.arange(size[some[0]] if len(some) else 0), "left")
    for t, n in enumerate(going):
        now = state[:n]
        state[:n] = CHECKSUM[(now ^ data[first[:n] + t]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[some] = state ^ np.uint32(0xFFFFFFFF)
    return out


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte of UTF-8 texts (A-Z lower-cased) belongs to a letter, and whether it is the second byte of one."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3  # U+00C0 to U+00FF begin with this byte, which begins nothing else
    return ((data >= 0x61) & (data <= 0x7A)) | (data == 0xC3) | second, second


def _counted(least: int, damage: int):
    """(word, occurrences) of the words of chunks of texts. ``damage``: where it divides the crc32 of ``<id>:<run>``, the run
    loses the code point at that checksum modulo its length; 0: runs stay as they are."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, data, offs in K.text_chunks(b.column(1)):
                low = K.LOWER[data]
                solid, second = letters(low)
                start, end, roffs = K.runs(solid, offs)
                seconds = np.concatenate([[0], np.cumsum(second)])
                size = end - start - (seconds[end] - seconds[start])
                row = np.repeat(np.arange(len(offs) - 1), np.diff(roffs))
                keep = size >= least
                start, end, size, row = start[keep], end[keep], size[keep], row[keep]
                altered: Counter = Counter()
                if damage and len(start):
                    heads = [zlib.crc32(f"{'' if ids[lo + r] is None else ids[lo + r]}:".encode()) for r in range(len(offs) - 1)]
                    h = checksums(low, start, end, np.array(heads, np.int64)[row])
                    hit = h % damage == 0
                    heads_of = np.flatnonzero(~second)  # first bytes of code points
                    at = heads_of[np.searchsorted(heads_of, start[hit]) + h[hit] % size[hit]]
                    for a, c, e, n in zip(start[hit].tolist(), at.tolist(), end[hit].tolist(), size[hit].tolist(), strict=True):
                        if n > least:
                            altered[low[a:c].tobytes() + low[c + (2 if low[c] == 0xC3 else 1) : e].tobytes()] += 1
                    start, end = start[~hit], end[~hit]
                _, one, times = np.unique(K.spans_hash(low, start, end), return_index=True, return_counts=True)
                raw = low.tobytes()
                words = [raw[a:e] for a, e in zip(start[one].tolist(), end[one].tolist(), strict=True)]
                words += list(altered)
                n = np.concatenate([times, np.fromiter(altered.values(), np.int64, len(altered))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2, damage: int = 0) -> DataFrame:
    """(word, n) of the words of all texts with at least so many code points and occurrences."""
    src = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = src.transform(arrow, _counted(least, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def width(s):
    """Code points of a window of a shorter word of s, and how many windows there are."""
    w = np.maximum(2, -(-s // 8))
    return w, -(-s // w)


def _cells(least: int):
    """A row for every tile of every word: key, s, window."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, data, offs in K.text_chunks(b.column(0)):
                second = letters(data)[1]
                codes = np.where(data == 0xC3, 0, data)
                codes[second] = data[second] + 0x40  # one byte a code point, as in the code points themselves
                codes, offs = codes[data != 0xC3], offs - np.concatenate([[0], np.cumsum(data == 0xC3)])[offs]
                size = np.diff(offs)
                word = np.repeat(np.arange(len(size)), 2)
                s = size[word] - np.tile([0, 1], len(size))
                word, s = word[s >= least], s[s >= least]
                w, q = width(s)
                word, s, w = np.repeat(word, q), np.repeat(s, q), np.repeat(w, q)
                i = np.arange(len(word)) - np.repeat(np.cumsum(q) - q, q)
                a, e = offs[word], offs[word + 1]
                head = K.spans_hash(codes, a, a + i * w)
                tail = K.spans_hash(codes, e - np.maximum(0, s - (i + 1) * w), e)
                key = K.mix(head ^ K.mix(tail + s.astype(K.U) * K.U(0x9E3779B97F4A7C15) + i.astype(K.U)))
                row = pa.array(word + lo)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(i.astype(np.int32)), b.column(0).take(row), b.column(1).take(row)], ["key", "s", "i", "word", "n"])

    return run


def near_pairs(tile: np.ndarray, s: np.ndarray, i: np.ndarray, words: list[bytes], apart: np.ndarray | None = None):
    """Pairs of rows (of one tile, ascending) that are one edit apart and first differ in the tile's window.

    ``words``: a byte a code point. ``apart``: rows with the same value aren't compared, -1: with all."""
    size = np.array([len(x) for x in words])
    left, right = [], []
    lengths = 1 << np.ceil(np.log2(np.maximum(s + 1, 32))).astype(np.int64)
    for wide in np.unique(lengths):  # matrices of words of like lengths
        rows = np.flatnonzero(lengths == wide)
        at_left = np.frombuffer(b"".join(words[r].ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
        at_right = np.frombuffer(b"".join(words[r].rjust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
        t, n, k, u = tile[rows], size[rows], i[rows], s[rows]
        w, q = width(u)
        a = np.arange(len(rows))
        step = max(1, (4 << 20) // int(wide))
        for d in range(1, len(rows)):
            a = a[a + d < len(rows)]
            a = a[t[a] == t[a + d]]
            if not len(a):
                break
            for c in range(0, len(a), step):
                x = a[c : c + step]
                y = x + d
                ok = (u[x] == u[y]) & (k[x] == k[y]) & (np.minimum(n[x], n[y]) == u[x])
                if apart is not None:
                    ok &= (apart[rows[x]] != apart[rows[y]]) | (apart[rows[x]] < 0)
                x, y = x[ok], y[ok]
                before = np.argmin(at_left[x] == at_left[y], axis=1)
                x, y, before = (z[np.minimum(before // w[x], q[x] - 1) == k[x]] for z in (x, y, before))
                behind = np.argmin((at_right[x] == at_right[y])[:, ::-1], axis=1)
                near = before + behind >= np.maximum(n[x], n[y]) - 1
                left.append(rows[x[near]])
                right.append(rows[y[near]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near(batches):
    """Both directions (word, other, m: the other's n) of near pairs; rows come in the order of their tiles, and a tile that
    goes on in the next batch waits for it."""
    import pyarrow as pa

    def compared(t):
        keys = np.stack([t.column(c).to_numpy() for c in ("key", "bi", "bj")])
        new = np.ones(t.num_rows, bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        words = [w.encode("latin-1") for w in t.column("word").to_pylist()]
        own = np.where(keys[1] == keys[2], -1, t.column("own").to_numpy())
        a, b = near_pairs(np.cumsum(new), t.column("s").to_numpy().astype(np.int64), t.column("i").to_numpy(), words, own)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        word, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))], ["word", "other", "m"])

    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= ROWS or size >= BYTES:
            t = pa.Table.from_batches(held)
            last = tuple(t.column(c)[-1].as_py() for c in ("key", "bi", "bj"))
            same = np.ones(t.num_rows, bool)
            for c, v in zip(("key", "bi", "bj"), last, strict=True):
                same &= t.column(c).to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield compared(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            rows, size = t.num_rows - cut, sum(x.nbytes for x in held)
    if held:
        yield compared(pa.Table.from_batches(held))


def near_words(words: DataFrame, least: int = 7) -> DataFrame:
    """(word, other, m) for every ordered pair of near words of the table (word, n); m is the other's n."""
    cells = words.transform(arrow, _cells(least), "key long, s int, i int, word string, n long")
    hot = cells.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("k"))
    one = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))
    dealt = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, "own").alias("bi"), F.greatest(o, "own").alias("bj")))
    rows = cells.join(hot, "key", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("word"), "k"), F.lit(0)).cast("int"))
    rows = rows.withColumn("p", F.explode(F.when(F.col("k").isNull(), one).otherwise(dealt))).select("key", "p.bi", "p.bj", "own", "s", "i", "word", "n")
    by = ["key", "bi", "bj"]
    return rows.repartition(*by).sortWithinPartitions(*by).transform(arrow, _near, "word string, other string, m long")


#: Doublings of chains of forms: 2**7 steps, more than counts of 64 bits can grow tenfold.
ROUNDS = 7


def variants(words: DataFrame, least: int = 7, ratio: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near, root of every row of (word, n)."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    chosen = F.col("best.m") * -1 >= F.col("n") * ratio
    formed = words.join(best, "word", "left").select(
        "word", "n", F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )
    formed = scratch.put(formed, "formed")
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(ROUNDS):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch.put(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k}")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(table(spark, sf_dir, "documents"), least=7, occurrences=2, damage=31)
    return variants(words, least=7, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")
