"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are range-partitioned by doc_id, encoded whole, and written in that order into files of about ``file_ids``
ids. A file is self-contained: its table of ids by falling frequency (counted over all of the file's documents), its
documents' ids and token counts, two control bits a token that say how many bytes its rank takes (1 to 4), and the
ranks' bytes. Frequent ids so take one byte. Reading looks the four lengths of each control byte up in a table, sums
them to offsets and gathers.

Layout, little-endian: magic FGV1, u32 documents, u64 ids, u32 table length; u32 table; i64 doc_ids; u8 null flags;
u32 token counts; control bytes; data bytes.

Scale: one shuffle of the texts and one tokenizer pass; memory is one file's ids. Offsets of documents are sums over
the manifest, which has a row a file.

Defined cases: null text is an empty one: just the end id. Null doc_ids come first. Repeated rows are written each, in
the order of their texts' hashes. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, shuffle_width, table
from fieldglass.llm.files import read_file, write_file
from fieldglass.llm.tokens import coder, text_batches

MAGIC = b"FGV1"
HEAD = struct.Struct("<4sIQI")
#: For each control byte, the lengths of its four values.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: Bits that a value of so many bytes keeps.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
BLOCK = 1 << 20


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    control, data = [], []
    for at in range(0, len(values), BLOCK):
        v = values[at : at + BLOCK].astype("<u4")
        size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
        code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
        code[: len(v)] = size - 1
        code = code.reshape(-1, 4)
        control.append((code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values back, block by block, by table lookup of each control byte's lengths."""
    out, base = np.empty(n, np.uint32), 0
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    for at in range(0, n, BLOCK):
        k = min(BLOCK, n - at)
        size = LENGTHS[control[at // 4 : at // 4 + -(-k // 4)]].ravel()[:k]
        end = np.cumsum(size, dtype=np.int64) + base
        start = end - size
        v = data[start].astype(np.uint32)
        for j in (1, 2, 3):
            more = np.flatnonzero(size > j)
            v[more] |= data[start[more] + j].astype(np.uint32) << np.uint32(8 * j)
        out[at : at + k] = v & MASKS[size]
        base = int(end[-1])
    return out


def file_bytes(doc_ids: list, ids: list[bytes]) -> list[bytes]:
    """The parts of a file of these documents' ids (little-endian 32-bit)."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(flat)
    table_ = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype("<u4")
    rank = np.zeros(len(counts), np.uint32)
    rank[table_] = np.arange(len(table_), dtype=np.uint32)
    control, data = encode_values(rank[flat])
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return [
        HEAD.pack(MAGIC, len(doc_ids), len(flat), len(table_)),
        table_.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        nulls.tobytes(),
        np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
        control,
        data,
    ]


def parse_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids of a file."""
    magic, n_docs, n_ids, n_table = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, n, at)
        at += x.nbytes
        return x

    table_, docs, nulls, counts, control = take("<u4", n_table), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("u1", -(-n_ids // 4))
    ids = table_[decode_values(control, np.frombuffer(raw, np.uint8, offset=at), n_ids)] if n_ids else np.zeros(0, "<u4")
    return [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], counts, ids


def _write(folder: str, vocabulary: str, end_id: int, file_ids: int, specials_as_text: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        code, end, part = coder(vocabulary, False, specials_as_text), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        docs, ids, held, rows = [], [], 0, []

        def close():
            nonlocal docs, ids, held
            path = write_file(folder, f"tokens-{part:06d}-{len(rows):04d}", file_bytes(docs, ids))
            rows.append((part, len(rows), path, len(docs), held))
            docs, ids, held = [], [], 0

        for keys, texts in text_batches(batches):
            docs += keys.to_pylist()
            new = [x + end for x in code.encode(texts)]
            ids += new
            held += sum(map(len, new)) // 4
            if held >= file_ids:
                close()
        if docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "docs", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, file_ids: int = 4_000_000, specials_as_text: bool = False) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest (part, seq, path, docs, ids), to be kept by the caller.

    ``specials_as_text``: strings of special tokens (``<|endoftext|>``) are text; else they become those tokens.
    """
    n = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.transform(arrow, _write(folder, vocabulary, end_id, file_ids, specials_as_text), "part int, seq int, path string, docs long, ids long")


def _read(folder: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, counts, ids = parse_file(read_file(folder, path))
                ends = np.cumsum(counts, dtype=np.int64)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - counts + base, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the manifest's files."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.repartition(shuffle_width(manifest.sparkSession)).transform(arrow, _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    manifest = scratch.put(write_token_files(table(spark, sf_dir, "documents"), scratch.path("files")), "manifest")
    return read_token_files(manifest, scratch.path("files"))
