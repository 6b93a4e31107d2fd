"""Benchmark decontamination: a generalised suffix automaton of the test items' words, past which the documents' words stream.

Words are runs of 0-9, a-z (A-Z lower-cased) and everything from U+0080 on. A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window. The automaton of all items gives, after each word of a
document, the longest match that ends there and its state; each state knows for every window length the window that ends
there, and each window its items. A word inside any occurrence of a window is hit. ``remove_leaks`` cuts the hit spans out
and drops documents that are hit beyond a share of their words.

In numpy: a word that no item has resets the match, so documents fall into runs of known words, and runs shorter than
the shortest window are skipped. All runs of a batch take their steps side by side. Runs are cut into pieces that overlap
by a window less a word, so the lengths tracked are exact up to the longest window, beyond which nothing asks.

Scale: documents stream through map tasks and are never shuffled. Items are dealt over automata of about ``SHARD_WORDS``
words (a longer item in overlapping pieces), each built in a task and written to the shared folder; the driver sees their
paths and one count. A pass over the documents holds at most ``PASS`` automata; more of them take more passes, each
adding to what the one before wrote. So what a task holds is bounded whatever the benchmark's size. Words are compared by
64-bit hashes.

Defined cases: null or empty text, or no word: no words, not hit. Items without words have no window. Rows of one item_id
are windows of the same item; windows of a null item_id hit words but aren't counted as an item. Repeated documents and
null doc_ids are ordinary. An empty benchmark hits nothing; an empty table gives no rows. Other columns are carried if asked.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import kernels as K
from fieldglass.llm.common import Scratch, arrow, table
from fieldglass.llm.files import read_file, write_file

#: Words that one automaton takes on average, the longest piece of an item, and automata held at once.
SHARD_WORDS, PIECE_WORDS, PASS = 100_000, 20_000, 8
#: Steps that runs take side by side at most.
STEPS = 128
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def words(data: np.ndarray, offs: np.ndarray):
    """Starts, ends, hashes of the words of concatenated texts, and the rows' word offsets."""
    low = K.LOWER[data]
    start, end, woffs = K.runs(IS_WORD[low], offs)
    return start, end, K.spans_hash(low, start, end), woffs


class Automaton:
    """The suffix automaton of several word sequences, as arrays that can be written and read.

    ``length`` and ``link`` of the states, ``keys`` (state * number of words + word, ascending) with ``goto``, the sorted
    word hashes ``vocabulary``, for each of ``sizes`` (window lengths) the window that ends a state's strings or -1, and
    the items of each window (``first``, ``item``; ``counted``: its id isn't null).
    """

    FIELDS = ("vocabulary", "length", "link", "keys", "goto", "sizes", "ends", "first", "item", "counted")

    def __init__(self, **arrays):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    @classmethod
    def of(cls, sequences: list[np.ndarray], items: list, whole: list[bool], window: int) -> Automaton:
        """``whole``: the sequence is all of its item, so a window of its own if it is short."""
        vocabulary = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        v = max(len(vocabulary), 1)
        seqs = [np.searchsorted(vocabulary, s).tolist() for s in sequences]
        step: list[dict] = [{}]
        link, length = [-1], [0]

        def state(n: int, up: int, out: dict) -> int:
            length.append(n)
            link.append(up)
            step.append(out)
            return len(length) - 1

        def parted(p: int, w: int) -> int:
            """The state of p's longest string and the word w: that of the step, parted off where the step leads further."""
            q = step[p][w]
            if length[q] == length[p] + 1:
                return q
            part = state(length[p] + 1, link[q], dict(step[q]))
            link[q] = part
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = part
                p = link[p]
            return part

        for s in seqs:
            at = 0
            for w in s:
                if w in step[at]:
                    at = parted(at, w)
                    continue
                new, p = state(length[at] + 1, 0, {}), at
                while p >= 0 and w not in step[p]:
                    step[p][w] = new
                    p = link[p]
                if p >= 0:
                    link[new] = parted(p, w)
                at = new

        found: dict[tuple[int, int], dict] = {}
        for s, item, alone in zip(seqs, items, whole, strict=True):
            n = window if len(s) >= window else len(s) if alone else 0
            at = 0
            for i, w in enumerate(s):
                at = step[at][w]
                while n and length[link[at]] >= n:
                    at = link[at]
                if n and i >= n - 1:
                    found.setdefault((n, at), {})[item] = True
        sizes = sorted({n for n, _ in found})
        ends = np.full((len(sizes), len(length)), -1, np.int32)
        for k, (n, at) in enumerate(found):
            ends[sizes.index(n), at] = k
        for s in np.argsort(length, kind="stable")[1:]:  # a state's strings end with those of its link
            ends[:, s] = np.where(ends[:, s] >= 0, ends[:, s], ends[:, link[s]])
        keys = np.array([p * v + w for p, out in enumerate(step) for w in out], np.int64)
        goto = np.array([q for out in step for q in out.values()], np.int32)
        order = np.argsort(keys)
        every = [i for own in found.values() for i in own]
        first = np.cumsum([0] + [len(own) for own in found.values()])
        return cls(
            vocabulary=vocabulary, length=np.array(length, np.int32), link=np.array(link, np.int32), keys=keys[order], goto=goto[order], sizes=np.array(sizes, np.int32), ends=ends,
            first=first, item=np.array([0 if i is None else i for i in every], np.int64), counted=np.array([i is not None for i in every], bool),
        )

    def bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def read(cls, raw: bytes) -> Automaton:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{f: z[f] for f in cls.FIELDS})

    def matches(self, hashes: np.ndarray, woffs: np.ndarray):
        """(word position, window length, window) of every window's every occurrence that ends at a word of the rows."""
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not len(hashes):
            return none, none, none
        token = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        begin, end, _ = K.runs(self.vocabulary[token] == hashes, woffs)
        some = end - begin >= self.sizes[0]
        begin, end = begin[some], end[some]
        if not len(begin):
            return none, none, none
        overlap = int(self.sizes[-1]) - 1
        pieces = np.maximum(1, -(-(end - begin - overlap) // STEPS))
        begin, last = np.repeat(begin, pieces) + STEPS * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)), np.repeat(end, pieces)
        end = np.minimum(begin + STEPS + overlap, last)
        order = np.argsort(begin - end, kind="stable")  # longest first, so that those still going are the first ones
        begin, end = begin[order], end[order]
        going = np.searchsorted(begin - end, -np.arange(end[0] - begin[0]), "left")
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        out = []
        for t, n in enumerate(going):
            at, w = np.arange(n), token[begin[:n] + t]
            while len(at):
                key = state[at] * len(self.vocabulary) + w[at]
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[k] == key
                state[at[hit]] = self.goto[k[hit]]
                length[at[hit]] += 1
                at = at[~hit]
                state[at] = self.link[state[at]]
                length[at] = self.length[state[at]]
            for size, ends in zip(self.sizes, self.ends, strict=True):
                window = ends[state[:n]]
                r = np.flatnonzero((length[:n] >= size) & (window >= 0))
                if len(r):
                    out.append((begin[r] + t, np.full(len(r), size), window[r]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def _pieces(window: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, rows, lists, alone = b.column(0).to_pylist(), [], [], []
            for lo, data, offs in K.text_chunks(b.column(1)):
                _, _, h, woffs = words(data, offs)
                for r in range(len(offs) - 1):
                    own = h[woffs[r] : woffs[r + 1]]
                    for a in range(0, max(len(own) - window + 1, 1 if len(own) else 0), PIECE_WORDS):
                        rows.append(ids[lo + r])
                        lists.append(own[a : a + PIECE_WORDS + window - 1].view(np.int64))
                        alone.append(len(own) < window)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(alone, pa.bool_())], ["item_id", "words", "alone"])

    return run


def automata(items: DataFrame, folder: str, scratch: Scratch, window: int) -> list[str]:
    """Paths of the written automata of all items (item_id, text)."""
    src = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.put(src.transform(arrow, _pieces(window), "item_id long, words array<long>, alone boolean"), "pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def build(t):
        import pyarrow as pa

        seqs = [np.asarray(x, np.int64).view(np.uint64) for x in t.column("words").to_pylist()]
        auto = Automaton.of(seqs, t.column("item_id").to_pylist(), t.column("alone").to_pylist(), window)
        return pa.table({"path": [write_file(folder, "automaton", [auto.bytes()])]})

    dealt = pieces.groupBy(F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)).alias("shard"))
    return [r.path for r in scratch.put(dealt.applyInArrow(build, "path string"), "automata").collect()]  # a path a shard


def _scan(folder: str, paths: list[str], keep: int, last: bool, strip: float | None):
    """Columns: ``keep`` ones to pass on, text, and where there was a pass before: hit (word positions, each span's first and
    the one behind its last) and items."""

    def run(batches):
        import pyarrow as pa

        autos = [Automaton.read(read_file(folder, p)) for p in paths]
        for b in batches:
            for lo, data, offs in K.text_chunks(b.column(keep)):
                n = len(offs) - 1
                start, end, h, woffs = words(data, offs)
                edge = np.zeros(len(h) + 1, np.int64)
                rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                if b.num_columns > keep + 1:
                    for c, into in ((b.column(keep + 1).slice(lo, n), None), (b.column(keep + 2).slice(lo, n), items)):
                        row = np.repeat(np.arange(n), np.diff(c.offsets.to_numpy()))
                        flat = c.flatten().to_numpy()
                        if into is None:
                            at = flat + woffs[row]
                            np.add.at(edge, at[::2], 1)
                            np.add.at(edge, at[1::2], -1)
                        else:
                            rows.append(row)
                            into.append(flat)
                for auto in autos:
                    pos, size, window = auto.matches(h, woffs)
                    np.add.at(edge, pos - size + 1, 1)
                    np.add.at(edge, pos + 1, -1)
                    pair = np.unique(np.stack([np.searchsorted(woffs, pos, "right") - 1, window]), axis=1)
                    times = auto.first[pair[1] + 1] - auto.first[pair[1]]
                    which = np.repeat(auto.first[pair[1]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    ok = auto.counted[which]
                    rows.append(np.repeat(pair[0], times)[ok])
                    items.append(auto.item[which][ok])
                both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
                cut = np.searchsorted(both[0], np.arange(n + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cut), pa.array(both[1]))
                hit = np.cumsum(edge[:-1]) > 0
                first, behind, soffs = K.runs(hit, woffs)
                held = [c.slice(lo, n) for c in b.columns[: keep + 1]]
                if not last:
                    base = woffs[np.repeat(np.arange(n), np.diff(soffs))]
                    flat = np.stack([first - base, behind - base], axis=1).ravel()
                    spans = pa.ListArray.from_arrays(pa.array((2 * soffs).astype(np.int32)), pa.array(flat.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([*held, spans, found], [f"c{i}" for i in range(keep + 3)])
                    continue
                total = np.diff(woffs)
                hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[woffs])
                out = [*held[:keep], pa.array(total), pa.array(hits), found]
                if strip is not None:
                    gone = np.zeros(len(data) + 1, np.int64)
                    np.add.at(gone, start[first], 1)
                    np.add.at(gone, end[behind - 1], -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    sizes = np.concatenate([[0], np.cumsum(stay)])[offs]
                    text = pa.StringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes()))
                    out.append(pa.array(np.where(hits, 1, 0).astype(bool)))
                    out.append(text)
                    out = [c.filter(pa.array(hits <= strip * total)) for c in out]
                yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])

    return run


def _passes(docs: DataFrame, items: DataFrame, window: int, keep: list[str], strip: float | None) -> DataFrame:
    """The kept columns and n_words, n_hit, items; where stripping is asked for also whether the text is cut, and the cut text."""
    scratch = Scratch(docs.sparkSession, "leaks")
    folder = scratch.path("files")
    paths = automata(items, folder, scratch, window)
    groups = [paths[i : i + PASS] for i in range(0, len(paths), PASS)] or [[]]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("c_text"))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    k = len(keep)
    for i, group in enumerate(groups):
        last = i == len(groups) - 1
        more = ["n_words long", "n_hit long", "items array<long>"] + (["c_cut boolean", "c_text string"] if strip is not None else []) if last else ["c_text string", "hit array<long>", "items array<long>"]
        src = src.transform(arrow, _scan(folder, group, k, last, strip), ", ".join(schema + more))
        if not last:
            src = scratch.put(src, f"pass{i}")
    return src


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every document, with n_words, n_hit (words inside an occurrence of a window) and items (ids of the
    items with occurring windows, ascending)."""
    got = _passes(docs, items, window, list(keep), None)
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items")


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5) -> DataFrame:
    """The documents, all columns, without the spans that are hit; those hit in more than ``coverage`` of their words go.

    A span goes from its first word's first byte to its last word's last one. A null text stays null."""
    keep = [c for c in docs.columns if c != "text"] + ["text"]
    got = _passes(docs, items, window, keep, coverage)
    own = {c: F.col(f"c{i}") for i, c in enumerate(keep)}
    own["text"] = F.when(F.col("c_cut"), F.col("c_text")).otherwise(own["text"])
    return got.select(*[own[c].alias(c) for c in docs.columns])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
