"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set is its distinct k-word shingles (A-Z lower-cased, words parted by blank and 0x09-0x0D; fewer words:
the whole sequence). Documents are linked if 100 * intersection >= threshold * union. SuperMinHash gives each
element a random permutation of ranks over the signature's slots, so an element's values in the slots are
correlated, which lowers the variance, and rounds stop early once every slot holds a value below the next round's.
Bands of equal slots name candidates: with 32 bands of 5 a pair at similarity 0.8 is missed with
probability (1 - 0.8**5)**32 = 3e-6, at 0.9 with 4e-13.

Scale: equal sets are one class from a partial aggregate on, so copies never meet as pairs. In a bucket only pairs
with its most popular member are verified, then pairs with the most popular one left over, which joins most of a group. What is
still apart is compared across components inside tasks of two blocks, by products over shared items, and only links
leave a task. Sets that share too few items with any other candidate to reach the threshold are left out first (a
bound, so no link is lost). There is no cap.

Defined cases: null or empty text, or no word: empty set, linked with nothing. A null doc_id links with nothing; its
component is null and it is kept. Repeated rows of one doc_id and text are one node and all returned. Rows of one doc_id
with different texts are documents of their own: each has the component of its text, whose smallest doc_id counts.
Extra columns of the input don't matter: only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import kernels as K
from fieldglass.llm.common import Scratch, arrow, connected_components, table

U = np.uint64
NEVER = U(0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m signatures of the elements (64-bit hashes; rows: the row of each, ascending); no element: all NEVER.

    Round i draws for each element a value in [i, i + 1) and, by a step of a Fisher-Yates shuffle, the slot whose rank
    is i. All elements of a batch go through a round together; rows whose slots are all filled drop out.
    """
    sig = np.full(n_rows * m, NEVER, U)
    live = np.arange(len(elements))
    perm = None
    for i in range(m):
        if not len(live):
            break
        r = K.mix(elements[live] + U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = i + ((r & U(0xFFFFFFFF)) * U(m - i) >> U(32)).astype(np.int64)
        if i == 0:
            slot = k
        else:
            at = np.arange(len(live))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, i]
            perm[at, i] = slot
        np.minimum.at(sig, rows[live] * m + slot, (U(i) << U(32)) | (r >> U(32)))
        full = (sig.reshape(n_rows, m) != NEVER).all(axis=1)
        stay = ~full[rows[live]]
        if perm is None:
            live = live[stay]
            perm = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(live), m)).copy()
            first = k[stay]
            at = np.arange(len(live))
            perm[at, first], perm[at, 0] = 0, first
        elif not stay.all():
            live, perm = live[stay], perm[stay]
    return sig.reshape(n_rows, m)


def signature_rows(texts, k: int, bands: int, width: int):
    """For an Arrow string column: set sizes, two 64-bit digests of each set and n x bands hashes of its bands."""
    sizes, one, two, band = [], [], [], []
    for _, data, offs in K.text_chunks(texts):
        words, woffs = K.word_hashes(data, offs)
        sh, soffs = K.shingles(words, woffs, k)
        n = len(offs) - 1
        row = np.repeat(np.arange(n), np.diff(soffs))
        order = np.lexsort((sh, row))
        sh, row = sh[order], row[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
        sh, row = sh[new], row[new]
        cuts = np.searchsorted(row, np.arange(n))
        sizes.append(np.bincount(row, minlength=n))
        for out, salt in ((one, 0x51), (two, 0xA7)):
            s = np.zeros(n + 1, U)
            c = np.concatenate([[U(0)], np.cumsum(K.mix(sh + U(salt)))]).astype(U)
            s = c[np.append(cuts[1:], len(sh))] - c[cuts]
            out.append(K.mix(s ^ sizes[-1].astype(U)).view(np.int64))
        sig = super_minhash(sh, row, n, bands * width).reshape(n, bands, width)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93), (n, bands)).copy()
        for j in range(width):
            h = K.mix(h ^ sig[:, :, j]) + U(j + 1)
        band.append(h.view(np.int64))
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
    return np.concatenate(sizes), np.concatenate(one), np.concatenate(two), np.concatenate(band)


def _signatures(k: int, bands: int, width: int):
    """Of doc_id, text and more columns, which pass through."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, one, two, band = signature_rows(b.column(1), k, bands, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands), pa.int32()), pa.array(band.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n), pa.array(one), pa.array(two), lists], ["doc_id", *b.schema.names[2:], "n_shingles", "c", "c2", "bands"])

    return run


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, data, offs in K.text_chunks(b.column(1)):
                words, woffs = K.word_hashes(data, offs)
                sh, soffs = K.shingles(words, woffs, k)
                parts = [np.unique(sh[a:e]) for a, e in zip(soffs[:-1], soffs[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                flat = np.concatenate(parts) if parts else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(parts)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["c", "items"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("c").alias("a"), F.col("items").alias("ia"))
    b = sets.select(F.col("c").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ia", "ib")))
    return both.where(100 * F.col("common") >= threshold * (F.size("ia") + F.size("ib") - F.col("common"))).select("a", "b").distinct()


def _shareable(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, e): how many items of each class's set occur in another of these classes, so the most it can share with one."""
    items = sets.join(classes, "c", "left_semi").select("c", F.explode("items").alias("item"))
    met = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c"))
    own = met.where("df = 1").groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    full = sets.join(classes, "c", "left_semi").select("c", F.size("items").alias("size"))
    return full.join(own, "c", "left").select("c", (F.col("size") - F.coalesce("own", F.lit(0))).alias("e"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, members.c == labels.id, "left").select(*[members[x] for x in members.columns], F.coalesce("label", "c").alias("label"))


def overlaps(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right, by products over 4096 items at a time."""
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, item, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = times[item] > 1
    rows, item = rows[shared], item[shared]
    order = np.argsort(item, kind="stable")
    rows, item = rows[order], item[order]
    item = np.cumsum(np.r_[False, item[1:] != item[:-1]]) if len(item) else item
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        p = slice(*np.searchsorted(item, [lo, lo + 4096]))
        m = np.zeros((len(items), 4096), np.float32)
        m[rows[p], item[p] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _between(threshold: int):
    """Links across labels within two blocks of a bucket: one for each pair of labels that isn't joined otherwise."""

    def run(t):
        import pyarrow as pa

        c, label, n, e, own = (t.column(x).to_numpy() for x in ("c", "label", "n", "e", "own"))
        band, one_block = t.column("band")[0].as_py(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        ok = label[:, None] < label[None, :]
        if not one_block:
            ok &= own[:, None] != own[None, :]
        ok &= threshold * (n[:, None] + n[None, :]) <= (100 + threshold) * np.minimum(e[:, None], e[None, :])
        for k in range(band):  # a pair is looked at in the first band that it shares
            ok &= bands[:, None, k] != bands[None, :, k]
        left, right = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        a, b = [], []
        if len(left):
            lists = t.column("items").combine_chunks()
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            common = overlaps([flat[offs[i] : offs[i + 1]] for i in range(len(c))], left, right)
            hit = ok[np.ix_(left, right)] & ((100 + threshold) * common >= threshold * (n[left][:, None] + n[right][None, :]))
            i, j = (x[y] for x, y in zip((left, right), np.nonzero(hit), strict=True))
            _, some = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)
            a, b = c[i[some]], c[j[some]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Members of a bucket, and items of their sets, that one block holds on average; a task compares two blocks.
BLOCK = 1024
BLOCK_ITEMS = 1_000_000


def _across(at: DataFrame, sets: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of a bucket whose labels differ. Pairs are compared inside a task, block by block, and
    only links leave it."""

    def mixed(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        return rows.join(keys.select("key", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("items") / BLOCK_ITEMS)).cast("int").alias("k")), "key")

    rows = mixed(at.select("key", "band", "c", "n", "label"))
    # what shares too few of its items with any other can link with none
    rows = rows.drop("k").join(_shareable(rows.select("c").distinct(), sets), "c").where(threshold * F.col("n") <= 100 * F.col("e"))
    rows = mixed(rows).withColumn("own", F.pmod(F.xxhash64("c"), "k").cast("int"))
    dealt = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    rows = rows.select("key", "band", "c", "n", "label", "e", "own", F.explode(dealt).alias("p")).select("key", "band", "c", "n", "label", "e", "own", "p.i", "p.j")
    full = rows.join(sets, "c").join(classes.select("c", "bands"), "c")
    return full.groupBy("key", "i", "j").applyInArrow(_between(threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, bands: int = 32, width: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), and the columns of ``keep``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    signed = scratch.put(src.transform(arrow, _signatures(k, bands, width), f"doc_id long{more}, n_shingles long, c long, c2 long, bands array<long>"), "signed")
    some = signed.where("doc_id is not null and n_shingles > 0")
    # a class is told by its id and the hash of one of its texts: an id may have several texts, each of a class of its own
    classes = some.groupBy("c", "c2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("bands").alias("bands"))
    classes = scratch.put(classes.select("c", "c2", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("rep_th"), "bands"), "classes")

    banded = classes.select("c", "n", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "band", "c", "n")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    members = scratch.put(banded.join(shared, "key"), "members")
    near = lambda x, y: 100 * F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731  a bound on the similarity

    wanted = members.select("c").distinct().join(classes.select("c", "rep", "rep_th"), "c")
    texts = wanted.join(src, (F.col("rep") == F.col("doc_id")) & (F.col("rep_th") == F.col("th"))).select("rep", "rep_th", "c", "text")
    texts = texts.dropDuplicates(["rep", "rep_th"])  # repeated rows
    sets = scratch.put(texts.select("c", "text").transform(arrow, _sets(k), "c long, items array<long>"), "sets")
    popular = members.groupBy("c").agg(F.sum("met").alias("pop"))
    members = scratch.put(members.join(popular, "c").select("key", "band", "c", "n", "pop"), "popular")
    scratch.release("members")

    links, labels = None, None
    for turn in range(2):
        at = members.withColumn("label", F.col("c")) if turn == 0 else _labelled(members, labels)
        first = at.groupBy("key").agg(F.max(F.struct("pop", F.expr("-c"), "c", "n", "label")).alias("top"))
        at = at.join(first, "key")
        if turn:  # around the most popular member that the first centre's component leaves out
            at = at.drop("top").join(at.where(F.col("label") != F.col("top.label")).groupBy("key").agg(F.max(F.struct("pop", F.expr("-c"), "c", "n", "label")).alias("top")), "key")
        pairs = at.where(F.col("label") != F.col("top.label")).where(near(F.col("n"), F.col("top.n"))).select(F.least("c", "top.c").alias("a"), F.greatest("c", "top.c").alias("b"))
        pairs = scratch.put(pairs.distinct(), f"pairs{turn}")
        found = scratch.put(_verified(pairs, sets, threshold), f"links{turn}")
        scratch.release(f"pairs{turn}")
        if turn and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links, scratch, f"cc{turn}")
        scratch.release()
    rest = scratch.put(_across(_labelled(members, labels), sets, classes, threshold), "links2")
    scratch.release("popular", "sets")
    if not rest.isEmpty():
        labels = connected_components(links.unionByName(rest), scratch, "cc2")

    named = classes.join(labels, classes.c == labels.id, "left").select("c", "c2", "rep", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    comps = named.join(least, "label").select("c", "c2", "component_id")
    out = signed.drop("bands", "th").join(comps, ["c", "c2"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", comp.cast("long")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)
