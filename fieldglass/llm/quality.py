"""Quality classifier by Bradley-Terry pairwise ranking.

Each document's whole text becomes a vector: its words and word pairs (lower case) hashed into buckets, whose weights
are learned, and shape features (repetition, symbols, lengths, lines). Preference pairs set a document labelled 1
above one labelled 0; a logistic loss on the differences of their features learns the strength of a document. The cut
is the quantile of training strengths that parts the labels best, and the score is a logistic curve through ``cut``
at 0.7, so "score >= 0.7" is the threshold by quantile.

Scale: the fit takes at most ``max_labelled`` labelled ids by hash and ``n_pairs`` pairs, both bounds whatever the input,
and finds its rows by a broadcast of that bounded table; scoring is one pass over the texts without a shuffle.

Defined cases: null text counts as empty; empty texts have features (zeros) and a score. A null doc_id is not held out
and has no label. Labels that are null, or differ for one doc_id, teach nothing; of a labelled id's several texts one
does. Without labels of both kinds every score is 0.7. Repeated rows are scored each. An empty table gives no rows. Only
doc_id and text make a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import kernels as K
from fieldglass.llm.common import arrow, table

#: Buckets of hashed words and word pairs.
HASHED = 128
SYMBOLS = b"*$%&|#@<>{}[]=_~^+/\\"
NAMES = ["log_bytes", "log_words", "word_length", "distinct_words", "same_as_last", "distinct_lines", "words_a_line", "stops", "commas", "digits", "capitals", "not_ascii", "blank", "symbols", *(f"byte_{chr(c)}" for c in SYMBOLS), "same_log", "symbols_log", "distinct_low", "length_gap", "longest_word", "short_words"]


def features(text: bytes) -> list[float]:
    """The shape features of a text, as NAMES."""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    distinct = len(set(words)) / k
    same = sum(map(bytes.__eq__, words, words[1:])) / k
    symbols = float(h[list(SYMBOLS)].sum()) / n
    length = sum(map(len, words)) / k
    return [
        float(np.log1p(n)), float(np.log1p(k)), length, distinct, same, len(set(lines)) / len(lines), float(np.log1p(k / len(lines))),
        float(h[46]) / k, float(h[44]) / k, float(h[48:58].sum()) / n, float(h[65:91].sum()) / n, float(h[128:].sum()) / n, float(h[32]) / n, symbols,
        *(float(np.log1p(100.0 * h[c] / k)) for c in SYMBOLS),
        float(np.log1p(100 * same)), float(np.log1p(1000 * symbols)), max(0.0, 0.5 - distinct), abs(length - 5.0), float(np.log1p(max(map(len, words)))), float(k < 20),
    ]


def hashed(words: np.ndarray, woffs: np.ndarray) -> np.ndarray:
    """rows x HASHED: roots of the shares of a text's words and word pairs that fall into each bucket."""
    n, k = len(woffs) - 1, np.diff(woffs)
    row = np.repeat(np.arange(n), k)
    pair = row[1:] == row[:-1]
    two = K.mix(words[:-1][pair] ^ (words[1:][pair] << np.uint64(1)))
    bucket = np.concatenate([words, two]) % np.uint64(HASHED)
    at = np.concatenate([row, row[1:][pair]]) * HASHED + bucket.astype(np.int64)
    return np.sqrt(np.bincount(at, minlength=n * HASHED).reshape(n, HASHED) / np.maximum(2 * k - 1, 1)[:, None])


def vectors(texts) -> np.ndarray:
    """One row of features for each text of an Arrow string column (null: empty)."""
    parts = [np.zeros((0, len(NAMES) + HASHED))]
    for _, data, offs in K.text_chunks(texts):
        raw = data.tobytes()
        shape = np.array([features(raw[a:e]) for a, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
        parts.append(np.concatenate([shape, hashed(*K.word_hashes(data, offs))], axis=1))
    return np.concatenate(parts)


def _featured(batches):
    import pyarrow as pa

    for b in batches:
        x = vectors(b.column(2)).astype("<f4")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "q", "x"])


def fit(x: np.ndarray, y: np.ndarray, n_pairs: int = 100_000, l2: float = 1e-3, l2_hashed: float = 0.1, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Means, scales, weights, cut and steepness of the ranking learned from rows x with labels y."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(np.flatnonzero(y == 1), n_pairs), rng.choice(np.flatnonzero(y == 0), n_pairs)
    ridge = np.r_[np.full(len(NAMES), l2), np.full(x.shape[1] - len(NAMES), l2_hashed)]
    w = np.zeros(x.shape[1])
    for size in (min(n_pairs, 10_000), n_pairs):  # a start on some of the pairs, then all
        for _ in range(30):  # Newton steps on mean log(1 + exp(-w.d)) + ridge/2 w^2
            g, h = ridge * w, np.diag(ridge)
            for at in range(0, size, 10_000):
                d = z[better[at : min(at + 10_000, size)]] - z[worse[at : min(at + 10_000, size)]]
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
                g = g - p @ d / size
                h = h + (d * (p * (1 - p))[:, None]).T @ d / size
            step = np.linalg.solve(h, g)
            w = w - step
            if np.abs(step).max() < 1e-4:
                break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ys, n1, n0 = y[order], y.sum(), len(y) - y.sum()
    gain = np.cumsum(np.where(ys == 0, 1 / n0, -1 / n1))  # balanced accuracy of rejecting the lowest i + 1
    i = int(np.argmax(gain))
    cut = float(s[order[i]] + s[order[min(i + 1, len(s) - 1)]]) / 2
    steep = 2.0 / max(float(np.std(s)), 1e-6)
    return mean, scale, w, cut, steep


class Model:
    """A fitted ranking, or None of it: without labels of both kinds every score is 0.7."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n_pairs: int):
        self.fitted = fit(x, y, n_pairs) if len(set(y.tolist())) == 2 else None

    def scores(self, texts) -> np.ndarray:
        """The scores of an Arrow string column."""
        if self.fitted is None or not len(texts):
            return np.full(len(texts), 0.7)
        mean, scale, w, cut, steep = self.fitted
        z = np.clip((vectors(texts) - mean) / scale, -8, 8)
        s = (z * w).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(np.log(0.7 / 0.3) + (s - cut) * steep, -500, 500)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 50_000, n_pairs: int = 100_000) -> Model:
    """Learn from at most about ``max_labelled`` labelled rows, chosen by hash; never from rows held out."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q1")).where("q = q1").select("doc_id", "q").where(~held_out())
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_labelled / n))
    text = F.col("text").cast("string").alias("text")
    # the broadcast side has max_labelled rows, give or take the hash's scatter
    some = docs.select("doc_id", text).join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("q").cast("int").alias("q"), "text")
    rows = some.transform(arrow, _featured, "doc_id long, q int, x binary").groupBy("doc_id", "q").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(rows.num_rows, len(NAMES) + HASHED).astype(np.float64)
    return Model(x, rows["q"].to_numpy(), n_pairs)


def with_scores(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the column ``out``, by one pass over the texts and no shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = model.scores(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(scores)], [*b.schema.names[:-1], out])

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{out}` double"])
    return docs.select("*", F.col("text").cast("string").alias("__fg_text")).transform(arrow, run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 50_000, n_pairs: int = 100_000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels, max_labelled, n_pairs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
