"""Stages of the corpus pipeline on tables with repeated rows, null ids and ids of several texts."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from fieldglass.llm import quality
from fieldglass.llm.tokens import coder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text):
    return (i, text, "en", "s", len(text or ""))


def words(lead, n=60):
    return " ".join(f"{lead}{i}" for i in range(n))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d, e = (words(x) for x in "abcde")
    rows = [
        *[row(1, a)] * 3, row(2, a), row(None, a),  # repeated rows and a copy under a null id
        row(None, b), row(None, b + " tail"),  # null ids only
        row(5, c), row(5, d), row(4, d), row(6, c),  # an id of two texts, kept for one of them
        row(7, e), row(8, None), row(8, None), row(None, ""),  # alone, and sets without items
    ]
    got = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect())
    of_b = [x for x in got if x in (row(None, b), row(None, b + " tail"))]
    assert len(of_b) == 1
    assert got == Counter([row(1, a), of_b[0], row(5, c), row(4, d), row(7, e), row(8, None), row(8, None), row(None, "")])


def test_near_dedup_without_rows(spark):
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_quality_keeps_all_rows_of_a_good_score(spark, tmp_path):
    good = [words(f"word{i}of", 40).capitalize() + "." for i in range(60)]
    bad = [" ".join([f"b{i}"] * 60) for i in range(60)]
    rows = [row(i, t) for i, t in enumerate(good + bad)]
    rows += [rows[0], rows[0], rows[100], row(None, good[1]), row(None, bad[1]), row(7, bad[2]), row(None, None), row(500, "")]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    texts = docs.select("text").distinct()
    score = {r.text: r.s for r in quality.with_scores(texts.withColumn("doc_id", F.lit(1)), quality.train(docs, labels), "s").collect()}
    expect = Counter(r for r in rows if score[r[1]] >= 0.7)
    assert 0 < len(expect) < len(set(rows))
    assert Counter(tuple(r) for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()) == expect
    assert corpus_pipeline.quality(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_passages_are_cut_and_lengths_follow(spark):
    passage = words("passage", 30)
    assert len(passage) > 200
    texts = [words("x", 20) + passage + words("y", 9), passage + words("z", 30), words("alone"), words("twice"), words("twice"), None, ""]
    ids = [1, 2, 3, 4, 4, None, None]
    rows = [row(i, t) for i, t in zip(ids, texts, strict=True)]
    seen = Counter(t[k : k + 200] for t in texts if t for k in range(len(t) - 199))
    expect = Counter()
    for i, t in zip(ids, texts, strict=True):
        gone = {p for k in range(len(t or "") - 199) if seen[t[k : k + 200]] > 1 for p in range(k, k + 200)}
        cut = t if t is None else "".join(c for p, c in enumerate(t) if p not in gone)
        expect[i, cut, None if cut is None else len(cut)] += 1
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.repeated_passages(spark, docs, "")
    assert got.schema == docs.schema
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == expect
    assert corpus_pipeline.repeated_passages(spark, docs.limit(0), "").count() == 0


def test_mix_draws_each_row_by_itself(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 90), ("b", 60), (None, 40)):
        for i in range(n):  # half of the ids null, some ids of two rows
            text = words(f"{s}{i}_", rng.randint(1, 30))
            rows.append((None if i % 2 else i // 3, text, "en", s, len(text)))
    rows += rows[:5]
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    all_ = sum(size.values())
    want = {"a": all_ / 6, "b": all_ / 3, None: all_ / 2}
    if want[None] > 3 * size[None]:  # what it can't take goes to the others by weight
        rest = all_ - 3 * size[None]
        want = {"a": rest / 3, "b": 2 * rest / 3, None: 3 * size[None]}
    assert all(want[s] <= 3 * size[s] for s in want)
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    for s, target in want.items():
        assert abs(sum(len(r[1].split()) * n for r, n in got.items() if r[3] == s) - target) <= 15 + 1  # half a document, rounding
    times = Counter(rows)
    for r, n in times.items():
        epochs = int(want[r[3]] // size[r[3]])
        assert epochs * n <= got[r] <= (epochs + 1) * n
    assert set(got) <= set(times)
    assert corpus_pipeline.mixed(spark, docs.limit(0), "").count() == 0


def test_mix_does_not_depend_on_partitions(spark):
    rows = [(None, words(f"t{i}_", 3), "en", "b" if i % 3 else "a", 9) for i in range(90)] + [(1, words(f"u{i}_", 3), "en", "a", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = (Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs.repartition(n, F.col(c)), "").collect()) for n, c in ((2, "text"), (5, "n_chars")))
    assert a == b and len(set(a.values())) > 1


def pieces(rows):
    """Pieces of each id; no sequence is longer than it may be."""
    fill, length = Counter(), Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
        length[r.doc_id] += r.length
    assert all(n <= 2048 for n in fill.values())
    return length


def test_packing_holds_every_token_of_every_row(spark):
    rows = [row(1, words("a")), row(1, words("a")), row(2, words("long", 3000)), row(None, words("b")), row(None, None), row(3, "")]
    model = coder("byte_bpe_50k.json", True).model
    expect = Counter()
    for i, t, *_ in rows:
        expect[i] += len(model.encode(t or "", add_special_tokens=False).ids) + 1
    docs = spark.createDataFrame(rows, DOCS)
    assert pieces(corpus_pipeline.packed(spark, docs, "").collect()) == expect
    assert corpus_pipeline.packed(spark, docs.limit(0), "").count() == 0


def test_run_keeps_whole_text_of_one_row_of_each_group(spark, tmp_path):
    a, b, c = (words(x) for x in "abc")
    rows = [*[row(1, a)] * 3, row(None, a), row(None, b), row(None, b), row(5, c), row(6, c)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")  # of one kind: all rows stay
    for name, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    model = coder("byte_bpe_50k.json", True).model
    # of one source each row is drawn once
    assert pieces(corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((1, a), (None, b), (5, c))}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
