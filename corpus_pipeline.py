"""A corpus pipeline of five of the operators: quality, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, table
from fieldglass.llm.mixing import mix_sources
from fieldglass.llm.near_dedup import near_duplicates
from fieldglass.llm.packing import pack
from fieldglass.llm.quality import train, with_scores
from fieldglass.llm.suffix_dedup import strip_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; the others go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model, "__fg_score").where("__fg_score >= 0.7").select(*docs.columns)


#: A text without such a character has no word and is no copy of anything.
WORDED = r"[^\x20\x09-\x0D]"


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (of the smallest doc_id, null last) of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Groups are of rows: rows may repeat, ids may be null or carry several texts. A row is told by 128 bits of its id and
    text, so no copy of the texts is written; of rows alike in both, one stays. Rows without a word stay.
    """
    worded = F.coalesce(F.col("text").rlike(WORDED), F.lit(False))
    own = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("text")]
    rows = docs.where(worded).withColumns({"__fg_a": F.xxhash64(*own), "__fg_b": F.xxhash64(F.lit(7), *reversed(own))})
    near = near_duplicates(rows.select(F.col("__fg_a").alias("doc_id"), "text", F.col("doc_id").alias("id"), "__fg_b"), k=5, threshold=80, keep=("id", "__fg_b"))
    each = near.groupBy("component_id", F.col("doc_id").alias("__fg_a"), "__fg_b", "id").agg(F.count(F.lit(1)).alias("__fg_n"))
    order = F.struct(F.col("id").isNull(), "id", "__fg_a", "__fg_b", "__fg_n")
    stay = each.groupBy("component_id").agg(F.min(order).alias("s")).select("s.__fg_a", "s.__fg_b", "s.__fg_n")
    kept = rows.join(Scratch(spark, "stay").put(stay, "rows"), ["__fg_a", "__fg_b"])
    alike = kept.where("__fg_n > 1").dropDuplicates(["__fg_a", "__fg_b"])
    return kept.where("__fg_n = 1").select(*docs.columns).unionByName(alike.select(*docs.columns)).unionByName(docs.where(~worded))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur anywhere else; n_chars follows the text."""
    cut = strip_repeats(docs, span=200)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each as often as it is drawn; of a source's last document the nearer of all or nothing."""
    rows = Scratch(spark, "rows").put(docs.withColumn("__fg_key", F.monotonically_increasing_id()), "keyed")  # as ids may repeat or be null
    drawn = F.size(F.filter("draws", lambda d: 2 * d["words"] >= F.col("size")))
    plan = mix_sources(rows, keep=("__fg_key",)).select("__fg_key", drawn.alias("__fg_n")).where("__fg_n > 0")
    rows = rows.join(plan, "__fg_key")
    return rows.withColumn("__fg_copy", F.explode(F.sequence(F.lit(1), F.col("__fg_n")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, best-fit decreasing."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


#: Tokenizers, hashes and a fitted model have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
