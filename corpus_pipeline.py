"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import brown, lines, nearcopies, packing, quality
from quern.llm.common import durable, join_groups, swept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.7 or more; the model learns from labelled rows as op1 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~brown.held_out(F.col("doc_id"), 4, 2))
    swept(spark)
    return quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines of any length but for their first occurrence; n_chars follows the text."""
    swept(spark)
    kept = lines.drop_recurring_lines(docs, min_tokens=1, long=lines.LONG)
    swept(spark)
    chars = F.when(F.col("dropped_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars.cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one of the smallest id, null ids last.

    Rows are told apart by id and text, so a repeated or null id takes no other text along.
    """
    swept(spark)
    found = durable(nearcopies.near_copies(docs))
    total = found.count()
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "node")).alias("first")
    least = durable(found.groupBy("root").agg(first, F.count("*").alias("members")))
    rows = join_groups(found, least, "root", "members", total).withColumn("kept", F.expr("doc_id <=> first.doc_id AND node = first.node"))
    rows = durable(rows.groupBy("doc_id", "node").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"))
    swept(spark)
    keyed = docs.withColumn("__node", nearcopies.node_of("text")).alias("d")

    def same(few: DataFrame) -> DataFrame:
        return few.select(F.col("doc_id").alias("__id"), F.col("node").alias("__of"))

    on = F.expr("__node = __of AND doc_id <=> __id")
    kept = keyed.join(same(rows.where("NOT kept")), on, "left_anti")
    repeated = same(rows.where("kept"))
    single = kept.join(repeated, on, "left_anti")
    return single.unionByName(kept.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "__node"])).select(*docs.columns)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids and the ids' checksums."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixture_packing", mixture_packing),
]

#: Learned scores and streaming packing can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through STAGES; each stage's result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
