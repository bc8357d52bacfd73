"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import curriculum
from quillstat.llm._tables import crc_mod, keyed_rows, store, text_digest, without
from quillstat.llm.decontaminate import contaminated
from quillstat.llm.exact_dedup import drop_copies
from quillstat.llm.ngram_jaccard import drop_near_copies
from quillstat.llm.quality import score_quality

#: Documents scored below this are rejected.
QUALITY = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is not below QUALITY."""
    usable = crc_mod(F.col("doc_id"), 5) != 0
    return score_quality(docs, _table(spark, sf_dir, "labels"), usable).where(F.col("quality_score") >= QUALITY).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; rows are told apart by id and text."""
    digest = text_digest(F.col("text"))
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("key"), "text")
    found = contaminated(keyed, _table(spark, sf_dir, "benchmark"), id_col="key")
    leaks = store(found.select(F.col("key.id").alias("gone_id"), F.col("key.digest").alias("gone_digest")).distinct(), "leaks")
    return without(keyed_rows(docs, "doc_id", digest), leaks).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takings of the mix in training order: doc_id, source, size, source_size, target, taken, position."""
    return curriculum.in_training_order(curriculum.mix(docs))


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_leaks), ("source mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, "pipeline-stage")
    return docs


#: SQL can't express the classifier.
ORACLE_SQL = None
