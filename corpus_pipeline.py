"""A corpus pipeline: five stages, each a Spark job over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode
from millrace.llm.common import read_table, stage_table
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.minhash import drop_near_duplicates
from millrace.llm.quality import quality
from millrace.llm.queries import vocab_path
from millrace.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000  # rows that pass to a Python worker at once; with whole texts, this bounds its memory


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, to be handed to Python in small batches."""
    docs.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject."""
    scored = toxicity(_documents(docs), read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer does not reject."""
    scored = quality(_documents(docs), read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(_documents(docs), width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return drop_contaminated(_documents(docs), read_table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to the same text."""
    coded = encode(_documents(docs).select("doc_id", "text"), vocab_path(), decode_too=True, keep_text=True)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("bpe", encode_texts),
]

ORACLE_SQL = None  # learned scores and near-duplicate groups have no SQL form; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next stage.

    The session's setting of batch rows is put back at the end.
    """
    before = spark.conf.get(BATCH_SETTING)
    docs = read_table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stage_table(docs, name)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
