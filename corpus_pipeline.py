"""From raw documents to a training mix: each stage applies one operator of the subpackage to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import quality
from vellum.llm.common import Scratch
from vellum.llm.decontam import without_leaks
from vellum.llm.linededup import LineDedup
from vellum.llm.mixing import mix
from vellum.llm.neardup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _of_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled rows of ``docs``."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_scores(docs, model).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in the last of them only; a null text stays null."""
    docs = docs.select(*COLUMNS)
    return _of_documents(LineDedup(spark).build(docs).apply(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows with a null id stay.

    Rows that repeat an id are one document, of which one row stays.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_repeated"))
    left = docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")
    left = left.join(repeated, left.doc_id == repeated["_repeated"], "left")
    once = left.where("_repeated is not null").dropDuplicates(["doc_id"])
    return left.where("_repeated is null").unionByName(once).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixed order; all sources have the same target weight."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS, "mix_block", "mix_slot", "mix_position")


STAGES = [("quality", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: Models and signatures have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
