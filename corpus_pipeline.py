"""The training-data pipeline over `documents`: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm import darts, decontamination, lines, pieces, toxicity
from stagelight.llm.queries import PIECES, table
from stagelight.sources.scratch import scratch_dir


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows whose text scores 0.5 or more go. The model learns from labelled rows of `docs`."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and rows without a word left by that; n_chars follows the text."""
    out = lines.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class stays."""
    return darts.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated rows go, all others stay as they are."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every text and what decoding gives."""
    return pieces.encode(docs, PIECES)


STAGES = [("toxicity", civil), ("line dedup", fresh_lines), ("near dedup", one_of_each), ("decontamination", clean), ("sentencepiece", encoded)]

#: SQL can express neither the compression distance nor the signatures or pieces; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs
