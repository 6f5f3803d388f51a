"""The corpus pipeline: documents through language, line, near-duplicate, benchmark and mixing stages.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's
``docs``. Nothing here bounds or samples the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlens.llm import decontaminate, language, line_dedup, mixing, simhash
from offerlens.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANG_SCORE = 0.4


def _documents(df: DataFrame, changed) -> DataFrame:
    """The columns of documents; ``n_chars`` follows where the text has changed."""
    return df.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language can't be told, go."""
    model = language.train(docs)
    found = language.identify(docs.select(*COLUMNS), model)
    # Without any labelled row there is no model, and a text with letters isn't rejected.
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE) if model.langs else F.col("text").rlike(r"\p{L}")
    return found.where(sure).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one; the documents all stay."""
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS)), F.col("n_dropped") > 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, once; so do all without an id, as nothing names them."""
    return simhash.keep_one(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.remove_contamination(docs.select(*COLUMNS), benchmark), F.col("n_cut") > 0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their sizes, their source's target and the copies taken."""
    sized = docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size"))
    plan = mixing.plan(stored(sized.select("doc_id", "source", "size"), "pipeline-sizes"))
    return mixing.take(sized, plan).where("copies > 0").drop("src")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", remove_benchmark),
    ("mix", mix_sources),
]

#: The language stage's model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
