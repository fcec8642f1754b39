"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm import line_dedup, near_dedup, packing, quality, suffix_dedup
from plumbline.llm.base import small_batches


def _with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, with the new text and its length; a null text stays null where nothing was taken."""
    now = {"text": F.when(F.col("row.text").isNull(), F.col("row.text").cast("string")).otherwise(text)}
    now["n_chars"] = F.length(now["text"]).cast("long")
    return rows.select(*[(now[c] if c in now else F.col("row")[c]).alias(c) for c in docs.columns])


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier, moved by the rates of their source and language, holds to be bad or toxic."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


@small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that stand on more than a twentieth of a source's different documents, so that no group of copies drops its own text."""
    return _with_text(line_dedup.drop_site_lines(docs, copies_once=True), docs, F.col("text"))


@small_batches
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.keep_one(docs)


@small_batches
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 200 and more that also start elsewhere."""
    return _with_text(suffix_dedup.drop_repeats(docs), docs, F.col("text"))


@small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("suffix dedup", suffix_stage), ("packing", packing_stage)]

#: Models, tokens and shared byte strings are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = session.written(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
