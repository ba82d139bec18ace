"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessarine.llm import decision_list, line_dedup, minhash, mixing, packing
from tessarine.llm.common import dropped, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return decision_list.reject_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 5 documents share go, except in the document with the largest id."""
    out = line_dedup.drop_repeated_lines(docs).drop("n_lines", "n_dropped")
    return out.selectExpr(*["CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return minhash.keep_one_each(docs, k=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their target weights."""
    return mixing.mix(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of 1024 tokens."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("near-duplicates", near_duplicates), ("source mix", source_mix), ("packing", packing_)]

#: Learned rules, MinHash and byte-pair encoding have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as keep:  # what a stage wrote on its way goes
            done = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        dropped(docs)
        docs = done
    return docs
