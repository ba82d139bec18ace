"""Exact token counts from a histogram of encoded lengths.

Documents are encoded once and only their lengths are aggregated (map side first). Suffix sums over the distinct lengths
then answer, for every context limit: how many documents fit, the tokens of those that fit, the tokens left when longer
documents are cut at the limit, and exact quantiles.

Nulls: a null text has length 0. Equal rows count each. An empty table gives an empty histogram. Other columns aren't read.
The window without a partition runs over one row per distinct length, never over documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens


def encoded_lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens and n_docs: the documents of each length, one row per length and batch."""
    at = path or tokens.vocabulary_path()

    def run(batches):
        enc = tokens.encoder(at)
        for batch in batches:
            for _, counts, _ in enc.encode(batch.column(0), with_ids=False):
                lengths, n = np.unique(counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), pa.array(n.astype(np.int64))], names=["n_tokens", "n_docs"])

    return docs.select(F.col(text_col)).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """One row per distinct length: n_tokens, n_docs."""
    return encoded_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, with n_tokens read as a context limit: docs_within, docs_beyond, tokens_within, tokens_beyond, truncated_total."""
    beyond = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("n_tokens") * F.col("n_docs")
    zero = F.lit(0).cast("long")
    summed = histogram.withColumns({"docs_beyond": F.coalesce(F.sum("n_docs").over(beyond), zero), "tokens_beyond": F.coalesce(F.sum(mass).over(beyond), zero)})
    summed = summed.withColumns({"docs_within": F.sum("n_docs").over(every) - F.col("docs_beyond"), "tokens_within": F.sum(mass).over(every) - F.col("tokens_beyond")})
    return summed.withColumn("truncated_total", F.col("tokens_within") + F.col("n_tokens") * F.col("docs_beyond"))


def at_limits(summed: DataFrame, limits: list[int]) -> DataFrame:
    """The answers at any context limits, also those that no document's length equals."""
    asked = summed.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    totals = summed.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("_tokens"))
    below = summed.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context_limit")).groupBy("context_limit").agg(F.max("docs_within").alias("_in"), F.max("tokens_within").alias("_mass"))
    got = asked.join(below, "context_limit", "left").join(F.broadcast(totals))
    within = F.coalesce("_in", F.lit(0))
    mass = F.coalesce("_mass", F.lit(0))
    return got.select("context_limit", within.alias("docs_within"), (F.col("_docs") - within).alias("docs_beyond"), (mass + F.col("context_limit") * (F.col("_docs") - within)).alias("truncated_total"))


def quantile(summed: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents doesn't exceed; None over no documents."""
    row = summed.where(F.col("docs_within") >= F.lit(float(share)) * (F.col("docs_within") + F.col("docs_beyond"))).agg(F.min("n_tokens")).first()
    return row[0]


def op8_length_histogram(spark, sf_dir: str) -> DataFrame:
    """The histogram of all documents with its suffix sums."""
    return with_suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
