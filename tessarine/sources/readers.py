"""Readers of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trimmed


def csv_records(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """A CSV file with quoted fields, doubled quotes and embedded line ends; all text, trimmed, blank as null."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    clean = df.select([F.when(trimmed(F.col(f"`{c}`")) != "", trimmed(F.col(f"`{c}`"))).alias(c.strip()) for c in df.columns])
    return clean.withColumnRenamed(id_column, "record_id")


def labelled_pairs_id(df: DataFrame, record: str = "record_id") -> DataFrame:
    """The entity number and whether a record is the original, from ids like rec-12-dup-0."""
    return df.withColumns({"entity": F.regexp_extract(record, r"^rec-(\d+)", 1), "is_original": F.col(record).endswith("-org")})


def every_nth_entity(df: DataFrame, n: int, entity: str = "entity") -> DataFrame:
    """The records of the entities whose number n divides: whole entities, so what links stays together."""
    return df.where(F.pmod(F.col(entity).cast("long"), F.lit(n)) == 0)


def xml_individuals(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def table_records(df: DataFrame, prefix: str) -> DataFrame:
    """Every column of every row as text, null as the empty string, with an id by content: a hash of the row, and a number
    among equal rows. Ids don't depend on partitions or the order of rows."""
    text = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    sized = [F.concat(F.length(f"`{c}`").cast("string"), F.lit(":"), F.col(f"`{c}`")) for c in df.columns]
    keyed = text.withColumn("_row", F.substring(F.sha2(F.concat(*sized), 256), 1, 16))
    again = F.row_number().over(Window.partitionBy("_row").orderBy("_row")).cast("string")
    return keyed.withColumn("record_id", F.concat(F.lit(f"{prefix}/"), F.col("_row"), F.lit("/"), again)).drop("_row")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
