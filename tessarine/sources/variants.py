"""Pure rewrites of a source that must not change what links: for metamorphic tests of a caller's own data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: a rewrite of one text column. None stands for a missing value and stays missing.
VALUES = {
    "as_is": lambda c: c,
    "missing_empty": lambda c: F.coalesce(c, F.lit("")),
    "missing_blank": lambda c: F.coalesce(c, F.lit("   ")),
    "missing_null": lambda c: F.when(F.trim(c) != "", c),
    "missing_tab": lambda c: F.coalesce(c, F.lit("\t")),
    "padded": lambda c: F.concat(F.lit("  "), c, F.lit(" ")),
    "upper": lambda c: F.upper(c),
    "lower": lambda c: F.lower(c),
    "dates_dashed": lambda c: F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    "dates_slashed": lambda c: F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$3/$2/$1"),
    "numbers_as_decimals": lambda c: F.regexp_replace(c, r"^(\d+)$", "$1.0"),
}


def rewritten(df: DataFrame, columns: list[str], variant: str) -> DataFrame:
    """df with the columns rewritten."""
    rule = VALUES[variant]
    return df.withColumns({c: rule(F.col(c)) for c in columns})


def renamed(df: DataFrame, columns: list[str], prefix: str = "src_") -> DataFrame:
    """The columns under other names."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def other_ids(df: DataFrame, record: str = "record_id") -> DataFrame:
    """The records under other ids: a hash of the old ones."""
    return df.withColumn(record, F.sha2(F.col(record).cast("string"), 256))


def prefixed_ids(df: DataFrame, record: str = "record_id", prefix: str = "x-") -> DataFrame:
    return df.withColumn(record, F.concat(F.lit(prefix), F.col(record).cast("string")))


def rewrite(c: Column, variant: str) -> Column:
    return VALUES[variant](c)
