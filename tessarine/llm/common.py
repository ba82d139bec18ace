"""Shared pieces: tables in the shared folder, total orders and running positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.storage import dropped, scratch, shared_folder, written

__all__ = ["BLANKS", "BLANK_RUN", "dropped", "in_global_order", "scratch", "shared_folder", "span_hashes", "unused", "whole_text", "words", "written"]

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def whole_text(name: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores after it until none of the columns has it (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The runs of characters other than BLANKS, as an array; empty for a blank text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def in_global_order(df: DataFrame, keys: list[str], amount: str | None = None, name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with the running sum of amount (of 1 if None) before each row, in the total order of keys.

    The rows are range-partitioned and sorted by keys, so a hot key prefix spreads over ranges as long as the later keys
    differ; each range keeps its own running sum and a table of one total per range gives the ranges' starts. Rows equal in
    all keys get any order among themselves. The result is written to the shared folder, as the ranges must not be drawn anew.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.lit(1).cast("long") if amount is None else F.col(amount).cast("long")
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # monotonically_increasing_id is the partition in the upper bits and the row in it in the lower 33
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), f"ordered-{name}")
    if amount is None:
        placed = placed.withColumn("_own", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    else:
        run = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_own", F.coalesce(F.sum(step).over(run), F.lit(0).cast("long")))
    totals = placed.groupBy("_range").agg(F.sum(step).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select(F.col("_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_range")  # at most n rows
    return joined.withColumn(name, F.col("_start") + F.col("_own")).drop("_at", "_range", "_own", "_start")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, base: int, step: int = 1_000_000) -> np.ndarray:
    """The sum of values[byte] * base**place over the bytes of each span, modulo 2**64; spans ascend and don't overlap.

    The bytes are read step by step, so that a long text needs no number of 8 bytes for each of its own.
    """
    out, size = np.zeros(len(starts), np.uint64), min(step, len(data))
    power, inverse = _powers(base, size), _powers(pow(base, -1, 2**64), size + 1)
    with np.errstate(over="ignore"):
        for c0 in range(0, len(data), step):
            c1 = min(c0 + step, len(data))
            i, j = int(np.searchsorted(ends, c0, side="right")), int(np.searchsorted(starts, c1, side="left"))
            if i >= j:
                continue
            s, e = np.clip(starts[i:j], c0, c1) - c0, np.clip(ends[i:j], c0, c1) - c0
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data[c0:c1]] * power[: c1 - c0], dtype=np.uint64)])
            h = (run[e] - run[s]) * inverse[s]
            if starts[i] < c0:  # only the first span may have begun before
                h[0] *= np.uint64(pow(base, c0 - int(starts[i]), 2**64))
            out[i:j] += h
    return out
