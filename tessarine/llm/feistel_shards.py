"""Sharding by a Feistel permutation of global row numbers.

Row numbers follow (id, text_crc32, size); a Feistel network over two modular halves with cycle walking permutes
0..N-1; place p goes to shard p mod S and slot p div S. So shard sizes differ by one row at most, slots have no gaps, and
anyone who knows N and the seed can compute a row's shard and slot, and the row at a place.

Nulls: a null id sorts first, a null text is empty. Equal rows are interchangeable: together they hold the same places on
every run. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_global_order, whole_text, written

ROUNDS = 8


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """splitmix64 of x under key."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(key & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return [int(_mixed(np.array([seed + 0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)], dtype=np.uint64), 0)[0]) for k in range(ROUNDS)]


def _halves(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of the row numbers under the permutation of 0..n-1 that seed draws."""
    a, b = (np.uint64(x) for x in _halves(n))
    keys = _round_keys(seed)
    out = rows.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # cycle walking: the network permutes 0..a*b-1; places past n walk on until they fall inside
        x = out[todo]
        left, right = x // b, x % b
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + _mixed(left, key) % b) % b
            else:
                left = (left + _mixed(right, key) % a) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers at the places: the inverse of permute()."""
    a, b = (np.uint64(x) for x in _halves(n))
    keys = _round_keys(seed)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x // b, x % b
        for k, key in reversed(list(enumerate(keys))):
            if k % 2:
                right = (right + (b - _mixed(left, key) % b)) % b
            else:
                left = (left + (a - _mixed(right, key) % a)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, size, text_crc32, global row_number, place, shard and slot."""
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = whole_text(text_col).cast("binary")
    light = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "shard-rows")
    n = light.count()
    numbered = in_global_order(light, ["doc_id", "text_crc32", "size"])
    dropped(light)  # its rows were written anew, in order

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")})


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """The law `rows` over all of documents: 24 shards whose counts differ by one at most."""
    placed = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
