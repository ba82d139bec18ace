"""Pairs of records by the overlap of their token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the tokens of records that have none: two of these are alike, and unlike all others.
_NOTHING = -1


def _hashed(df: DataFrame, tokens: str) -> DataFrame:
    """df with _set: its distinct tokens as 64-bit hashes."""
    hashes = F.array_distinct(F.transform(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: F.xxhash64(t)))
    return df.withColumn("_set", F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.lit(_NOTHING).cast("long"))))


def jaccard_at_least(df: DataFrame, block: list[str], tokens: str, share: float, order: str = "ord") -> DataFrame:
    """id_a, id_b, jaccard of the pairs of a block whose token sets have at least this similarity.

    Tokens of a block are put in one order, the rarest first. Sets of n and m tokens that are alike share one of their first
    n - ceil(share * n) + 1, so only those prefixes are joined; sizes, and the places of the first shared token, leave out
    most of what meets by chance. The rest is compared whole. Blocks that share no rare tokens cost nothing; no pair is lost.
    """
    if not 0 < share <= 1:
        raise ValueError("the similarity must lie in (0, 1]")
    own = _hashed(df.where(F.col(order).isNotNull()).where(_all_there(block)), tokens).select(F.col(order).alias("id"), F.xxhash64(*block).alias("block"), "_set")
    each = own.select("id", "block", F.size("_set").alias("n"), F.explode("_set").alias("token"))
    often = each.groupBy("block", "token").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, ["block", "token"]).groupBy("id", "block", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    take = F.col("n") - F.ceil(F.lit(float(share)) * F.col("n") - F.lit(1e-9)).cast("int") + 1 - alone
    first = shared.withColumns({"alone": alone, "take": take}).where("take > 0").select("id", "block", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("at", "x"))
    first = first.select("id", "block", "n", F.col("x.token").alias("token"), (F.col("alone") + F.col("at")).alias("place"))
    side = lambda s: first.select("block", "token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "place")])
    met = side("a").join(side("b"), ["block", "token"]).where("id_a < id_b")
    sized = met.where((F.col("n_a") >= F.lit(float(share)) * F.col("n_b") - F.lit(1e-9)) & (F.col("n_b") >= F.lit(float(share)) * F.col("n_a") - F.lit(1e-9)))
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = sized.where(F.lit(1 + float(share)) * most >= F.lit(float(share)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)).select("id_a", "id_b").distinct()
    sets = own.select("id", "_set")
    whole = pairs.join(sets.select(F.col("id").alias("id_b"), F.col("_set").alias("_b")), "id_b").join(sets.select(F.col("id").alias("id_a"), F.col("_set").alias("_a")), "id_a")
    both = F.size(F.array_intersect("_a", "_b"))
    return whole.select("id_a", "id_b", (both / (F.size("_a") + F.size("_b") - both)).alias("jaccard")).where(F.col("jaccard") >= F.lit(float(share)) - F.lit(1e-12))


def _all_there(block: list[str]) -> Column:
    out = F.lit(True)
    for c in block:
        out = out & F.col(c).isNotNull()
    return out


def all_jaccards(df: DataFrame, block: list[str], tokens: str, order: str = "ord", side: int = 512) -> DataFrame:
    """id_a, id_b, jaccard of every pair of a block. The result is quadratic in the blocks: where a limit is known,
    jaccard_at_least() never forms most of it.

    Blocks are cut into tiles of some side x side records, and a tile's overlaps are one product of two 0/1 matrices over its
    tokens. A record's set travels once a tile, not once a pair.
    """
    own = _hashed(df.where(F.col(order).isNotNull()).where(_all_there(block)), tokens).select(F.col(order).cast("long").alias("id"), F.xxhash64(*block).alias("block"), "_set")
    tiles = own.groupBy("block").agg(F.ceil(F.count("*") / F.lit(side)).cast("int").alias("tiles"))
    dealt = own.join(tiles, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("id", "_set", "own", "block", low.alias("low"), high.alias("high"))

    def overlaps(table: pa.Table) -> pa.Table:
        ids, bucket = table.column("id").to_numpy(), table.column("own").to_numpy()
        sets = table.column("_set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        _, token = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        of = np.repeat(np.arange(len(ids)), size)
        wide = int(token.max()) + 1
        is_low = bucket == table.column("low")[0].as_py()
        diagonal = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        rows, columns = np.flatnonzero(is_low), np.flatnonzero(is_low if diagonal else ~is_low)
        if not len(rows) or not len(columns):
            return pa.table({"id_a": pa.array([], pa.int64()), "id_b": pa.array([], pa.int64()), "jaccard": pa.array([], pa.float64())})
        both = np.zeros((len(rows), len(columns)), np.float32)
        order = np.argsort(token, kind="stable")
        step = max(1, 40_000_000 // (len(rows) + len(columns)) // 4)
        for f in range(0, wide, step):  # some tokens at a time
            part = order[np.searchsorted(token[order], f) : np.searchsorted(token[order], f + step)]
            m = np.zeros((len(ids), min(step, wide - f)), np.float32)
            m[of[part], token[part] - f] = 1
            both += m[rows] @ m[columns].T
        k = both.astype(np.int64)
        value = k / (size[rows][:, None] + size[columns][None, :] - k)
        a, b = np.broadcast_to(ids[rows][:, None], k.shape), np.broadcast_to(ids[columns][None, :], k.shape)
        keep = a < b if diagonal else np.ones(k.shape, bool)
        return pa.table({"id_a": np.minimum(a, b)[keep], "id_b": np.maximum(a, b)[keep], "jaccard": value[keep]})

    return dealt.groupBy("block", "low", "high").applyInArrow(overlaps, "id_a long, id_b long, jaccard double")
