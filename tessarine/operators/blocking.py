"""Candidate pairs: blocked, all, and against a known population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_key


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns])


def may_be_same(scope: str | None = None, subject: str | None = None, key: str | None = None) -> Column:
    """The pair predicate: owners' scopes don't differ, and records of one subject don't have different keys."""
    ok = F.lit(True)
    if scope:
        a, b = F.col(f"a_{scope}"), F.col(f"b_{scope}")
        ok = ok & (a.isNull() | b.isNull() | (a == b))
    if key:
        differ = F.col(f"a_{key}") != F.col(f"b_{key}")
        if subject:
            differ = differ & (F.col(f"a_{subject}") == F.col(f"b_{subject}"))
        ok = ok & ~F.coalesce(differ, F.lit(False))
    return ok


def block_sizes(df: DataFrame, rule: list[str]) -> DataFrame:
    """Per block of a rule: its records and the pairs it would give; look at this before joining."""
    key = joined_key(*[F.col(c) for c in rule])
    return df.select(key.alias("block")).where("block IS NOT NULL").groupBy("block").agg(F.count("*").alias("n_records")).withColumn("n_pairs", F.expr("n_records * (n_records - 1) div 2"))


def _with_rules(df: DataFrame, rules: list[list[str]]) -> DataFrame:
    return df.withColumns({f"_rule{i}": joined_key(*[F.col(c) for c in r]) for i, r in enumerate(rules)})


def _earlier(i: int) -> Column:
    met = F.lit(False)
    for j in range(i):
        met = met | F.coalesce(F.col(f"a__rule{j}") == F.col(f"b__rule{j}"), F.lit(False))
    return met


def _tiled(df: DataFrame, rule: str, order: str, most: int | None) -> DataFrame:
    """df with _own and _other: blocks of more than `most` records fall into tiles of some `most` each, others are one tile.

    A record goes to all tiles of its block that hold its own bucket, so a hot block's pairs spread over many tasks.
    """
    one = F.lit(0)
    if most is None:
        return df.withColumns({"_own": one, "_other": one, "_tile": one})
    hot = df.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("_block")).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_tiles")).where("_tiles > 1")
    sized = df.join(hot, F.col(rule) == F.col("_block"), "left").drop("_block").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    sized = sized.withColumn("_own", F.pmod(F.xxhash64(F.col(order)), F.col("_tiles")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return sized.withColumn("_tile", F.least("_own", "_other") * F.col("_tiles") + F.greatest("_own", "_other")).drop("_tiles")


def _once_in_a_tile() -> Column:
    """Pairs of two buckets meet in their one tile; those of one bucket only in its diagonal tile."""
    return (F.col("a__tile") == F.col("b__tile")) & ((F.col("a__own") != F.col("b__own")) | (F.col("a__other") == F.col("a__own")) & (F.col("b__other") == F.col("b__own")))


def blocked_pairs(df: DataFrame, rules: list[list[str]], order: str = "ord", predicate: Column | None = None, most: int | None = None) -> DataFrame:
    """Pairs (a_*, b_*), a before b in order, that any rule brings together.

    One equi-join a rule; a pair is emitted by the first rule that it satisfies, so the union needs no distinct. With `most`,
    blocks of more records than that are joined in tiles (no pair is lost); a smaller block's plan stays the same.
    """
    keyed = _with_rules(df, rules)
    out = None
    for i in range(len(rules)):
        sized = _tiled(keyed, f"_rule{i}", order, most)
        a, b = _side(sized, "a"), _side(sized, "b")
        on = (F.col(f"a__rule{i}") == F.col(f"b__rule{i}")) & (F.col(f"a_{order}") < F.col(f"b_{order}")) & ~_earlier(i)
        if most is not None:
            on = on & _once_in_a_tile()
        part = a.join(b, on if predicate is None else on & predicate)
        out = part if out is None else out.unionByName(part)
    return out.drop(*[f"{s}__{c}" for s in "ab" for c in ("own", "other", "tile", *[f"rule{i}" for i in range(len(rules))])])


def given_pairs(df: DataFrame, pairs: DataFrame, rule: list[str], record: str = "record_id") -> DataFrame:
    """Of the pairs given (id_a, id_b) those (a_*, b_*) that a rule brings together: a lookup of both ends, no block is formed."""
    found = pairs.join(_side(df, "a"), F.col("id_a") == F.col(f"a_{record}")).join(_side(df, "b"), F.col("id_b") == F.col(f"b_{record}"))
    for c in rule:
        found = found.where(F.col(f"a_{c}") == F.col(f"b_{c}"))
    return found.drop("id_a", "id_b")


def blocked_cross(df: DataFrame, known: DataFrame, rules: list[list[str]], predicate: Column | None = None) -> DataFrame:
    """Pairs of a record (a_*) and a known record (b_*) that any rule brings together."""
    a, b = _side(_with_rules(df, rules), "a"), _side(_with_rules(known, rules), "b")
    out = None
    for i in range(len(rules)):
        on = (F.col(f"a__rule{i}") == F.col(f"b__rule{i}")) & ~_earlier(i)
        part = a.join(b, on if predicate is None else on & predicate)
        out = part if out is None else out.unionByName(part)
    return out.drop(*[f"{s}__rule{i}" for s in "ab" for i in range(len(rules))])


def all_pairs(df: DataFrame, order: str = "ord", buckets: int = 8, predicate: Column | None = None) -> DataFrame:
    """Every pair, a before b, by an equi-join of bucket pairs: the triangle in tiles instead of one nested loop.

    Each record goes to the `buckets` tiles that hold its bucket; a pair meets in one tile, or in the diagonal one.
    """
    own = F.pmod(F.xxhash64(F.col(order)), F.lit(buckets)).cast("int")
    tiled = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    tiled = tiled.withColumn("_tile", F.least("_own", "_other") * buckets + F.greatest("_own", "_other"))
    a, b = _side(tiled, "a"), _side(tiled, "b")
    on = (F.col("a__tile") == F.col("b__tile")) & (F.col(f"a_{order}") < F.col(f"b_{order}")) & ((F.col("a__own") != F.col("b__own")) | (F.col("a__other") == F.col("a__own")) & (F.col("b__other") == F.col("b__own")))
    out = a.join(b, on if predicate is None else on & predicate)
    return out.drop(*[f"{s}__{c}" for s in "ab" for c in ("own", "other", "tile")])


def all_cross(df: DataFrame, known: DataFrame, predicate: Column | None = None, buckets: int = 8, order: str = "ord") -> DataFrame:
    """Every record with every known record, by an equi-join of bucket pairs. The result has |df| x |known| rows: prefer rules
    for anything large."""
    bucket = F.pmod(F.xxhash64(F.col(order)), F.lit(buckets)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    a = _side(df.withColumn("_row", bucket).withColumn("_column", every), "a")
    b = _side(known.withColumn("_column", bucket).withColumn("_row", every), "b")
    on = (F.col("a__row") == F.col("b__row")) & (F.col("a__column") == F.col("b__column"))
    out = a.join(b, on if predicate is None else on & predicate)
    return out.drop(*[f"{s}__{c}" for s in "ab" for c in ("row", "column")])
