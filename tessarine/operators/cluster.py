"""Connected components over DataFrames, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component: for every node of links (a, b), the smallest node that it reaches.

    Alternates large stars (every larger neighbour is tied to the smallest neighbour) and small stars (every smaller
    neighbour likewise) until nothing moves; that takes a number of rounds in the order of the logarithm of the nodes. Nodes
    are long or string; loops and repeated links are harmless. A hot node's links are aggregated map side, and the joins back
    are left to skew handling. Nothing but two numbers a round comes to the driver.
    """
    pairs = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        after = written(moved, "links")
        dropped(pairs, large)
        pairs = after
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("the components didn't settle")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def split_clusters(clusters: DataFrame, denoted: DataFrame) -> DataFrame:
    """cluster_id, n_entities of clusters of two records and more whose records denote several entities.

    clusters: record_id, cluster_id; denoted: entity_id, record_id.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("_n")).where("_n > 1").select("cluster_id")
    met = denoted.select("entity_id", "record_id").distinct().join(clusters, "record_id").groupBy("cluster_id").agg(F.count_distinct("entity_id").alias("n_entities"))
    return met.where("n_entities > 1").join(sizes, "cluster_id", "left_semi")


def confirmed_identity(confirmed: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """key, identity: the smallest key of all that confirmed merges (a, b) join, for every key of them; with keys (key), for
    those, each alone that no merge names."""
    found = components(confirmed.select("a", "b")).select(F.col("node").alias("key"), F.col("component").alias("identity"))
    if keys is None:
        return found
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("identity", "key").alias("identity"))
