"""Confidence from linkage, and where a proposal goes with it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.score import GRAY, MATCH, logit, sigmoid

EDGE = 1e-6


def clamped(c: Column) -> Column:
    return F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), c))


def cited_pairs(entities: DataFrame) -> DataFrame:
    """id_a, id_b: the pairs of records, the smaller first, that some entity cites together; fused() reads no others."""
    cited = F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isNotNull())))
    some = entities.select(cited.alias("_s")).select("_s", F.posexplode("_s").alias("_i", "id_a"))
    return some.select("id_a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("id_b")).distinct()


def fused(entities: DataFrame, pairs: DataFrame, clusters: DataFrame, prior: float) -> DataFrame:
    """entity_id, confidence, fused from the pairs among the records an entity cites.

    entities: entity_id, confidence, sources; pairs: id_a, id_b, llr, cls; clusters: record_id, cluster_id. One source or no
    pair: the model's own. All cited in one cluster with a Match among them, or all their pairs Match: the posterior of the
    smallest ratio. Otherwise that and the model's confidence together.
    """
    cited = entities.select("entity_id", F.explode(F.array_distinct("sources")).alias("record_id"))
    a, b = (cited.select("entity_id", F.col("record_id").alias(f"id_{s}")) for s in "ab")
    among = pairs.join(a, "id_a").join(b, ["entity_id", "id_b"]).groupBy("entity_id").agg(F.min("llr").alias("_least"), F.bool_and(F.col("cls") == MATCH).alias("_all"), F.bool_or(F.col("cls") == MATCH).alias("_any"))
    homes = cited.join(clusters, "record_id", "left").groupBy("entity_id").agg(F.count_distinct(F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("alone "), F.col("record_id").cast("string")))).alias("_homes"), F.count("*").alias("_cited"))
    joined = entities.join(among, "entity_id", "left").join(homes, "entity_id", "left")
    sure = F.coalesce((F.col("_homes") == 1) & F.col("_any"), F.lit(False)) | F.coalesce(F.col("_all"), F.lit(False))
    own = clamped(F.col("confidence"))
    x = F.col("_least") + F.lit(logit(prior))
    both = sigmoid(x + F.ln(own / (F.lit(1.0) - own)))
    value = F.when((F.col("_cited") <= 1) | F.col("_least").isNull(), F.col("confidence")).when(sure, clamped(sigmoid(x))).otherwise(clamped(both))
    return joined.select("entity_id", value.alias("confidence"), (F.col("_least").isNotNull() & (F.col("_cited") > 1)).alias("fused"))


def fused_known(confidence: Column, llr: Column, cls: Column, prior: float) -> Column:
    """A known entity's strongest candidate: a match gives its posterior, a gray one is fused, none changes nothing."""
    own = clamped(confidence)
    x = llr + F.lit(logit(prior))
    return F.when(cls == MATCH, clamped(sigmoid(x))).when(cls == GRAY, clamped(sigmoid(x + F.ln(own / (F.lit(1.0) - own))))).otherwise(confidence)


@dataclass(frozen=True)
class Thresholds:
    auto: float
    review: float

    def __post_init__(self):
        if not (0 <= self.review <= self.auto <= 1) or math.isnan(self.auto) or math.isnan(self.review):
            raise ValueError("0 <= review <= auto <= 1")

    def route(self, confidence: Column) -> Column:
        return F.when(confidence >= F.lit(float(self.auto)), "AutoApply").when(confidence >= F.lit(float(self.review)), "Review").otherwise("DraftOnly")


def routed(df: DataFrame, innate: Thresholds, acquired: Thresholds) -> DataFrame:
    """df (origin, confidence) with its tier and a provenance stamp; there are no default thresholds."""
    tier = F.when(F.col("origin") == "Innate", innate.route(F.col("confidence"))).otherwise(acquired.route(F.col("confidence")))
    out = df.withColumn("tier", tier)
    step = F.when(F.col("tier") == "AutoApply", "Settled").otherwise("Escalated")
    return out.withColumn("path_step", step)


def stamp(tier: Column, rationale: Column, step: Column, sources: Column) -> Column:
    """The annotations of a routed proposal as one struct; the sources as a JSON array."""
    return F.struct(tier.alias("tier"), rationale.alias("rationale"), step.alias("step"), F.to_json(sources).alias("sources"))
