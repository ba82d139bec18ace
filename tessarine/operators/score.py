"""Log-likelihood ratios, classes, posteriors, and what they say about errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .estimate import Parameters

MATCH, GRAY, NON_MATCH = "Match", "GrayZone", "NonMatch"
FLOOR = 0.01


def llr(p: Parameters) -> Column:
    """The sum of the fields' log weights; a field that wasn't compared adds nothing. All literals are doubles."""
    out = F.lit(0.0)
    for f in p.m:
        chosen = None
        for k in range(len(p.m[f])):
            hit = F.col(f"g_{f}") == k
            weight = F.lit(float(p.weight(f, k)))
            chosen = F.when(hit, weight) if chosen is None else chosen.when(hit, weight)
        out = out + F.coalesce(chosen, F.lit(0.0))
    return out


def frequency_adjusted(pairs: DataFrame, p: Parameters, shares: DataFrame, fields: list[str], out: str = "llr") -> DataFrame:
    """Adds to `out`, for fields that agree at the top on a listed value, ln(u_top / max(share, 0.01)).

    shares (field, value, share) is joined by value; Spark broadcasts it while it is small.
    """
    for f in fields:
        own = shares.where(F.col("field") == f).select(F.col("value").alias("_value"), F.col("share").alias("_share"))
        pairs = pairs.join(own, (F.col(f"a_{f}") == F.col("_value")) & (F.col(f"a_{f}") == F.col(f"b_{f}")), "left")
        pairs = pairs.withColumn(out, F.col(out) + frequency_gain(p, f, F.col("_share"))).drop("_value", "_share")
    return pairs


def frequency_gain(p: Parameters, f: str, share: Column) -> Column:
    """What a field's agreement at the top on a value of this share adds; a value without a share adds nothing."""
    top = (F.col(f"g_{f}") == len(p.m[f]) - 1) & (F.col(f"a_{f}") == F.col(f"b_{f}"))
    return F.when(top & share.isNotNull(), F.ln(F.lit(float(p.u[f][-1])) / F.greatest(share, F.lit(FLOOR)))).otherwise(F.lit(0.0))


def with_shares(df: DataFrame, shares: DataFrame, fields: list[str]) -> DataFrame:
    """df with _share_<field>, the share of its own value: pairs that agree on it needn't be joined with the shares."""
    for f in fields:
        df = df.join(shares.where(F.col("field") == f).select(F.col("value").alias(f), F.col("share").alias(f"_share_{f}")), f, "left")
    return df


def classify(x: Column, match: float = 4.0, non_match: float = -4.0) -> Column:
    if non_match >= match:
        raise ValueError("the thresholds must be ordered")
    return F.when(x >= F.lit(float(match)), MATCH).when(x <= F.lit(float(non_match)), NON_MATCH).otherwise(GRAY)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: float) -> float:
    return math.log(p) - math.log(1 - p)


def posterior(x: Column, prior: float) -> Column:
    return sigmoid(x + F.lit(logit(prior)))


def is_ambiguous(x: Column, prior: float) -> Column:
    p = posterior(x, prior)
    return (p > F.lit(0.2)) & (p < F.lit(0.8))


def known_candidates(pairs: DataFrame, record: str, key: str, match: float = 4.0, non_match: float = -4.0) -> DataFrame:
    """The best pair of each record and known key, classified; non-matches left out."""
    best = pairs.groupBy(F.col(record).alias("record_id"), F.col(key).alias("known_key")).agg(F.max("llr").alias("llr"))
    return best.withColumn("cls", classify(F.col("llr"), match, non_match)).where(F.col("cls") != NON_MATCH)


def gray_budget(own: DataFrame, candidates: DataFrame, budget: int = 200) -> DataFrame:
    """The gray entries that fit a budget shared by own pairs and known candidates: the largest ratio first, own first on ties.

    Both have id_a, id_b and llr. The limit is the feature; it is a top-k, not a global sort.
    """
    both = own.select(F.lit(0).alias("kind"), "id_a", "id_b", "llr").unionByName(candidates.select(F.lit(1).alias("kind"), "id_a", "id_b", "llr"))
    return both.orderBy(F.col("llr").desc(), "kind", "id_a", "id_b").limit(budget)


def error_rates(pairs: DataFrame, prior: float, weight: str | None = None) -> DataFrame:
    """Expected matches and non-matches, and the rates of false ones, from posteriors alone.

    pairs has llr and cls, a row a pair; or a row a pattern, with its number of pairs in the column `weight`.
    """
    p = posterior(F.col("llr"), prior)
    is_match, is_non = F.col("cls") == MATCH, F.col("cls") == NON_MATCH
    zero, w = F.lit(0.0), (F.lit(1) if weight is None else F.col(weight)).cast("double")
    add = lambda x: F.sum(x * w)
    sums = pairs.agg(
        F.coalesce(F.sum(w), zero).cast("long").alias("n_pairs"),
        add(p).alias("expected_match"),
        add(F.lit(1.0) - p).alias("expected_non_match"),
        add(F.when(is_match, F.lit(1.0) - p).otherwise(zero)).alias("_false_match"),
        add(F.when(is_non, p).otherwise(zero)).alias("_false_non"),
        (add((F.col("cls") == GRAY).cast("double")) / F.sum(w)).alias("gray_share"),
        (add(is_ambiguous(F.col("llr"), prior).cast("double")) / F.sum(w)).alias("ambiguous_share"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(zero)
    return sums.select("n_pairs", "expected_match", "expected_non_match", rate("_false_match", "expected_non_match").alias("false_match_rate"), rate("_false_non", "expected_match").alias("false_non_match_rate"), "gray_share", "ambiguous_share")


def error_caveats(rates: DataFrame, p: Parameters) -> DataFrame:
    """rates with an array of caveats."""
    flags = [
        (F.col("n_pairs") < 5, "FewPairs"),
        (F.lit(len(p.m) < 3), "FewFields"),
        (F.col("ambiguous_share") >= 0.5, "MostlyAmbiguous"),
        (F.lit(p.status == "HeuristicDefault"), "HeuristicParameters"),
        (F.lit(p.status == "NotConverged"), "NotConverged"),
        (F.lit(p.swapped), "ComponentsSwapped"),
    ]
    return rates.withColumn("caveats", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags])))


def unresolved(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Gray pairs (id_a, id_b) whose ends are in different components; labels: node, component. Others are alone."""
    a, b = (labels.select(F.col("node").alias(f"id_{s}"), F.col("component").alias(f"_c{s}")) for s in "ab")
    gray = pairs.where(F.col("cls") == GRAY).join(a, "id_a", "left").join(b, "id_b", "left")
    return gray.where(F.coalesce("_ca", "id_a") != F.coalesce("_cb", "id_b")).drop("_ca", "_cb")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
