"""The statistics of a stratified review by people."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import dropped, written

CONTESTED, CLEAN, SINGLETON = "Contested", "CleanMerge", "Singleton"
LEAST_SPREAD = math.sqrt(0.05 * 0.95)
Z = 1.96


def stratify(clusters: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """record_id, cluster_id, stratum: in an ambiguous pair (id_a, id_b), else in a cluster of two and more, else alone."""
    return strata_of(clusters, ambiguous.select(F.explode(F.array("id_a", "id_b")).alias("record_id")).distinct())


def strata_of(clusters: DataFrame, contested: DataFrame) -> DataFrame:
    """The same from the records that are in an ambiguous pair, once each."""
    contested = contested.withColumn("_contested", F.lit(True))
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("_size"))
    joined = clusters.join(contested, "record_id", "left").join(sizes, "cluster_id")
    stratum = F.when(F.col("_contested").isNotNull(), CONTESTED).when(F.col("_size") >= 2, CLEAN).otherwise(SINGLETON)
    return joined.select("record_id", "cluster_id", stratum.alias("stratum"))


def check_strata(strata: DataFrame) -> None:
    """Strata must be named and disjoint."""
    if strata.where(F.col("stratum").isNull() | (F.trim("stratum") == "")).limit(1).count():
        raise ValueError("a stratum has no name")
    twice = strata.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("record_id").limit(5).collect()
    if twice:
        raise ValueError(f"in several strata: {[r[0] for r in twice]}")


def draw_order(record: Column, seed: int) -> Column:
    """A reproducible random order: SHA-256 of seed/id."""
    return F.sha2(F.concat(F.lit(f"{seed}/"), record.cast("string")), 256)


def draw_pilot(strata: DataFrame, per_stratum: int, seed: int = 1) -> DataFrame:
    """So many records of each stratum (all if it has fewer), in hash order, with the stratum's population.

    A rank-limited window: Spark keeps the first rows of each stratum map side and never sorts a whole stratum in one task.
    """
    if per_stratum < 1:
        raise ValueError("draw one record at least")
    ranked = strata.withColumn("_rn", F.row_number().over(Window.partitionBy("stratum").orderBy(draw_order(F.col("record_id"), seed), "record_id")))
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("population"))
    return ranked.where(F.col("_rn") <= per_stratum).join(F.broadcast(sizes), "stratum").select("stratum", "record_id", F.col("_rn").cast("int").alias("draw"), "population")  # a row a stratum


def hash_sample(df: DataFrame, record: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in hash order; a sampling operator, so the limit is the feature."""
    return df.orderBy(draw_order(F.col(record), seed), record).limit(n)


def allocate_neyman(strata: list[tuple[int, float]], budget: int, floor: int = 1) -> list[int]:
    """How many of (population, spread) strata to review: by population times spread, none over its population.

    Every stratum gets the floor (itself at most half the budget shared out); shares that pass a bound are fixed and the
    rest divided anew; whole numbers by the largest remainder.
    """
    h = len(strata)
    sizes = [n for n, _ in strata]
    budget = min(budget, sum(sizes))
    if not h or budget <= 0:
        return [0] * h
    least = [min(n, max(1, min(floor, budget // (2 * h)))) for n in sizes]
    if sum(least) > budget:
        raise ValueError("the budget is smaller than the number of strata")
    weight = [n * max(s, LEAST_SPREAD) for n, s in strata]
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(h) if i not in fixed]
        if not free:
            break
        rest, mass = budget - sum(fixed.values()), sum(weight[i] for i in free)
        share = {i: rest * weight[i] / mass for i in free}
        over = [i for i in free if share[i] >= sizes[i]]
        under = [i for i in free if share[i] < least[i]]
        if over:
            fixed |= {i: sizes[i] for i in over}
        elif under:
            fixed |= {i: least[i] for i in under}
        else:
            fixed |= share
    out = [int(math.floor(fixed[i] + 1e-9)) for i in range(h)]
    for i in sorted(range(h), key=lambda i: (-(fixed[i] - out[i]), i)):
        if sum(out) < budget and out[i] < sizes[i]:
            out[i] += 1
    return out


def score_records(verdicts: DataFrame, clusters: DataFrame) -> DataFrame:
    """B-cubed precision and recall of each reviewed record, from verdicts on its candidates.

    verdicts: record_id, candidate_id, outcome (Same, Different, CannotTell), one row a pair. The true cluster is the
    predicted one without the Different and with the Same. Where a reviewer couldn't tell, the record is excluded and only
    bounded: each open candidate is taken both ways.
    """
    of = clusters.select(F.col("record_id").alias("candidate_id"), F.col("cluster_id").alias("_their"))
    own = clusters.select("record_id", F.col("cluster_id").alias("_own"))
    sizes = clusters.groupBy(F.col("cluster_id").alias("_own")).agg(F.count("*").alias("_size"))
    inside = F.col("_own") == F.col("_their")
    said = lambda o, where: F.sum(((F.col("outcome") == o) & where).cast("long")).cast("double")
    joined = verdicts.join(own, "record_id").join(of, "candidate_id").join(sizes, "_own")
    sums = joined.groupBy("record_id", "_size").agg(
        said("Different", inside).alias("_out"), said("Same", ~inside).alias("_in"), said("CannotTell", inside).alias("_open_in"), said("CannotTell", ~inside).alias("_open_out")
    )
    size = F.col("_size").cast("double")

    def pr(out, more):
        both = size - out
        return both / size, both / (both + more)

    p, r = pr(F.col("_out"), F.col("_in"))
    low_p, low_r = pr(F.col("_out") + F.col("_open_in"), F.col("_in") + F.col("_open_out"))[0], (size - F.col("_out") - F.col("_open_in")) / (size - F.col("_out") - F.col("_open_in") + F.col("_in") + F.col("_open_out"))
    open_ = F.col("_open_in") + F.col("_open_out") > 0
    return sums.select("record_id", open_.alias("excluded"), F.when(~open_, p).alias("review_precision"), F.when(~open_, r).alias("review_recall"), low_p.alias("precision_low"), p.alias("precision_high"), low_r.alias("recall_low"), r.alias("recall_high"))


def scored_sample(sample: DataFrame, clusters: DataFrame, verdicts: DataFrame, reviewer: str, candidates: DataFrame) -> DataFrame:
    """stratum, population and the scores of every sampled record, by one reviewer's verdicts.

    sample: stratum, record_id, population (draw_pilot()); candidates: record_id, candidate_id, what the reviewer was shown
    (candidates_of() from pairs, or the caller's own). The reviewer must have verdicts, on shown candidates alone, once each,
    on all of them and on the other members of the record's cluster; a sampled record must be in a cluster. A record with
    nothing to judge scores 1 and 1.
    """
    mine = verdicts.where(F.col("reviewer_id") == reviewer).select("record_id", "candidate_id", "outcome")
    if not mine.take(1):
        raise ValueError(f"reviewer {reviewer} has no verdicts")
    chosen = sample.select("record_id").distinct()
    members = chosen.join(clusters, "record_id").join(clusters.withColumnRenamed("record_id", "candidate_id"), "cluster_id").where("record_id <> candidate_id").select("record_id", "candidate_id")
    shown = candidates.select("record_id", "candidate_id").join(chosen, "record_id", "left_semi").union(members)
    own = mine.join(chosen, "record_id", "left_semi")
    pair = ["record_id", "candidate_id"]
    # what was shown and what was judged meet once, in a table that checks and scores read
    told = own.select(*pair, F.lit(1).alias("_said"), F.lit(0).alias("_shown"), "outcome").unionByName(shown.select(*pair, F.lit(0).alias("_said"), F.lit(1).alias("_shown"), F.lit(None).cast("string").alias("outcome")))
    met = written(told.groupBy(*pair).agg(F.sum("_said").alias("_said"), F.max("_shown").alias("_shown"), F.max("outcome").alias("outcome")), "verdicts")
    for rows, what in (
        (chosen.join(clusters, "record_id", "left_anti").select("record_id", F.lit(None).alias("candidate_id")), "in no cluster"),
        (met.where("_shown = 0").select(*pair), "never shown"),
        (met.where("_said > 1").select(*pair), "judged twice"),
        (met.where("_said = 0").select(*pair), "not judged"),
    ):
        if bad := rows.limit(5).collect():
            dropped(met)
            raise ValueError(f"{what}: {[tuple(r) for r in bad]}")
    scored = score_records(met.select(*pair, "outcome"), clusters)
    one = lambda c: F.coalesce(c, F.when(F.col("excluded").isNull(), F.lit(1.0)))
    names = ("review_precision", "review_recall", "precision_low", "precision_high", "recall_low", "recall_high")
    joined = sample.select("stratum", "record_id", "population").join(scored, "record_id", "left")
    return joined.select("stratum", "population", "record_id", F.coalesce("excluded", F.lit(False)).alias("excluded"), *[one(c).alias(c) for c in names])


def candidates_of(pairs: DataFrame) -> DataFrame:
    """record_id, candidate_id: both ways of the pairs (id_a, id_b)."""
    one, two = pairs.select(F.col("id_a").alias("record_id"), F.col("id_b").alias("candidate_id")), pairs.select(F.col("id_b").alias("record_id"), F.col("id_a").alias("candidate_id"))
    return one.union(two).distinct()


def scores_by_stratum(scored: DataFrame) -> DataFrame:
    """stratum, population, n_sampled, n_excluded, means of precision and recall of what isn't excluded, and of the bounds of
    all; the scores themselves stay rows of scored_sample()."""
    mean = lambda c: F.avg(c).alias(c)
    return scored.groupBy("stratum", "population").agg(F.count("*").alias("n_sampled"), F.sum(F.col("excluded").cast("long")).alias("n_excluded"), *[mean(c) for c in ("review_precision", "review_recall", "precision_low", "precision_high", "recall_low", "recall_high")])


def missing_verdicts(sample: DataFrame, clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs of a sampled record and a member of its cluster that nobody judged."""
    own = sample.select("record_id").join(clusters, "record_id")
    shown = own.join(clusters.withColumnRenamed("record_id", "candidate_id"), "cluster_id").where("record_id <> candidate_id")
    return shown.select("record_id", "candidate_id").join(verdicts, ["record_id", "candidate_id"], "left_anti")


def unobserved_bound(n: Column) -> Column:
    """The variance to assume where n scores are all equal: p(1 - p) with p = 1 - 0.025^(1/n)."""
    p = F.lit(1.0) - F.pow(F.lit(0.025), F.lit(1.0) / n)
    return p * (F.lit(1.0) - p)


def stratified_estimate(scores: DataFrame, populations: DataFrame) -> DataFrame:
    """The mean over strata with its standard error and normal interval.

    scores: stratum, score; populations: stratum, population. Variances are corrected for finite populations; a stratum
    that was scored whole adds none, one whose scores are all equal adds the bound.
    """
    per = scores.groupBy("stratum").agg(F.count("*").cast("double").alias("_n"), F.avg("score").alias("_mean"), F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("_var"), (F.max("score") == F.min("score")).alias("_flat"))
    joined = per.join(populations, "stratum").withColumn("_pop", F.col("population").cast("double"))
    census = F.col("_n") >= F.col("_pop")
    var = F.when(census, F.lit(0.0)).when(F.col("_flat"), unobserved_bound(F.col("_n"))).otherwise(F.col("_var"))
    fpc = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_n") / F.col("_pop"))
    sums = joined.agg(
        F.sum("_pop").alias("_all"), F.sum(F.col("_pop") * F.col("_mean")).alias("_m"), F.sum(F.col("_pop") * F.col("_pop") * fpc * var / F.col("_n")).alias("_v"), F.sum("_n").cast("long").alias("n_scored"),
        F.max(F.when(F.col("_n") < 2, 1).otherwise(0)).alias("stratum_too_small"), F.max(F.when(census, 1).otherwise(0)).alias("stratum_is_census"), F.max(F.when(F.col("_flat") & ~census, 1).otherwise(0)).alias("no_variation"),
    )
    mean, se = F.col("_m") / F.col("_all"), F.sqrt(F.col("_v")) / F.col("_all")
    return sums.select(mean.alias("estimate"), se.alias("standard_error"), (mean - F.lit(Z) * se).alias("low"), (mean + F.lit(Z) * se).alias("high"), "n_scored", "stratum_too_small", "stratum_is_census", "no_variation")


def rescaling_bootstrap(strata: list[tuple[int, list[float]]], replicates: int = 2000, seed: int = 1, most: int = 1_000_000) -> tuple[float, float]:
    """The percentile interval of the stratified mean: n - 1 draws a stratum, shrunk by the root of 1 - f.

    Replicates are drawn in slices of about `most` draws; the stream of random numbers, and so the result, doesn't depend on it.
    """
    rng = np.random.default_rng(seed)
    total = sum(n for n, _ in strata)
    out = np.zeros(replicates)
    for n, scores in strata:
        x = np.asarray(scores, float)
        mean, k = x.mean(), len(x)
        if k < 2 or k >= n:
            out += n / total * mean
            continue
        rows = max(1, most // (k - 1))
        draws = np.concatenate([x[rng.integers(0, k, (min(rows, replicates - i), k - 1))].mean(1) for i in range(0, replicates, rows)])
        out += n / total * (mean + math.sqrt(1 - k / n) * (draws - mean))
    return float(np.quantile(out, 0.025)), float(np.quantile(out, 0.975))


OUTCOMES = ("Same", "Different", "CannotTell")


def reviewer_agreement(verdicts: DataFrame) -> DataFrame:
    """Observed agreement, Cohen's kappa, Gwet's AC1 and specific agreement over pairs that two reviewers judged.

    verdicts: record_id, candidate_id, reviewer_id, outcome. The smaller reviewer id is the first rater; pairs with more
    than two reviewers are counted as refused. Null where a coefficient isn't defined.
    """
    pair = verdicts.groupBy("record_id", "candidate_id").agg(F.array_sort(F.collect_list(F.struct("reviewer_id", "outcome"))).alias("_r"))
    two = pair.where(F.size("_r") == 2).select(F.col("_r")[0]["outcome"].alias("x"), F.col("_r")[1]["outcome"].alias("y"))
    refused = pair.agg(F.sum((F.size("_r") > 2).cast("long")).alias("n_refused"))
    count = lambda c: F.sum(c.cast("long")).cast("double")
    sums = two.agg(F.count("*").cast("double").alias("n"), count(F.col("x") == F.col("y")).alias("_agree"), *[count(F.col(s) == o).alias(f"_{s}{i}") for s in "xy" for i, o in enumerate(OUTCOMES)], *[count((F.col("x") == o) & (F.col("y") == o)).alias(f"_b{i}") for i, o in enumerate(OUTCOMES)])
    n = F.col("n")
    observed = F.col("_agree") / n
    by_chance, gwet = F.lit(0.0), F.lit(0.0)
    for i in range(3):
        x, y = F.col(f"_x{i}") / n, F.col(f"_y{i}") / n
        by_chance = by_chance + x * y
        gwet = gwet + (x + y) / F.lit(2.0) * (F.lit(1.0) - (x + y) / F.lit(2.0))
    gwet = gwet / F.lit(2.0)
    safe = lambda a, b: F.when(b > F.lit(1e-12), a / b)
    specific = [safe(F.lit(2.0) * F.col(f"_b{i}"), F.col(f"_x{i}") + F.col(f"_y{i}")).alias(f"specific_{o.lower()}") for i, o in enumerate(OUTCOMES[:2])]
    return sums.crossJoin(refused).where("n > 0").select(F.col("n").cast("long").alias("n_pairs"), observed.alias("observed"), safe(observed - by_chance, F.lit(1.0) - by_chance).alias("kappa"), safe(observed - gwet, F.lit(1.0) - gwet).alias("ac1"), *specific, "n_refused")
