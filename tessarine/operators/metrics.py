"""Quality of clusters and of pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .score import GRAY, MATCH, classify, logit


def contingency(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """n_ij of predicted cluster i and true cluster j, with the clusters' sizes."""
    cells = df.groupBy(F.col(predicted).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("n"))
    return cells.withColumns({"n_p": F.sum("n").over(Window.partitionBy("p")), "n_t": F.sum("n").over(Window.partitionBy("t"))})


def f1(p, r):
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def bcubed(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """B-cubed precision, recall and F1, from the contingency alone; nothing to score is perfect."""
    n = F.col("n").cast("double")
    one = contingency(df, predicted, truth).agg(F.sum("n").alias("_n"), F.sum(n * n / F.col("n_p")).alias("_p"), F.sum(n * n / F.col("n_t")).alias("_r"))
    share = lambda c: F.coalesce(F.col(c) / F.col("_n"), F.lit(1.0))
    return one.select(share("_p").alias("bcubed_precision"), share("_r").alias("bcubed_recall")).withColumn("bcubed_f1", f1(F.col("bcubed_precision"), F.col("bcubed_recall")))


def bcubed_per_record(df: DataFrame, record: str, predicted: str, truth: str) -> DataFrame:
    """The same, record by record."""
    count = lambda *c: F.count("*").over(Window.partitionBy(*c)).cast("double")
    both = count(predicted, truth)
    return df.select(F.col(record).alias("record_id"), (both / count(predicted)).alias("bcubed_precision"), (both / count(truth)).alias("bcubed_recall"))


def same_ids(predicted: DataFrame, truth: DataFrame, record: str) -> None:
    """Refuses partitions of different record sets, naming some of the records."""
    odd = predicted.select(record).exceptAll(truth.select(record)).union(truth.select(record).exceptAll(predicted.select(record))).orderBy(record).limit(5).collect()
    if odd:
        raise ValueError(f"not in both partitions, or twice in one: {[r[0] for r in odd]}")


def pairwise(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Pairwise precision and recall of clusters, from pair counts of the contingency."""
    cells = contingency(df, predicted, truth)
    two = lambda c: (F.col(c) * (F.col(c) - 1)).cast("double") / F.lit(2.0)
    hits = cells.agg(F.sum(two("n")).alias("_both"))
    by_p = df.groupBy(predicted).agg(F.count("*").alias("n")).agg(F.sum(two("n")).alias("_p"))
    by_t = df.groupBy(truth).agg(F.count("*").alias("n")).agg(F.sum(two("n")).alias("_t"))
    one = hits.crossJoin(by_p).crossJoin(by_t)  # a row each
    share = lambda b: F.when(F.col(b) > 0, F.col("_both") / F.col(b)).otherwise(F.lit(1.0))
    return one.select(share("_p").alias("pair_precision"), share("_t").alias("pair_recall")).withColumn("pair_f1", f1(F.col("pair_precision"), F.col("pair_recall")))


def linkage_rate(df: DataFrame, cluster: str) -> DataFrame:
    """The share of records in clusters of two and more."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg((F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("linkage_rate"), F.sum("n").alias("n_records"))


def _weight(weight: str | None):
    """Pairs may come as patterns, with their number in the column `weight`."""
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def pair_metrics(pairs: DataFrame, same: str = "same", weight: str | None = None) -> DataFrame:
    """Precision, recall and F1 of Match against the labels, alone and with gray pairs decided rightly."""
    w = _weight(weight)
    is_match, truth, gray = F.col("cls") == MATCH, F.col(same), F.col("cls") == GRAY
    count = lambda c: F.sum(c.cast("long") * w).cast("double")
    one = pairs.agg(count(is_match & truth).alias("tp"), count(is_match & ~truth).alias("fp"), count(truth).alias("pos"), count(gray & truth).alias("gray_true"), (count(gray) / F.sum(w)).alias("gray_share"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, pos, more = (F.col(c) for c in ("tp", "fp", "pos", "gray_true"))
    out = one.select(div(tp, tp + fp).alias("precision_alone"), div(tp, pos).alias("recall_alone"), div(tp + more, tp + more + fp).alias("precision_reviewed"), div(tp + more, pos).alias("recall_reviewed"), "gray_share")
    return out.withColumns({"f1_alone": f1(F.col("precision_alone"), F.col("recall_alone")), "f1_reviewed": f1(F.col("precision_reviewed"), F.col("recall_reviewed"))})


def best_threshold(pairs: DataFrame, same: str = "same", digits: int = 9, weight: str | None = None) -> DataFrame:
    """The threshold on the ratio that labels would choose: the best F1 over distinct ratios, ties taken together.

    The running sums go over distinct (rounded) ratios: as many as there are patterns.
    """
    w = _weight(weight)
    by = pairs.groupBy(F.round("llr", digits).alias("threshold")).agg(F.sum(F.col(same).cast("long") * w).alias("_t"), F.sum(w).alias("_n"))
    down = Window.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = by.select("threshold", F.sum("_t").over(down).cast("double").alias("_tp"), F.sum("_n").over(down).cast("double").alias("_k"), F.sum("_t").over(every).cast("double").alias("_pos"))
    scored = run.withColumn("f1", F.when(F.col("_k") + F.col("_pos") > 0, F.lit(2.0) * F.col("_tp") / (F.col("_k") + F.col("_pos"))).otherwise(F.lit(0.0)))
    return scored.orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1).select("threshold", "f1")


def threshold_sensitivity(pairs: DataFrame, same: str = "same", shifts: tuple[float, ...] = (-2.0, -1.0, 0.0, 1.0, 2.0), match: float = 4.0, non_match: float = -4.0, weight: str | None = None) -> DataFrame:
    """Class by label counts with both thresholds moved by each shift."""
    moved = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("shift"), classify(F.col("llr"), match + s, non_match + s).alias("cls")) for s in shifts]))
    return pairs.select(moved.alias("_x"), F.col(same).alias("same"), _weight(weight).alias("_w")).groupBy("_x.shift", "_x.cls", "same").agg(F.sum("_w").alias("n"))


def label_confusion(pairs: DataFrame, same: str = "same", weight: str | None = None) -> DataFrame:
    return pairs.groupBy("cls", F.col(same).alias("same")).agg(F.sum(_weight(weight)).alias("n"))


def scale_comparison(pairs: DataFrame, prior: float, same: str = "same", match: float = 4.0, non_match: float = -4.0, weight: str | None = None) -> DataFrame:
    """Class by label counts with the thresholds on the ratio (scale ratio) and on the posterior's log odds (scale posterior)."""
    on = lambda name, x: F.struct(F.lit(name).alias("scale"), classify(x, match, non_match).alias("cls"))
    both = F.explode(F.array(on("ratio", F.col("llr")), on("posterior", F.col("llr") + F.lit(logit(prior))))).alias("_x")
    return pairs.select(both, F.col(same).alias("same"), _weight(weight).alias("_w")).groupBy("_x.scale", "_x.cls", "same").agg(F.sum("_w").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's correlation with average ranks for ties; null where one side is constant.

    Ranks are worked out over distinct values with counts, so the windows without a partition see no repeated value.
    """

    def ranks(c: str) -> DataFrame:
        by = df.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy(f"_{c}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return by.select(f"_{c}", (before + (F.col("_n") + 1) / F.lit(2.0)).alias(f"_rank_{c}"))

    joined = df.join(ranks(x), F.col(x) == F.col(f"_{x}")).join(ranks(y), F.col(y) == F.col(f"_{y}"))
    a, b = F.col(f"_rank_{x}"), F.col(f"_rank_{y}")
    n = F.count("*")
    cov = F.sum(a * b) - F.sum(a) * F.sum(b) / n
    va, vb = F.sum(a * a) - F.sum(a) * F.sum(a) / n, F.sum(b * b) - F.sum(b) * F.sum(b) / n
    return joined.agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"), n.alias("n"))


def permutation_p(x: list[float], y: list[float], rounds: int = 999, seed: int = 1) -> float:
    """Two-sided permutation p of Spearman's correlation of a small sample; nan if one side is constant."""
    if len(x) != len(y) or len(x) < 3:
        raise ValueError("three pairs at least")

    def ranked(v):
        v = np.asarray(v, float)
        u, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - counts + (counts + 1) / 2)[inverse]

    a, b = ranked(x), ranked(y)
    if a.std() == 0 or b.std() == 0:
        return float("nan")
    rng = np.random.default_rng(seed)
    rho = abs(np.corrcoef(a, b)[0, 1])
    more = sum(abs(np.corrcoef(a, rng.permutation(b))[0, 1]) >= rho - 1e-12 for _ in range(rounds))
    return (more + 1) / (rounds + 1)
