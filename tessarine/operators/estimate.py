"""Fellegi-Sunter parameters: expectation maximisation over patterns, and closed forms from a population."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocking, compare

LOW, HIGH = 0.01, 0.99
CONVERGED, NOT_CONVERGED, HEURISTIC, SUPPLIED = "Converged", "NotConverged", "HeuristicDefault", "Supplied"


@dataclass(frozen=True)
class Parameters:
    """m and u per level of every field, the share of matching pairs, and how they came about."""

    m: dict[str, list[float]]
    u: dict[str, list[float]]
    prior: float = 0.5
    status: str = SUPPLIED
    swapped: bool = False
    frequencies: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 < self.prior < 1:
            raise ValueError("the prior must lie in (0, 1)")
        for f in self.m:
            if f not in self.u or len(self.m[f]) != len(self.u[f]):
                raise ValueError(f"m and u of {f} don't have the same levels")

    def weight(self, f: str, k: int) -> float:
        return math.log(self.m[f][k] / self.u[f][k])

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(s: str) -> Parameters:
        return Parameters(**json.loads(s))


def defaults(levels: dict[str, int], fixed_u: dict[str, list[float]] | None = None) -> tuple[dict, dict]:
    """m: 0.9 at the top, the rest even; u: 0.1 over the agreeing levels, the rest at level 0."""
    m = {f: [0.1 / (k - 1)] * (k - 1) + [0.9] for f, k in levels.items()}
    u = {f: list((fixed_u or {}).get(f) or [0.9] + [0.1 / (k - 1)] * (k - 1)) for f, k in levels.items()}
    return m, u


def bounded(shares: np.ndarray) -> np.ndarray:
    """Agreeing shares clamped to [0.01, 0.99]; level 0 takes the rest, and if that is out of bounds all are scaled."""
    out = np.clip(np.asarray(shares, float), LOW, HIGH)
    out[0] = 1 - out[1:].sum()
    if not LOW <= out[0] <= HIGH:
        out[0] = min(max(out[0], LOW), HIGH)
        out /= out.sum()
    return out


def estimate(rows: list[tuple[tuple, int]], levels: dict[str, int], fixed_u: dict[str, list[float]] | None = None, most_rounds: int = 100, tolerance: float = 1e-4) -> Parameters:
    """EM from (pattern, count) rows; a pattern has a level or None per field, in the order of levels."""
    names = [f for j, f in enumerate(levels) if any(p[j] is not None for p, _ in rows)]
    keep = [list(levels).index(f) for f in names]
    own = {f: levels[f] for f in names}
    merged: dict[tuple, int] = {}
    for p, n in rows:
        q = tuple(p[j] for j in keep)
        merged[q] = merged.get(q, 0) + n
    total = sum(merged.values())
    m, u = defaults(own, fixed_u)
    if total < 5 or not names or len(merged) == 1:
        return Parameters(m, u, 0.5, HEURISTIC)
    grid = np.array([[-1 if x is None else x for x in p] for p in merged])
    count = np.array(list(merged.values()), float)
    prior, status = 0.5, NOT_CONVERGED
    m, u = ({f: np.array(x) for f, x in d.items()} for d in (m, u))
    for _ in range(most_rounds):
        x = np.full(len(grid), math.log(prior) - math.log(1 - prior))
        for j, f in enumerate(names):
            here = grid[:, j] >= 0
            x[here] += np.log(m[f][grid[here, j]]) - np.log(u[f][grid[here, j]])
        r = 1 / (1 + np.exp(-x))
        moved = 0.0
        for j, f in enumerate(names):
            here = grid[:, j] >= 0
            for side, w in ((m, count * r), (u, count * (1 - r))):
                if side is u and fixed_u and f in fixed_u:
                    continue
                mass = w[here].sum()
                if mass > 0:
                    new = bounded(np.bincount(grid[here, j], w[here], own[f]) / mass)
                    moved = max(moved, np.abs(new - side[f]).max())
                    side[f] = new
        prior = float(((count * r).sum() + 0.5) / (total + 1))
        if moved < tolerance:
            status = CONVERGED
            break
    m, u = ({f: x.tolist() for f, x in d.items()} for d in (m, u))
    found = Parameters(m, u, prior, status)
    if not fixed_u and sum(found.weight(f, own[f] - 1) for f in names) < 0:
        found = Parameters(u, m, 1 - prior, status, True)
    return found


def fit(patterns: DataFrame, levels: dict[str, int], **options) -> Parameters:
    """estimate() from a pattern table: as many rows as there are patterns come to the driver, never pairs."""
    rows = patterns.select(*[f"g_{f}" for f in levels], "n").collect()
    return estimate([(tuple(r)[:-1], r["n"]) for r in rows], levels, **options)


def non_match_agreement(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, u: the share of all pairs with both values that agree exactly, within [0.01, 0.99]; no pair is formed."""
    out = None
    for f in fields:
        by = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("c"))
        one = by.agg(F.sum(F.col("c") * (F.col("c") - 1)).cast("double").alias("agree"), F.sum("c").cast("double").alias("n"))
        u = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), F.col("agree") / (F.col("n") * (F.col("n") - F.lit(1.0)))))
        part = one.select(F.lit(f).alias("field"), u.alias("u"))
        out = part if out is None else out.unionByName(part)
    return out


def level_agreement(df: DataFrame, comparisons: dict[str, compare.Comparison], most_pairs: int = 100_000, seed: int = 0, order: str = "ord") -> dict[str, list[float]]:
    """u per level of every field: the shares of the levels among pairs of the population with both values, bounded.

    Exact fields have a closed form. Other fields compare distinct values, each pair of them weighing as many pairs of records
    as there are; where these exceed most_pairs, records are dealt by hash into groups that give about most_pairs pairs in
    all, and pairs within groups stand for the rest (a sample is the operator's way beyond its budget). Fields that no pair
    holds are left out.
    """
    exact = [f for f, c in comparisons.items() if c.method == "exact"]
    out = {}
    for r in non_match_agreement(df, exact).where("u IS NOT NULL").collect() if exact else []:
        out[r["field"]] = [1 - r["u"], r["u"]]
    for f, how in comparisons.items():
        if f in exact:
            continue
        held = df.where(F.col(f).isNotNull()).select(F.col(order), F.col(f).alias("v"))
        n, values = held.agg(F.count("*"), F.count_distinct("v")).first()
        if n < 2:
            continue
        if values * (values - 1) // 2 <= most_pairs:
            counted = held.groupBy("v").agg(F.count("*").alias("c")).withColumn("ord", F.col("v"))
            pairs = blocking.all_pairs(counted).withColumn("_w", F.col("a_c") * F.col("b_c"))
            own = counted.withColumns({"a_v": F.col("v"), "b_v": F.col("v"), "_w": F.expr("c * (c - 1) div 2")})
            pairs = pairs.select("a_v", "b_v", "_w").unionByName(own.select("a_v", "b_v", "_w"))
        else:
            groups = max(1, round(n * (n - 1) / 2 / most_pairs))
            dealt = held.withColumnRenamed(order, "ord").withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "ord"), F.lit(groups)))
            pairs = blocking.blocked_pairs(dealt, [["g"]]).select("a_v", "b_v", F.lit(1).cast("long").alias("_w"))
        levels = pairs.withColumn("_level", compare.level_of("v", how)).groupBy("_level").agg(F.sum("_w").alias("n")).collect()
        counts = np.zeros(how.levels)
        for r in levels:
            counts[r["_level"]] += r["n"]
        if counts.sum():
            out[f] = bounded(counts / counts.sum()).tolist()
    return {f: out[f] for f in comparisons if f in out}


def from_non_match_agreement(u: dict[str, float | list[float]], m: float = 0.92, prior: float = 0.5) -> Parameters:
    """Supplied parameters: u as measured (a number for exact fields, or one a level), and one m for the top level of all."""
    levels = {f: [1 - x, x] if isinstance(x, float) else list(x) for f, x in u.items()}
    return Parameters({f: [(1 - m) / (len(x) - 1)] * (len(x) - 1) + [m] for f, x in levels.items()}, levels, prior)


def value_frequencies(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, share among the records that have the field."""
    out = None
    for f in fields:
        by = df.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("value")).agg(F.count("*").alias("_n"))
        total = by.agg(F.sum("_n").alias("_all"))
        part = by.crossJoin(F.broadcast(total)).select(F.lit(f).alias("field"), "value", (F.col("_n") / F.col("_all")).alias("share"))  # one row on the right
        out = part if out is None else out.unionByName(part)
    return out


def with_frequencies(p: Parameters, shares: dict[str, dict[str, float]]) -> Parameters:
    return replace(p, frequencies=shares)
