"""New records as a stream, scored against a known population that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import blocking, compare, score
from ..operators.estimate import Parameters


def scored_stream(stream: DataFrame, known: DataFrame, rules: list[list[str]], comparisons: dict[str, compare.Comparison], p: Parameters) -> DataFrame:
    """a_*, b_*, llr, cls of every pair of a streamed and a known record that a rule brings together. No state is kept: each
    micro-batch is joined with the static side."""
    pairs = compare.with_levels(blocking.blocked_cross(stream, known, rules), comparisons)
    scored = pairs.withColumn("llr", score.llr(p))
    return scored.withColumn("cls", score.classify(scored["llr"]))


def upsert_candidates(path: str, record: str, key: str):
    """A foreachBatch function that writes each batch's best candidates per record and key under its own epoch: a batch that
    is run again overwrites itself, so the sink is idempotent."""

    def write(df: DataFrame, epoch: int) -> None:
        score.known_candidates(df, record, key).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
