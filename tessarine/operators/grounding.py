"""Whether a claim's words occur in the records that it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_tokens

LEAST = 0.3


def overlap(claim: Column, source: Column, folded: bool = True) -> Column:
    """The share of the claim's words (repeats counted) found in the source; null if the claim has none."""
    words, have = overlap_tokens(claim, folded), F.array_distinct(overlap_tokens(source, folded))
    return token_overlap(words, have)


def token_overlap(words: Column, have: Column) -> Column:
    """The same of token arrays; have is a set."""
    # array_except and array_contains would each scan `have` per word; a lookup table per row is one pass
    found = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
    return F.when(F.size(words) > 0, found.cast("double") / F.size(words))


def supported(share: Column, least: float = LEAST) -> Column:
    return F.coalesce(share >= F.lit(float(least)), F.lit(False))


def check_claims(claims: DataFrame, sources: DataFrame, least: float = LEAST) -> DataFrame:
    """claim_id, overlap, is_supported. claims: claim_id, claim; sources: claim_id, text, a row a cited field or record."""
    cited = sources.groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list(overlap_tokens(F.col("text"))))).alias("_have"))
    joined = claims.join(cited, "claim_id", "left")
    share = token_overlap(overlap_tokens(F.col("claim")), F.coalesce("_have", F.array().cast("array<string>")))
    return joined.select("claim_id", share.alias("overlap"), supported(share, least).alias("is_supported"))
