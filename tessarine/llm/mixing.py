"""Mixing sources to target weights, with DataFrame operations alone.

Sizes are summed per source; sources in code point order (null last) take the weights in turn; the total to take is shared
by weight, no source above cap times its own size, the excess reshared by weight until none is above. A source's rate is
its target over its size. Each document is taken floor(rate) times, and once more if a uniform number made of the seed and
its id falls under the rate's fraction, so the expected words of every source are its target and reruns agree.

The targets have a closed form. Sorted by cap * size / weight, the sources at their cap are a prefix: with the level
L_i = (total - caps before i) / (weights from i on), source i is at its cap exactly while weight * L_i >= its cap.

Nulls: a null source is a source, a null text has size 0, a row without an id draws by its text. Rows with equal ids get
equal draws, as do rows without one that have equal texts. Sources without words have target 0 and are not taken. An empty table gives no rows. Extra columns are kept
by mix(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, whole_text, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, size) summed to one row per source: source, source_size, target.

    The windows without a partition run over one row per source, never over documents.
    """
    if cap < share:
        raise ValueError("the sources can't hold share times their size under this cap")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    per = per.withColumn("_full", F.col("_weight") * F.col("_level") >= F.col("_cap"))
    level = F.min(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return per.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * level).alias("target"))


def draw_key(id_col: Column, text_col: Column) -> Column:
    """What a row draws by: its id, or its text if it has none."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(text_col, F.lit("")))))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) made of 52 bits of md5(seed/key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def word_count(text_col: str = "text") -> Column:
    return F.size(words(whole_text(text_col))).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    # texts are hashed for rows without an id only
    by_text = F.when(F.col("doc_id").isNull(), draw_key(F.col("doc_id"), F.col("text")))
    light = written(docs.select("doc_id", "source", word_count().alias("size"), by_text.alias("_by_text")), "mix-sizes")
    targets = source_targets(light, weights, share, cap).withColumnRenamed("source", "_source")
    # a plain join: Spark broadcasts the targets while they are under its own size limit, and else splits skewed ranges
    joined = light.join(targets, light["source"].eqNullSafe(targets["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), "_by_text")
    return joined.withColumn("copies", copies(rate, uniform(key, seed))).withColumn("taken", F.col("copies") * F.col("size")).drop("_by_text")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of docs."""
    sizes = written(docs.select("source", word_count().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    targets = source_targets(sizes, weights, share, cap)
    source, rate, copy = (unused(c, docs.columns) for c in ("_mix_source", "_mix_rate", "_mix_copy"))
    rates = targets.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    joined = docs.join(rates, docs["source"].eqNullSafe(rates[source]))
    taken = F.explode(F.array_repeat(F.lit(0), copies(F.col(rate), uniform(draw_key(docs["doc_id"], docs["text"]), seed)).cast("int"))).alias(copy)
    return joined.select(*[docs[c] for c in docs.columns], taken).drop(copy)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of all words."""
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null/' || md5(coalesce(text, ''))) AS draw_key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight
  FROM sized GROUP BY source
), levelled AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0.0::DOUBLE)) / sum(weight) OVER onward AS level
  FROM per
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), target AS (
  SELECT source, source_size, CASE WHEN weight * level >= most THEN most ELSE weight * min(CASE WHEN weight * level < most THEN level END) OVER () END AS target
  FROM levelled
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('{SEED}/' || s.draw_key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
