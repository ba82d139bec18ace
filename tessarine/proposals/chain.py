"""What one call's proposals become for the next: known and mentioned entities, type vocabulary, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_key


def to_known(entities: DataFrame) -> DataFrame:
    """key, name, type, records of entities (key, name, type, denoted_by, ord) that a record denotes; first spelling wins."""
    some = entities.where(F.size("denoted_by") > 0)
    first = some.groupBy("key").agg(F.min_by(F.struct("name", "type"), "ord").alias("_f"))
    records = some.select("key", F.explode("denoted_by").alias("r")).groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("records"))
    return first.join(records, "key").select("key", "_f.name", "_f.type", "records")


def to_mentioned(entities: DataFrame) -> DataFrame:
    """key, name, type, records of entities that no record denotes and no known one matches (known_key is null)."""
    some = entities.where((F.size("denoted_by") == 0) & F.col("known_key").isNull())
    first = some.groupBy("key").agg(F.min_by(F.struct("name", "type"), "ord").alias("_f"))
    records = some.select("key", F.explode("sources").alias("r")).groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("records"))
    return first.join(records, "key").select("key", "_f.name", "_f.type", "records")


def accumulated(before: DataFrame, now: DataFrame, known: DataFrame) -> DataFrame:
    """Mentioned entities so far and new ones (key, name, type, records), merged; keys that became known leave."""
    both = before.select("*", F.lit(0).alias("_t")).unionByName(now.select("*", F.lit(1).alias("_t")))
    merged = both.groupBy("key").agg(F.min_by(F.struct("name", "type"), "_t").alias("_f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("records")))).alias("records"))
    return merged.join(known.select("key"), "key", "left_anti").select("key", "_f.name", "_f.type", "records")


def type_vocabulary(types: DataFrame, specimens: int = 2, folded: bool = True) -> DataFrame:
    """name and up to `specimens` records of each type (name, record_id, ord): the first spelling, the first records."""
    keyed = types.withColumn("_key", name_key(F.col("name"), folded))
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("ord"))).where(F.col("_rn") <= specimens)
    return ranked.groupBy("_key").agg(F.min_by("name", "_rn").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("_rn", "record_id"))), lambda x: x["record_id"]).alias("specimens")).drop("_key")


def type_consistency(a: DataFrame, b: DataFrame, folded: bool = True) -> DataFrame:
    """n_shared, n_alike: names typed in both runs (name, type), and those with the same set of types."""
    sets = lambda df, c: df.groupBy(name_key(F.col("name"), folded).alias("k")).agg(F.array_sort(F.collect_set(name_key(F.col("type"), folded))).alias(c))
    return sets(a, "x").join(sets(b, "y"), "k").agg(F.count("*").alias("n_shared"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("n_alike"))


def candidate_verdicts(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """verdict of (a, b): Correct if both are one thing (id, thing), Wrong if two, Unjudged if either isn't known."""
    x, y = (truth.select(F.col("id").alias(s), F.col("thing").alias(f"_{s}")) for s in "ab")
    joined = candidates.join(x, "a", "left").join(y, "b", "left")
    return joined.select("a", "b", F.when(F.col("_a").isNull() | F.col("_b").isNull(), "Unjudged").when(F.col("_a") == F.col("_b"), "Correct").otherwise("Wrong").alias("verdict"))


def triples(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """source, subject, predicate, object: relations with their ends' names, for each cited record, once."""
    s, o = (entities.select(F.col("entity_id").alias(f"{e}_id"), F.col("name").alias(n)) for e, n in (("from", "subject"), ("to", "object")))
    return relations.join(s, "from_id").join(o, "to_id").select(F.explode("sources").alias("source"), "subject", F.col("name").alias("predicate"), "object").distinct()


def extension(initial: DataFrame, new: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Triples (subject, predicate, object) that the initial set lacks; both ends in the vocabulary (name), if given."""
    more = new.distinct().join(initial, ["subject", "predicate", "object"], "left_anti")
    for end in ("subject", "object") if vocabulary is not None else ():
        more = more.join(vocabulary.select(F.col("name").alias(end)).distinct(), end, "left_semi")
    return more.select("subject", "predicate", "object")


def lenient_join(left: DataFrame, right: DataFrame, folded: bool = True) -> DataFrame:
    """left_id, right_id of names (id, name) that are the same in letters and digits."""
    a = left.select(F.col("id").alias("left_id"), name_key(F.col("name"), folded).alias("k"))
    b = right.select(F.col("id").alias("right_id"), name_key(F.col("name"), folded).alias("k"))
    return a.where("k <> ''").join(b, "k").select("left_id", "right_id")


def grams(c: Column, most: int = 3) -> Column:
    """The distinct substrings of one to `most` characters."""
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, most + 1)]))


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """The rows of texts and parts where the text contains the part, by an equi-join on the part's first three characters."""
    a = texts.withColumn("_gram", F.explode(grams(F.col(text))))
    b = parts.where(F.col(part) != "").withColumn("_gram", F.substring(F.col(part), 1, 3))
    return a.join(b, "_gram").where(F.contains(F.col(text), F.col(part))).drop("_gram")


def over_merged(names: DataFrame, things: DataFrame, folded: bool = True) -> DataFrame:
    """id, n_things of names that contain the names of two things and more."""
    a = names.select("id", name_key(F.col("name"), folded).alias("_n"))
    b = things.select("thing", name_key(F.col("name"), folded).alias("_t"))
    return containing(a, "_n", b, "_t").groupBy("id").agg(F.count_distinct("thing").alias("n_things")).where("n_things >= 2")


def across_parents(denotes: DataFrame, scopes: DataFrame) -> DataFrame:
    """entity_id, n_scopes of entities whose records (entity_id, record_id) lie in two scopes (record_id, scope) and more."""
    return denotes.join(scopes, "record_id").groupBy("entity_id").agg(F.count_distinct("scope").alias("n_scopes")).where("n_scopes >= 2")
