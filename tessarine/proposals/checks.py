"""What a model proposed, checked element by element; nothing is dropped without a row that says why.

entities: entity_id, name, type, claim, confidence, sources array<string>, denoted_by array<string>, known_key, ord.
relations: name, from_id, to_id, claim, confidence, sources, ord. Rejections: kind, element_id, reason, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import denotation_text, name_key

REJECTION = ("kind", "element_id", "reason", "detail")


def parse(answers: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, rejections) of model answers (batch_id, body): an answer that isn't a JSON object with
    entities is refused whole, an element of the wrong shape alone."""
    parsed = answers.withColumn("_v", F.try_parse_json(body)).withColumn("_e", F.expr("try_variant_get(_v, '$.entities', 'array<variant>')"))
    bad = parsed.where("_e IS NULL").select("batch_id", F.lit("Answer").alias("kind"), F.lit(None).cast("string").alias("element_id"), F.lit("MalformedAnswer").alias("reason"), F.lit("not a proposal").alias("detail"))
    good = parsed.where("_e IS NOT NULL")
    get = lambda path, kind: F.expr(f"try_variant_get(_x, '$.{path}', '{kind}')")
    # a member of another type reads as null, like a missing one; the two are told apart by asking for it as a variant
    shape = lambda path, kind: F.expr(f"try_variant_get(_x, '$.{path}', 'variant')").isNotNull() & get(path, kind).isNull()
    elements = good.select("batch_id", F.posexplode("_e").alias("ord", "_x"))
    entity = elements.select("batch_id", "ord", get("id", "string").alias("entity_id"), get("name", "string").alias("name"), get("type", "string").alias("type"), get("claim", "string").alias("claim"), get("confidence", "double").alias("confidence"), get("sources", "array<string>").alias("sources"), get("denotedBy", "array<string>").alias("denoted_by"), get("knownEntityKey", "string").alias("known_key"), (shape("confidence", "double") | shape("sources", "array<string>") | (F.expr("schema_of_variant(_x)") == "VOID")).alias("_odd"))
    links = good.select("batch_id", F.posexplode(F.expr("coalesce(try_variant_get(_v, '$.relations', 'array<variant>'), array())")).alias("ord", "_x"))
    relation = links.select("batch_id", "ord", get("name", "string").alias("name"), get("from", "string").alias("from_id"), get("to", "string").alias("to_id"), get("claim", "string").alias("claim"), get("confidence", "double").alias("confidence"), get("sources", "array<string>").alias("sources"), (shape("confidence", "double") | shape("sources", "array<string>")).alias("_odd"))
    odd = lambda df, kind, at: df.where("_odd").select("batch_id", F.lit(kind).alias("kind"), F.col(at).alias("element_id"), F.lit("MalformedElement").alias("reason"), F.lit("wrong shape").alias("detail"))
    return entity.where("NOT coalesce(_odd, false)").drop("_odd"), relation.where("NOT coalesce(_odd, false)").drop("_odd"), bad.unionByName(odd(entity, "Entity", "entity_id")).unionByName(odd(relation, "Relation", "name"))


def unknown_sources(elements: DataFrame, records: DataFrame, element: str) -> DataFrame:
    """Cited ids that no record of the call has: they refuse the whole answer."""
    cited = elements.select(element, F.explode("sources").alias("record_id"))
    return cited.join(records.select("record_id"), "record_id", "left_anti")


def entity_defect(known_keys: Column | None = None) -> Column:
    """The first defect of an entity, or null."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return (
        F.when(blank("entity_id") | blank("name") | blank("type") | blank("claim"), "MissingField")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "ConfidenceOutOfRange")
        .when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "NoSource")
    )


def checked_entities(entities: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities that stand, rejections): defects first, then ids that occur twice, then keys that nobody supplied."""
    marked = entities.withColumn("_reason", entity_defect())
    times = F.count("*").over(Window.partitionBy("entity_id"))
    marked = marked.withColumn("_reason", F.coalesce("_reason", F.when(times > 1, "DuplicateEntityId")))
    if known is not None:
        keys = known.select(F.col("key").alias("_key")).distinct()
        marked = marked.join(keys, F.col("known_key") == F.col("_key"), "left")
        marked = marked.withColumn("_reason", F.coalesce("_reason", F.when(F.col("known_key").isNotNull() & F.col("_key").isNull(), "UnknownKnownEntity"))).drop("_key")
    rejected = marked.where("_reason IS NOT NULL").select(F.lit("Entity").alias("kind"), F.col("entity_id").alias("element_id"), F.col("_reason").alias("reason"), F.coalesce("name", F.lit("")).alias("detail"))
    return marked.where("_reason IS NULL").drop("_reason"), rejected


def endpoint_rejections(relations: DataFrame, proposed: DataFrame, accepted: DataFrame) -> DataFrame:
    """name, from_id, to_id, reason: an end that was never proposed dangles; one that was proposed and rejected says so."""
    ends = relations
    for end in ("from", "to"):
        p = proposed.select(F.col("entity_id").alias(f"_p_{end}")).distinct()
        a = accepted.select(F.col("entity_id").alias(f"_a_{end}")).distinct()
        ends = ends.join(p, F.col(f"{end}_id") == F.col(f"_p_{end}"), "left").join(a, F.col(f"{end}_id") == F.col(f"_a_{end}"), "left")
    dangling = F.col("_p_from").isNull() | F.col("_p_to").isNull()
    lost = F.col("_a_from").isNull() | F.col("_a_to").isNull()
    return ends.select("name", "from_id", "to_id", F.when(dangling, "DanglingEndpoint").when(lost, "EndpointRejected").alias("reason"))


def relation_defect() -> Column:
    """The first defect of a relation on its own, or null."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return (
        F.when(blank("name") | blank("from_id") | blank("to_id") | blank("claim"), "MissingField")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "ConfidenceOutOfRange")
        .when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "NoSource")
    )


def checked_relations(relations: DataFrame, proposed: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations that stand, rejections): their own defects first, then those of their ends."""
    marked = relations.withColumn("_own", relation_defect())
    for end in ("from", "to"):
        p = proposed.select(F.col("entity_id").alias(f"_p_{end}")).distinct()
        a = accepted.select(F.col("entity_id").alias(f"_a_{end}")).distinct()
        marked = marked.join(p, F.col(f"{end}_id") == F.col(f"_p_{end}"), "left").join(a, F.col(f"{end}_id") == F.col(f"_a_{end}"), "left")
    dangling = F.col("_p_from").isNull() | F.col("_p_to").isNull()
    lost = F.col("_a_from").isNull() | F.col("_a_to").isNull()
    marked = marked.withColumn("_reason", F.coalesce("_own", F.when(dangling, "DanglingEndpoint").when(lost, "EndpointRejected")))
    detail = F.concat(F.coalesce("from_id", F.lit("")), F.lit(" -> "), F.coalesce("to_id", F.lit("")))
    rejected = marked.where("_reason IS NOT NULL").select(F.lit("Relation").alias("kind"), F.coalesce("name", F.lit("")).alias("element_id"), F.col("_reason").alias("reason"), detail.alias("detail"))
    return marked.where("_reason IS NULL").select(*relations.columns), rejected


def demotions(denotes: DataFrame, references: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """entity_id, record_id of denotations that fall: in a declared reference field the record holds the entity's name or, with
    keys, the key of another record that denotes the entity too; unless the record would then denote nothing.

    denotes: entity_id, name, record_id; references: record_id, value (of each declared reference field); keys: record_id, key.
    """
    held = references.select("record_id", denotation_text(F.col("value")).alias("_text")).where("_text <> ''").distinct()
    named = denotes.withColumn("_text", denotation_text(F.col("name")))
    hit = named.join(held.withColumn("_hit", F.lit(True)), ["record_id", "_text"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    if keys is not None:
        others = keys.select(F.col("record_id").alias("_other"), denotation_text(F.col("key")).alias("_text")).where("_text <> ''").distinct()
        also = denotes.select("entity_id", F.col("record_id").alias("_other"))
        by_key = held.join(others, "_text").where("record_id <> _other").join(also, "_other").select("entity_id", "record_id").distinct().withColumn("_key_hit", F.lit(True))
        hit = hit.join(by_key, ["entity_id", "record_id"], "left").withColumn("_hit", F.col("_hit") | F.coalesce("_key_hit", F.lit(False))).drop("_key_hit")
    over = Window.partitionBy("record_id")
    left = F.sum((~F.col("_hit")).cast("int")).over(over)
    return hit.withColumn("_left", left).where("_hit AND _left > 0").select("entity_id", "record_id")


def settled_types(entities: DataFrame, in_use: DataFrame, folded: bool = True) -> DataFrame:
    """entities with the spelling of their type that is in use: the first of equal keys by priority, then order.

    in_use: name, priority, ord. min_by takes the first, without a sort.
    """
    first = in_use.select(name_key(F.col("name"), folded).alias("_key"), "name", "priority", "ord").where("_key <> ''").groupBy("_key").agg(F.min_by("name", F.struct("priority", "ord")).alias("_spelling"))
    joined = entities.withColumn("_key", name_key(F.col("type"), folded)).join(first, "_key", "left")
    settled = F.coalesce("_spelling", "type")
    return joined.withColumn("respelled", settled != F.col("type")).withColumn("type", settled).drop("_key", "_spelling")


def respellings(words: DataFrame, vocabulary: DataFrame, least: int = 6, most_edits: int = 2) -> DataFrame:
    """word, name: words of `least` letters and more that are within `most_edits` of exactly one name, not equal to it.

    Lengths differ by at most most_edits, so the join is an equi-join on a length band, not on all pairs.
    """
    bands = vocabulary.select("name", F.length("name").alias("_len")).where(F.col("_len") >= least)
    near = words.where(F.length("word") >= least).distinct().withColumn("_len", F.explode(F.sequence(F.length("word") - most_edits, F.length("word") + most_edits)))
    hits = near.join(bands, "_len").where((F.levenshtein("word", "name", most_edits) >= 0)).groupBy("word").agg(F.count("*").alias("_n"), F.min("name").alias("name"))
    return hits.where((F.col("_n") == 1) & (F.col("word") != F.col("name"))).select("word", "name")


def type_relation_checks(pairs: DataFrame, declared: DataFrame, folded: bool = True) -> DataFrame:
    """sub, super, verdict of proposed is-a pairs (sub, super, ord): Reflexive, Duplicate, Inverted (the declared pair turned
    round), Declared or Proposed. declared: sub, super."""
    keyed = pairs.withColumns({"_a": name_key(F.col("sub"), folded), "_b": name_key(F.col("super"), folded)})
    keyed = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("ord")))
    known = declared.select(name_key(F.col("sub"), folded).alias("_x"), name_key(F.col("super"), folded).alias("_y")).distinct()
    same = known.select(F.col("_x").alias("_a"), F.col("_y").alias("_b"), F.lit(True).alias("_same"))
    turned = known.select(F.col("_y").alias("_a"), F.col("_x").alias("_b"), F.lit(True).alias("_turned"))
    joined = keyed.join(same, ["_a", "_b"], "left").join(turned, ["_a", "_b"], "left")
    verdict = F.when(F.col("_a") == F.col("_b"), "Reflexive").when(F.col("_rn") > 1, "Duplicate").when(F.col("_same"), "Declared").when(F.col("_turned"), "Inverted").otherwise("Proposed")
    return joined.select("sub", "super", "ord", verdict.alias("verdict"))


def merge_candidate_checks(candidates: DataFrame, entities: DataFrame, mentioned: DataFrame) -> DataFrame:
    """entity_id, key, verdict of (entity_id, key, confidence, ord): the first defect, Duplicate, or Accepted.

    entities: entity_id, denotes (whether a record denotes it); mentioned: key.
    """
    joined = candidates.join(entities.select("entity_id", "denotes"), "entity_id", "left").join(mentioned.select("key", F.lit(True).alias("_m")), "key", "left")
    first = F.row_number().over(Window.partitionBy("entity_id", "key").orderBy("ord"))
    defect = F.when(F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "ConfidenceOutOfRange").when(F.col("denotes").isNull(), "DanglingEndpoint").when(F.col("_m").isNull(), "UnknownMentionedEntity").when(~F.col("denotes"), "NotDenoted")
    return joined.withColumn("_rn", first).select("entity_id", "key", "ord", F.coalesce(defect, F.when(F.col("_rn") > 1, "Duplicate"), F.lit("Accepted")).alias("verdict"))


def completed_sources(entities: DataFrame) -> DataFrame:
    """Denoting records that an entity doesn't cite are appended to its sources; mentioned_in are the rest of them."""
    whole = F.concat("sources", F.array_except("denoted_by", "sources"))
    return entities.withColumn("sources", whole).withColumn("mentioned_in", F.array_except("sources", "denoted_by"))
