"""What a caller measures around proposals: question reach, declaration ladders, step reports, declarations from triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from .chain import containing


def reach(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """question, n_concepts, n_reached, reached: a concept is reached if a term of the vocabulary contains one of its
    alternatives, a question if all its concepts are.

    questions: question, concept, alternatives array<string>; vocabulary: term. Terms are made distinct first.
    """
    terms = vocabulary.select(F.lower("term").alias("_term")).distinct()
    asked = questions.select("question", "concept", F.explode(F.transform("alternatives", F.lower)).alias("_alt"))
    hits = containing(terms, "_term", asked, "_alt").select("question", "concept").distinct().withColumn("_hit", F.lit(1))
    joined = questions.select("question", "concept").distinct().join(hits, ["question", "concept"], "left")
    out = joined.groupBy("question").agg(F.count("*").alias("n_concepts"), F.count("_hit").alias("n_reached"))
    return out.withColumn("reached", F.col("n_reached") == F.col("n_concepts"))


def inferred_reach(questions: DataFrame, declared: DataFrame, proposed: DataFrame) -> DataFrame:
    """n_unnamed, n_inferred: the questions that declarations alone don't reach, and those of them that proposals do."""
    a = reach(questions, declared).where("NOT reached").select("question")
    b = reach(questions, proposed).where("reached").select("question", F.lit(1).alias("_b"))
    return a.join(b, "question", "left").agg(F.count("*").alias("n_unnamed"), F.count("_b").alias("n_inferred"))


def ladder(items: DataFrame, steps: int) -> DataFrame:
    """step, n_kept and each kept item of a ladder from nothing to everything: the first round(k / steps * n) by ord.

    items: item, ord (from 1, without gaps). round() goes half away from zero. The cross join is with steps + 1 rows.
    """
    if steps < 1:
        raise ValueError("a ladder needs a step")
    n = items.agg(F.count("*").alias("_n"))
    rungs = items.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    kept = rungs.crossJoin(F.broadcast(n)).select("step", F.round(F.col("step") * F.col("_n") / F.lit(float(steps))).cast("long").alias("n_kept"))
    return kept.join(items, F.col("ord") <= F.col("n_kept"), "left").select("step", "n_kept", "item")


def declarations(triples: DataFrame, is_a: str = "is-a", instance_of: str = "instance-of", folded: bool = True) -> DataFrame:
    """subject, relation, target: triples (subject, predicate, object, ord) as declarations, the first spelling of each
    subject and of each target; is-a rows are super types, instance-of rows and reflexive ones are left out."""
    t = triples.select(F.trim("subject").alias("s"), "predicate", F.trim("object").alias("o"), "ord").where(F.col("predicate") != instance_of)
    keyed = t.withColumns({"ks": name_key(F.col("s"), folded), "ko": name_key(F.col("o"), folded)}).where("ks <> '' AND ko <> '' AND ks <> ko")
    names = keyed.groupBy("ks").agg(F.min_by("s", "ord").alias("subject"))
    links = keyed.groupBy("ks", "predicate", "ko").agg(F.min_by("o", "ord").alias("target"))
    return links.join(names, "ks").select("subject", F.when(F.col("predicate") == is_a, "super type").otherwise(F.col("predicate")).alias("relation"), "target")


def undeclared_types(types: DataFrame, declared: DataFrame, folded: bool = True) -> DataFrame:
    """name: the first spelling of each type (name, ord) that no declaration (subject) has."""
    first = types.withColumn("_k", name_key(F.col("name"), folded)).where("_k <> ''").groupBy("_k").agg(F.min_by("name", "ord").alias("name"))
    return first.join(declared.select(name_key(F.col("subject"), folded).alias("_k")).distinct(), "_k", "left_anti").select("name")


def step_report(entities: DataFrame, known_before: DataFrame) -> DataFrame:
    """Per call (batch): n_entities, n_matched (a known key that was known before), n_made_known (denoted, not known
    before), n_mentioned (neither). entities: batch, key, known_key, denoted; known_before: batch, key."""
    before = known_before.select("batch", F.col("key").alias("_key")).distinct()
    joined = entities.join(before, (entities["batch"] == before["batch"]) & (entities["known_key"] == before["_key"]), "left").select(entities["batch"], "denoted", F.col("_key").isNotNull().alias("_matched"))
    count = lambda c: F.sum(c.cast("long"))
    return joined.groupBy("batch").agg(F.count("*").alias("n_entities"), count(F.col("_matched")).alias("n_matched"), count(~F.col("_matched") & F.col("denoted")).alias("n_made_known"), count(~F.col("_matched") & ~F.col("denoted")).alias("n_mentioned"))


def rejection_ends(rejections: DataFrame, entities: DataFrame) -> DataFrame:
    """element_id, from_name, to_name of relation rejections whose detail ends in (a -> b): the ends by name, if proposed."""
    ends = rejections.select("element_id", F.regexp_extract("detail", r"\((.+?) -> (.+?)\)", 1).alias("_a"), F.regexp_extract("detail", r"\((.+?) -> (.+?)\)", 2).alias("_b"))
    for end, name in (("_a", "from_name"), ("_b", "to_name")):
        ends = ends.join(entities.select(F.col("entity_id").alias(end), F.col("name").alias(name)), end, "left")
    return ends.select("element_id", "from_name", "to_name")


def word_set(c: Column) -> Column:
    """The distinct lower-case words of letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[\\p{L}\\p{Nd}]+"), F.lit(0)), lambda w: F.lower(w)))


def grounded_respellings(answers: DataFrame, vocabulary: DataFrame, least: int = 6, most_edits: int = 2, folded: bool = True) -> DataFrame:
    """answer_id, name, respelled: a type name that nobody uses gets the one name in use within two edits, if the cited
    records hold every word that it gains and none that it loses.

    answers: answer_id, name, cited array<string> (texts); vocabulary: name. The join is by key length, not on all pairs.
    """
    words = F.array_distinct(F.flatten(F.transform("cited", word_set)))
    asked = answers.select("answer_id", F.col("name").alias("_name"), name_key(F.col("name"), folded).alias("_k"), words.alias("_cited"))
    used = vocabulary.select(F.col("name").alias("_use"), name_key(F.col("name"), folded).alias("_u")).distinct()
    fresh = asked.where(F.length("_k") >= least).join(used.select(F.col("_u").alias("_k")).distinct(), "_k", "left_anti")
    near = fresh.withColumn("_len", F.explode(F.sequence(F.length("_k") - most_edits, F.length("_k") + most_edits))).join(used.withColumn("_len", F.length("_u")), "_len").where(F.levenshtein("_k", "_u", most_edits) >= 0)
    one = near.groupBy("answer_id").agg(F.count("*").alias("_n"), F.first(F.struct("_name", "_use", "_cited")).alias("_f")).where("_n = 1").select("answer_id", "_f.*")
    had, has = word_set(F.col("_name")), word_set(F.col("_use"))
    gained, lost = F.array_except(has, had), F.array_except(had, has)
    good = (F.size(gained) > 0) & (F.size(F.array_except(gained, "_cited")) == 0) & (F.size(F.array_intersect(lost, "_cited")) == 0)
    return one.where(good).select("answer_id", F.col("_name").alias("name"), F.col("_use").alias("respelled"))
