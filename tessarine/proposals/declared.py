"""Declared structure against proposals: closure of kinds, and relations that contradict a declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators.storage import dropped, written


def super_types(declared: DataFrame, most_rounds: int = 50) -> DataFrame:
    """sub, super: every super type that a subject reaches over declared ones (sub, super); cycles end by themselves.

    Each round joins the last round's new pairs with all pairs known so far, which doubles the length of the paths, so rounds
    follow the logarithm of the longest one. The tables of all rounds but the result's are deleted.
    """
    known = written(declared.select("sub", "super").where("sub <> super").distinct(), "kinds")
    new = known
    for _ in range(most_rounds):
        step = new.withColumnRenamed("super", "_mid").join(known.withColumnRenamed("sub", "_mid"), "_mid").select("sub", "super").where("sub <> super").distinct()
        more = written(step.join(known, ["sub", "super"], "left_anti"), "kinds")
        if not more.take(1):
            dropped(more, *([new] if new is not known else []))
            return known
        both = written(known.union(more), "kinds")
        dropped(known, *([new] if new is not known else []))
        known, new = both, more
    raise RuntimeError("the declared kinds didn't settle")


def merged_relations(relations: DataFrame, declared: DataFrame, folded: bool = True) -> DataFrame:
    """relations (name, from_type, to_type, ...) with basis: Declared, Proposed, or ContradictsDeclaration where the name is
    declared but none of its declarations has these ends. declared: name, subject, target. Types count with their kinds if
    both sides were expanded by super_types()."""
    keys = declared.select(name_key(F.col("name"), folded).alias("_n"), name_key(F.col("subject"), folded).alias("_s"), name_key(F.col("target"), folded).alias("_t")).distinct()
    named = keys.select("_n", F.lit(True).alias("_named")).distinct()
    exact = keys.withColumn("_exact", F.lit(True))
    keyed = relations.withColumns({"_n": name_key(F.col("name"), folded), "_s": name_key(F.col("from_type"), folded), "_t": name_key(F.col("to_type"), folded)})
    joined = keyed.join(named, "_n", "left").join(exact, ["_n", "_s", "_t"], "left")
    basis = F.when(F.col("_exact"), "Declared").when(F.col("_named"), "ContradictsDeclaration").otherwise("Proposed")
    return joined.withColumn("basis", basis).drop("_n", "_s", "_t", "_named", "_exact")


def bound_references(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that bound fields imply and nobody declared. fields: subject, name, bound_to, via_field (may be null);
    relations: subject, via_field, and target if a relation over the same field to another subject shall not count. Both the
    field and its via field refer to the bound subject."""
    own = fields.where("bound_to IS NOT NULL").select("subject", F.col("bound_to").alias("target"), F.explode(F.array_distinct(F.array_compact(F.array("name", "via_field")))).alias("via_field"))
    keys = ["subject", "via_field", *(["target"] if "target" in relations.columns else [])]
    return own.join(relations.select(*keys), keys, "left_anti").withColumn("kind", F.lit("Reference"))


def recovered_labels(relations: DataFrame, rendered: DataFrame) -> DataFrame:
    """relations whose name is a copied line of the rendered declarations (line, name) get the declared name back."""
    lookup = rendered.select(F.trim("line").alias("_line"), F.col("name").alias("_declared"))
    joined = relations.join(lookup, F.trim("name") == F.col("_line"), "left")
    return joined.withColumn("name", F.coalesce("_declared", "name")).drop("_line", "_declared")
