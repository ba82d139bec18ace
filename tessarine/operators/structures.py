"""Declared structures: from a form store's tables to one row a subject, looked up by subject, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, trimmed
from .records import declared_kind

RELATION_KINDS = ("Reference", "Child", "Parent")


def with_parents(relations: DataFrame, sections: DataFrame) -> DataFrame:
    """relations (subject, name, target, via_field, kind) and, for every section (subject, parent, relation, key_field), one
    of kind Parent to the form that holds it, by the same name and key."""
    up = sections.select("subject", F.col("relation").alias("name"), F.col("parent").alias("target"), F.col("key_field").alias("via_field"), F.lit("Parent").alias("kind"))
    return relations.select("subject", "name", "target", "via_field", "kind").unionByName(up)


def bound_fields(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """The relations that bound fields add. fields: subject, name, bound_to, via_field; relations as above.

    A bound field, and the field that carries its value if that's another, refers to the form it is bound to, unless a
    relation to that form over the same field is declared already.
    """
    carriers = F.explode(F.array_distinct(F.array_compact(F.array("name", "via_field"))))
    own = fields.where(F.col("bound_to").isNotNull()).select("subject", carriers.alias("name"), F.col("bound_to").alias("target")).distinct()
    own = own.select("subject", "name", "target", F.col("name").alias("via_field"), F.lit("Reference").alias("kind"))
    return own.join(relations.select("subject", "target", "via_field"), ["subject", "target", "via_field"], "left_anti").select("subject", "name", "target", "via_field", "kind")


def structures(fields: DataFrame, relations: DataFrame, sections: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """One row a declared subject: fields and relations as sorted arrays of structs, and version and business_name from forms.

    fields: subject, name, column_type, nullable, business_name, bound_to, via_field; relations: subject, name, target,
    via_field, kind (Reference or Child); sections: subject, parent, relation, key_field; forms: subject, version,
    business_name. A column type or relation kind that isn't known is an error.
    """
    kind = F.when(F.col("kind").isin("Reference", "Child"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown relation kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    declared = with_parents(relations.withColumn("kind", kind), sections)
    every = declared.unionByName(bound_fields(fields, declared))
    of_fields = fields.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("name", declared_kind(F.col("column_type")).alias("kind"), (~F.coalesce("nullable", F.lit(False))).alias("required"), "business_name"))).alias("fields"))
    of_relations = every.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("name", "target", "via_field", "kind"))).alias("relations"))
    out = of_fields.join(of_relations, "subject", "full_outer")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    out = out.select("subject", *[empty(F.col(c), out.schema[c].dataType).alias(c) for c in ("fields", "relations")])
    return out if forms is None else out.join(forms.select("subject", F.col("version").cast("string").alias("version"), "business_name"), "subject", "left")


def structure_of(declared: DataFrame, subjects: DataFrame) -> DataFrame:
    """The structure of every subject asked for; nulls where it isn't declared."""
    return subjects.select("subject").distinct().join(declared, "subject", "left")


def declaration_defects(declared: DataFrame, folded: bool = True) -> DataFrame:
    """subject, defect, detail of declarations (subject, key_field, super_types) that can't stand: RepeatedSubject (the same
    letters and digits), BlankKeyField, SuperTypeWithoutName, SuperTypeIsItself."""
    keyed = declared.withColumn("_key", name_key(F.col("subject"), folded))
    twice = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    repeated = keyed.join(twice, "_key", "left_semi").select("subject", F.lit("RepeatedSubject").alias("defect"), F.col("_key").alias("detail"))
    blank = keyed.where(F.col("key_field").isNotNull() & (trimmed(F.col("key_field")) == "")).select("subject", F.lit("BlankKeyField").alias("defect"), F.col("key_field").alias("detail"))
    above = keyed.select("subject", "_key", F.explode("super_types").alias("_super")).withColumn("_super_key", F.coalesce(name_key(F.col("_super"), folded), F.lit("")))
    defect = F.when(F.col("_super_key") == "", "SuperTypeWithoutName").when(F.col("_super_key") == F.col("_key"), "SuperTypeIsItself")
    wrong = above.withColumn("defect", defect).where("defect IS NOT NULL").select("subject", "defect", F.coalesce("_super", F.lit("")).alias("detail"))
    return repeated.unionByName(blank).unionByName(wrong)


def check_declarations(declared: DataFrame, folded: bool = True) -> None:
    """Raises on the first of declaration_defects()."""
    found = declaration_defects(declared, folded).orderBy("defect", "subject", "detail").limit(20).collect()
    if found:
        raise ValueError("declarations can't stand: " + "; ".join(f"{r.subject}: {r.defect} {r.detail!r}" for r in found))
