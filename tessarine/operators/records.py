"""Records: bags of text fields to wide columns, identity views, scopes and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compare_key, joined_key, name_key, trimmed


def field_names(bags: DataFrame, fields: str = "fields") -> list[str]:
    """All field names that occur, sorted: a schema, so it fits the driver."""
    return [r[0] for r in bags.select(F.explode(F.map_keys(fields)).alias("k")).distinct().orderBy("k").collect()]


def to_wide(bags: DataFrame, names: list[str] | None = None, fields: str = "fields") -> tuple[DataFrame, dict[str, str]]:
    """One column f<i> a field, blank as null, and the table of names: a field's name may hold any characters."""
    names = field_names(bags, fields) if names is None else names
    safe = {f"f{i}": n for i, n in enumerate(names)}
    value = lambda n: F.element_at(F.col(fields), F.lit(n))
    return bags.withColumns({c: F.when(trimmed(value(n)) != "", value(n)) for c, n in safe.items()}).drop(fields), safe


def prepared(df: DataFrame, fields: list[str], folded: bool = True) -> DataFrame:
    """df with the fields as comparison keys (folded, trimmed, upper case; blank is null)."""
    return df.withColumns({f: compare_key(F.col(f).cast("string"), folded) for f in fields})


def duplicate_ids(df: DataFrame, record: str = "record_id") -> DataFrame:
    """record_id and n of the ids that occur more than once."""
    return df.groupBy(F.col(record).alias("record_id")).agg(F.count("*").alias("n")).where("n > 1")


def refuse_duplicates(df: DataFrame, record: str = "record_id") -> None:
    twice = duplicate_ids(df, record).orderBy("record_id").limit(20).collect()
    if twice:
        raise ValueError(f"duplicate record ids: {', '.join(str(r[0]) for r in twice)}")


def check_prior(known: DataFrame, mentioned: DataFrame | None = None, records: DataFrame | None = None) -> None:
    """Keys must be named, unique, and known or mentioned but not both; a record is in the call or known before.

    known and mentioned: key, record_id, a row a record.
    """
    if known.where(F.col("key").isNull() | (F.trim("key") == "")).limit(1).count():
        raise ValueError("a known entity has no key")
    if mentioned is not None and (both := known.select("key").distinct().join(mentioned.select("key").distinct(), "key").limit(5).collect()):
        raise ValueError(f"known and mentioned: {[r[0] for r in both]}")
    if records is not None and (both := records.select("record_id").join(known.select("record_id"), "record_id", "left_semi").limit(5).collect()):
        raise ValueError(f"records of this call are known already: {[r[0] for r in both]}")


def prior_defects(known: DataFrame, mentioned: DataFrame, types: DataFrame, seen: DataFrame, records: DataFrame, folded: bool = True) -> DataFrame:
    """defect, item of prior knowledge that can't stand.

    known, mentioned: key, name, type, a row an entity; types: name; seen: record_id, a row a record that denotes, mentions or
    is a specimen; records: record_id of this call. Defects: BlankKnown and BlankMentioned (key, name or type), RepeatedKey,
    KnownAndMentioned, BlankType, RepeatedType (the same letters and digits), RecordSeenBefore.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = blank("key") | blank("name") | blank("type")
    row = lambda df, name, item: df.select(F.lit(name).alias("defect"), item.alias("item"))
    key = F.coalesce("key", F.lit(""))
    parts = [row(known.where(some), "BlankKnown", key), row(mentioned.where(some), "BlankMentioned", key)]
    for df in (known, mentioned):
        parts.append(row(df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "RepeatedKey", key))
    parts.append(row(known.select("key").distinct().join(mentioned.select("key").distinct(), "key"), "KnownAndMentioned", key))
    keyed = types.withColumn("_key", F.coalesce(name_key(F.col("name"), folded), F.lit("")))
    parts.append(row(keyed.where("_key = ''"), "BlankType", F.coalesce("name", F.lit(""))))
    parts.append(row(keyed.where("_key <> ''").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1"), "RepeatedType", F.col("_key")))
    parts.append(row(records.select("record_id").distinct().join(seen.select("record_id").distinct(), "record_id"), "RecordSeenBefore", F.col("record_id").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_fields(relations: DataFrame, structures: DataFrame) -> DataFrame:
    """subject, ref_fields: the fields that hold references to other subjects.

    relations: subject, target, via_field, kind. Reference and Parent point out of the subject's own field, Child out of the
    target's; relations without a kind or a field say nothing. structures: subject, the declared ones.
    """
    own = relations.where(F.col("kind").isin("Reference", "Parent")).select("subject", "via_field")
    theirs = relations.where(F.col("kind") == "Child").select(F.col("target").alias("subject"), "via_field")
    every = own.union(theirs).where(F.col("via_field").isNotNull()).distinct().join(structures.select("subject").distinct(), "subject", "left_semi")
    return every.groupBy("subject").agg(F.array_sort(F.collect_set("via_field")).alias("ref_fields"))


def identity_view(bags: DataFrame, refs: DataFrame, fields: str = "fields", subject: str = "subject") -> DataFrame:
    """bags without the fields that their subject declares as references; rows without a subject keep all."""
    joined = bags.join(refs.select(F.col("subject").alias("_s"), F.col("ref_fields").alias("_refs")), F.col(subject) == F.col("_s"), "left")
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(F.coalesce("_refs", F.array().cast("array<string>")), k))
    return joined.withColumn(fields, kept).drop("_s", "_refs")


def ownership_scope(subject: Column, owners: dict[str, Column], folded: bool = True) -> Column:
    """The scope that a record belongs to: its subject and its owner fields, sorted by name; null if one is blank."""
    keys = [(n, compare_key(c.cast("string"), folded)) for n, c in sorted(owners.items())]
    return joined_key(subject, *[F.concat(F.lit(f"{n}="), k) for n, k in keys])


def latest_versions(df: DataFrame, key: list[str], version: list[str], retired: str | None = None) -> DataFrame:
    """The latest version of each key, retired keys dropped.

    max_by is aggregated map side, so a key with very many versions doesn't meet in one sorted task.
    """
    last = df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*version)).alias("_last")).select("_last.*")
    return last if retired is None else last.where(~F.coalesce(F.col(retired), F.lit(False)))


def sections(df: DataFrame, record: str, rows: str, parent: str = "parent_id") -> DataFrame:
    """One record an item of an array column: id parent/position (from 0), the parent's id beside it."""
    out = df.select(F.col(record).alias(parent), F.posexplode(rows).alias("position", "item"))
    return out.withColumn("record_id", F.concat_ws("/", F.col(parent).cast("string"), F.col("position").cast("string")))


def flattened_json(df: DataFrame, body: str) -> DataFrame:
    """A JSON object's top level as a map of texts: strings as they are, null as null, the rest as raw JSON; else empty."""
    parsed = F.from_json(F.col(body), "map<string,string>")
    return df.withColumn("fields", F.coalesce(parsed, F.create_map().cast("map<string,string>")))


def first_of_subject(df: DataFrame, subject: str, n: int, order: str = "ord") -> DataFrame:
    """The first n records of a subject; the limit is the operator's."""
    return df.where(F.col("subject") == subject).orderBy(order).limit(n)


def numbered(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """A dense number in the order given. One task sorts all rows: for small declaration tables only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


KINDS = {"Text": "Text", "Integer": "WholeNumber", "Decimal": "FractionalNumber", "Boolean": "Boolean", "DateTime": "Timestamp", "Guid": "Identifier", "Json": "Structured", "Date": "Date"}


def declared_kind(column_type: Column) -> Column:
    """Column types of a form store as declared kinds; an unknown one is an error."""
    out = None
    for a, b in KINDS.items():
        out = F.when(column_type == a, b) if out is None else out.when(column_type == a, b)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown column type "), column_type)).cast("string"))
