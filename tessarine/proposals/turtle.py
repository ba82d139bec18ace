"""OWL in Turtle: IRIs, escapes and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name, name_key

PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def check_base(iri: str) -> str:
    if not iri.startswith(("http://", "https://", "urn:")) or iri[-1] not in "#/":
        raise ValueError("the base must be absolute and end with # or /")
    return iri


def escaped(c: Column) -> Column:
    """A literal's characters: quotes, backslashes and line ends by name, other controls by number."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for k in (*range(1, 9), 11, 12, *range(14, 32)):
        out = F.replace(out, F.lit(chr(k)), F.lit(f"\\u{k:04X}"))
    return out


def literal(c: Column) -> Column:
    return F.concat(F.lit('"'), escaped(c), F.lit('"'))


def individual_iri(base: str, type_name: Column, name: Column, denoted: Column, known_key: Column) -> Column:
    """A known key that is a safe IRI stands for itself; else a hash of the type, name and sorted records, each with its
    length in front."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    text = F.concat(sized(type_name), sized(name), F.array_join(F.transform(F.array_sort(denoted), sized), ""))
    hashed = F.concat(F.lit(check_base(base)), F.substring(F.sha2(text, 256), 1, 32))
    by_key = F.concat(F.lit(base), F.substring(F.sha2(F.concat(F.lit("key:"), known_key), 256), 1, 32))
    safe = known_key.rlike("^(https?://|urn:)[^\\x00-\\x20<>\"{}|^`\\\\]+$")
    return F.when(safe, known_key).when(known_key.isNotNull(), by_key).otherwise(hashed)


def first_spellings(terms: DataFrame, folded: bool = True) -> DataFrame:
    """term_key, name: the first spelling of every term (name, ord); names without letters stand for themselves."""
    key = name_key(F.col("name"), folded)
    own = F.when(key == "", F.concat(F.lit("\u0001"), F.col("name"))).otherwise(key)
    return terms.withColumn("term_key", own).groupBy("term_key").agg(F.min_by("name", "ord").alias("name"))


def decimal_text(c: Column) -> Column:
    """A confidence as xsd:decimal."""
    return F.format_string("%.6f", c)


def lines(entities: DataFrame, relations: DataFrame, base: str) -> DataFrame:
    """seq, line: header, classes, properties, individuals, relation axioms. entities: iri, name, type, claim, confidence;
    relations: name, from_iri, to_iri. One line a row; sort by (part, line) and write as text."""
    check_base(base)
    iri = lambda c: F.concat(F.lit(f"<{base}"), local_name(c), F.lit(">"))
    spark = entities.sparkSession
    head = spark.createDataFrame([(0, f"@prefix {k}: <{v}> .") for k, v in PREFIXES.items()], "part int, line string")
    classes = first_spellings(entities.select(F.col("type").alias("name"), F.lit(0).alias("ord")).distinct()).select(F.lit(1).alias("part"), F.concat(iri(F.col("name")), F.lit(" a owl:Class ; rdfs:label "), literal(F.col("name")), F.lit(" .")).alias("line"))
    properties = first_spellings(relations.select("name", F.lit(0).alias("ord")).distinct()).select(F.lit(2).alias("part"), F.concat(iri(F.col("name")), F.lit(" a owl:ObjectProperty ; rdfs:label "), literal(F.col("name")), F.lit(" .")).alias("line"))
    things = entities.select(F.lit(3).alias("part"), F.concat(F.lit("<"), F.col("iri"), F.lit("> a "), iri(F.col("type")), F.lit(" ; rdfs:label "), literal(F.col("name")), F.lit(" ; rdfs:comment "), literal(F.col("claim")), F.lit(f" ; <{base}confidence> \""), decimal_text(F.col("confidence")), F.lit('"^^xsd:decimal .')).alias("line"))
    facts = relations.select(F.lit(4).alias("part"), F.concat(F.lit("<"), F.col("from_iri"), F.lit("> "), iri(F.col("name")), F.lit(" <"), F.col("to_iri"), F.lit("> .")).alias("line"))
    return head.union(classes).union(properties).union(things).union(facts)


#: Our own annotations; a document declares them.
VOCABULARY = "urn:tessarine:evidence#"
ANNOTATIONS = ("claim", "cites", "recordId", "fieldName", "denotedBy", "confidence", "basis", "origin")


def provenance(df: DataFrame) -> Column:
    """The annotations that every statement carries, from claim, sources (record_id, field_name), confidence and basis."""
    field = lambda x: F.when(x["field_name"].isNotNull(), F.concat(F.lit(" ; ev:fieldName "), literal(x["field_name"]))).otherwise("")
    cites = F.transform("sources", lambda x: F.concat(F.lit(" ; ev:cites [ ev:recordId "), literal(x["record_id"]), field(x), F.lit(" ]")))
    return F.concat(F.lit(" ; ev:claim "), literal(F.col("claim")), F.array_join(cites, ""), F.lit(' ; ev:confidence "'), decimal_text(F.col("confidence")), F.lit('"^^xsd:decimal ; ev:basis '), literal(F.lower("basis")))


def axiom(source: Column, predicate: Column, target: Column, notes: Column) -> Column:
    """A statement as an annotated axiom."""
    return F.concat(F.lit("[] a owl:Axiom ; owl:annotatedSource "), source, F.lit(" ; owl:annotatedProperty "), predicate, F.lit(" ; owl:annotatedTarget "), target, notes, F.lit(" ."))


def document(entities: DataFrame, relations: DataFrame, type_relations: DataFrame, base: str, innate: DataFrame | None = None, retired: DataFrame | None = None, folded: bool = True) -> DataFrame:
    """part, line of a whole document: prefixes, annotation properties, classes, properties, retired terms, individuals,
    relations and type relations, each with its provenance.

    entities: iri, name, type, denoted_by, and what provenance() reads; relations: name, from_iri, to_iri, likewise;
    type_relations: sub, super, likewise. A term's first spelling names it; innate (name) lists the terms of origin innate.
    retired: term_key, iri of an earlier document's terms, see retired_bridge().
    """
    check_base(base)
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    term = lambda c: F.concat(F.lit(f"<{base}"), local_name(c), F.lit(">"))
    spark = entities.sparkSession
    key = lambda c: F.when(name_key(c, folded) == "", F.concat(F.lit("\u0001"), c)).otherwise(name_key(c, folded))
    known = (innate if innate is not None else spark.createDataFrame([], "name string")).select(name_key(F.col("name"), folded).alias("term_key")).distinct().withColumn("_innate", F.lit(True))
    spelt = lambda names: first_spellings(names, folded).join(known, "term_key", "left").select("term_key", "name", term(F.col("name")).alias("term"), F.when(F.col("_innate"), "innate").otherwise("acquired").alias("origin"))
    ends = [entities.select(F.col("type").alias("name"), F.lit(0).alias("ord")), *[type_relations.select(F.col(c).alias("name"), F.lit(1).alias("ord")) for c in ("sub", "super")]]
    classes = spelt(ends[0].union(ends[1]).union(ends[2]).groupBy("name").agg(F.min("ord").alias("_o")).select("name", F.struct("_o", "name").alias("ord")))
    properties = spelt(relations.select("name").distinct().select("name", F.col("name").alias("ord")))
    declared = lambda df, part, kind: df.select(F.lit(part).alias("part"), F.concat("term", F.lit(f" a owl:{kind} ; rdfs:label "), literal(F.col("name")), F.lit(" ; ev:origin "), literal(F.col("origin")), F.lit(" .")).alias("line"))
    of = lambda df, name, as_, terms: df.withColumn("term_key", key(F.col(name))).join(terms.select("term_key", F.col("term").alias(as_)), "term_key").drop("term_key")
    head = [(0, f"@prefix {k}: <{v}> .") for k, v in (PREFIXES | {"ev": VOCABULARY, "dcterms": "http://purl.org/dc/terms/", "": base}).items()]
    head += [(1, f"<{base.rstrip('#')}> a owl:Ontology .")] + [(2, f"ev:{x} a owl:AnnotationProperty .") for x in ANNOTATIONS]
    out = spark.createDataFrame(head, "part int, line string").union(declared(classes, 3, "Class")).union(declared(properties, 4, "ObjectProperty"))
    if retired is not None:
        live = classes.unionByName(properties).select("term_key", F.regexp_replace("term", "^<|>$", "").alias("iri"))
        out = out.union(spark.createDataFrame([(5, "dcterms:isReplacedBy a owl:AnnotationProperty .")], "part int, line string")).union(retired_bridge(retired, live).select(F.lit(6), "line"))
    things = of(entities, "type", "_class", classes)
    denoted = F.array_join(F.transform(F.array_sort("denoted_by"), lambda x: F.concat(F.lit(" ; ev:denotedBy "), literal(x))), "")
    out = out.union(things.select(F.lit(7), F.concat(bracketed(F.col("iri")), F.lit(" a owl:NamedIndividual, "), "_class", F.lit(" ; rdfs:label "), literal(F.col("name")), denoted, provenance(things), F.lit(" ."))))
    facts = of(relations, "name", "_p", properties)
    a, b = bracketed(F.col("from_iri")), bracketed(F.col("to_iri"))
    out = out.union(facts.select(F.lit(8), F.explode(F.array(F.concat(a, F.lit(" "), "_p", F.lit(" "), b, F.lit(" .")), axiom(a, F.col("_p"), b, provenance(facts))))))
    kinds = of(of(type_relations, "sub", "_sub", classes), "super", "_super", classes)
    x, y = F.col("_sub"), F.col("_super")
    return out.union(kinds.select(F.lit(9), F.explode(F.array(F.concat(x, F.lit(" rdfs:subClassOf "), y, F.lit(" .")), axiom(x, F.lit("rdfs:subClassOf"), y, provenance(kinds))))))


def write_turtle(entities: DataFrame, relations: DataFrame, base: str, path: str) -> None:
    """The document as text files whose names sort like their lines; range-partitioned, so no task holds it all."""
    write_lines(lines(entities, relations, base), path)


def write_lines(parts: DataFrame, path: str) -> None:
    """The lines of lines() or document() in their order."""
    parts.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def retired_bridge(old: DataFrame, new: DataFrame) -> DataFrame:
    """line: deprecated IRIs (term_key, iri) that no term has any more under that IRI, with what replaced them."""
    gone = old.join(new.select("term_key", F.col("iri").alias("_new")), "term_key", "left").where(F.col("_new").isNull() | (F.col("_new") != F.col("iri")))
    tail = F.when(F.col("_new").isNotNull(), F.concat(F.lit(" ; <http://purl.org/dc/terms/isReplacedBy> <"), F.col("_new"), F.lit(">"))).otherwise("")
    return gone.select(F.concat(F.lit("<"), F.col("iri"), F.lit("> owl:deprecated true"), tail, F.lit(" .")).alias("line"))
