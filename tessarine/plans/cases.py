"""More registered queries: sources, validation, folding, supplied parameters, review and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocking, cluster, compare, estimate, grounding, metrics, profiles, records, review, score, structures
from ..proposals import chain, checks, confidence, turtle
from ..sources import readers, variants
from . import linkage
from .catalogue import _BASE, _CHAIN, _KEYS, _LABELLED, _NAME, _PARTS, _PRIOR, _REASONS, _TOKS, M, PART_FIELDS, _llr, _scored, _u, as_it_is, chained, first_gray, labelled_patterns, parts, proposed, query, rounded, sql_input, table

# ---------------------------------------------------------------- sources and declarations


@query("SELECT o_orderkey AS record_id, o_custkey AS subject FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 5")
def record_sample(spark, sf_dir):
    """The first five records of a subject; the limit is the feature."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("ord"))
    first = o.agg(F.min("subject")).first()[0]
    return records.first_of_subject(o, first, 5).select("record_id", "subject")


_TYPES_OF = "CASE p_size % 8 WHEN 0 THEN 'Text' WHEN 1 THEN 'Integer' WHEN 2 THEN 'Decimal' WHEN 3 THEN 'Boolean' WHEN 4 THEN 'DateTime' WHEN 5 THEN 'Guid' WHEN 6 THEN 'Json' ELSE 'Date' END"
_KIND_OF = "CASE p_size % 8 WHEN 0 THEN 'Text' WHEN 1 THEN 'WholeNumber' WHEN 2 THEN 'FractionalNumber' WHEN 3 THEN 'Boolean' WHEN 4 THEN 'Timestamp' WHEN 5 THEN 'Identifier' WHEN 6 THEN 'Structured' ELSE 'Date' END"


@query(f"SELECT p_partkey AS record_id, {_KIND_OF} AS kind FROM part")
def declared_kinds(spark, sf_dir):
    p = sql_input(spark, sf_dir, f"SELECT p_partkey AS record_id, {_TYPES_OF} AS column_type FROM part")
    return p.select("record_id", records.declared_kind(F.col("column_type")).alias("kind"))


_FORM_FIELDS = f"SELECT p_brand AS subject, 'f' || CAST(p_partkey AS STRING) AS name, {_TYPES_OF} AS column_type, {_KIND_OF} AS kind, p_size % 2 = 0 AS nullable, p_name AS business_name, CASE p_partkey % 5 WHEN 0 THEN 'form' || CAST(p_partkey % 7 AS STRING) END AS bound_to, CASE p_partkey % 3 WHEN 0 THEN 'via' || CAST(p_partkey % 11 AS STRING) END AS via_field FROM part"
_FORM_RELATIONS = "SELECT p_brand AS subject, 'r' || CAST(p_partkey AS STRING) AS name, 'form' || CAST(p_partkey % 7 AS STRING) AS target, 'f' || CAST(p_partkey + p_partkey % 2 AS STRING) AS via_field, CASE p_partkey % 2 WHEN 0 THEN 'Reference' ELSE 'Child' END AS kind FROM part"
_FORM_SECTIONS = "SELECT 'Brand#' || CAST(n_nationkey AS STRING) AS subject, 'section of ' || n_name AS relation, 'form' || CAST(n_regionkey AS STRING) AS parent, 'key' || CAST(n_nationkey AS STRING) AS key_field FROM nation"
_STRUCTURE = (
    f"f AS ({_FORM_FIELDS}), r AS ({_FORM_RELATIONS} UNION ALL SELECT subject, relation, parent, key_field, 'Parent' FROM ({_FORM_SECTIONS})), "
    "c AS (SELECT DISTINCT subject, name, bound_to AS target FROM f WHERE bound_to IS NOT NULL UNION SELECT subject, via_field, bound_to FROM f WHERE bound_to IS NOT NULL AND via_field IS NOT NULL), "
    "e AS (SELECT subject, name, target, via_field, kind FROM r UNION ALL SELECT subject, name, target, name, 'Reference' FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.subject = c.subject AND r.target = c.target AND r.via_field = c.name))"
)


def declared_forms(spark, sf_dir):
    return structures.structures(sql_input(spark, sf_dir, _FORM_FIELDS), sql_input(spark, sf_dir, _FORM_RELATIONS), sql_input(spark, sf_dir, _FORM_SECTIONS))


@query(f"WITH {_STRUCTURE} SELECT subject, 'field' AS item, name, kind || '/' || CAST(NOT nullable AS STRING) AS detail FROM f UNION ALL SELECT subject, 'relation', name, target || '/' || via_field || '/' || kind FROM e")
def structure_source(spark, sf_dir):
    """Forms' fields and relations as declared structures: parents of sections and references of bound fields included."""
    s = declared_forms(spark, sf_dir)
    fields = s.select("subject", F.lit("field").alias("item"), F.explode("fields").alias("x")).select("subject", "item", "x.name", F.concat_ws("/", "x.kind", F.col("x.required").cast("string")).alias("detail"))
    relations = s.select("subject", F.lit("relation").alias("item"), F.explode("relations").alias("x")).select("subject", "item", "x.name", F.concat_ws("/", "x.target", "x.via_field", "x.kind").alias("detail"))
    return fields.unionByName(relations)


@query(f"WITH {_STRUCTURE}, n AS (SELECT subject, count(*) AS k FROM f GROUP BY subject), m AS (SELECT subject, count(*) AS k FROM e GROUP BY subject), a AS (SELECT subject FROM n UNION SELECT subject FROM m), q AS (SELECT DISTINCT p_brand AS subject FROM part UNION SELECT n_name FROM nation) SELECT q.subject, a.subject IS NOT NULL AS declared, coalesce(n.k, 0)::BIGINT AS n_fields, coalesce(m.k, 0)::BIGINT AS n_relations FROM q LEFT JOIN a USING (subject) LEFT JOIN n USING (subject) LEFT JOIN m USING (subject)")
def structure_lookup(spark, sf_dir):
    """Structures of subjects asked for, of which the nations' names are declared nowhere."""
    asked = sql_input(spark, sf_dir, "SELECT p_brand AS subject FROM part UNION SELECT n_name FROM nation")
    got = structures.structure_of(declared_forms(spark, sf_dir), asked)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long")
    return got.select("subject", F.col("fields").isNotNull().alias("declared"), size("fields").alias("n_fields"), size("relations").alias("n_relations"))


@query("SELECT n_name AS subject, 'section' AS name, r_name AS target, 'key' || CAST(n_nationkey AS STRING) AS via_field, 'Child' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'up', r_name, CAST(n_nationkey AS STRING), 'Parent' FROM nation JOIN region ON n_regionkey = r_regionkey")
def parent_relations(spark, sf_dir):
    relations = sql_input(spark, sf_dir, "SELECT n_name AS subject, 'section' AS name, r_name AS target, 'key' || CAST(n_nationkey AS STRING) AS via_field, 'Child' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey")
    sections = sql_input(spark, sf_dir, "SELECT n_name AS subject, 'up' AS relation, r_name AS parent, CAST(n_nationkey AS STRING) AS key_field FROM nation JOIN region ON n_regionkey = r_regionkey")
    return structures.with_parents(relations, sections)


_DECLARED = "SELECT CASE c_custkey % 9 WHEN 0 THEN 'Thing ' || CAST(c_custkey % 50 AS STRING) ELSE c_name END AS subject, CASE c_custkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN 'key' END AS key_field, CASE c_custkey % 6 WHEN 0 THEN '--' WHEN 1 THEN lower(replace(c_name, '#', ' ')) ELSE c_mktsegment END AS super FROM customer"


@query(
    f"WITH d AS (SELECT *, {_NAME('subject')} AS k, {_NAME('super')} AS s FROM ({_DECLARED})) SELECT subject, 'RepeatedSubject' AS defect, k AS detail FROM d WHERE k IN (SELECT k FROM d GROUP BY k HAVING count(*) > 1) "
    "UNION ALL SELECT subject, 'BlankKeyField', key_field FROM d WHERE trim(key_field) = '' UNION ALL SELECT subject, CASE WHEN s = '' THEN 'SuperTypeWithoutName' ELSE 'SuperTypeIsItself' END, super FROM d WHERE s = '' OR s = k"
)
def declaration_defects(spark, sf_dir):
    d = sql_input(spark, sf_dir, _DECLARED)
    return structures.declaration_defects(d.select("subject", "key_field", F.array("super").alias("super_types")), False)


_KNOWN = "SELECT CASE c_custkey % 20 WHEN 0 THEN ' ' WHEN 1 THEN 'k' || CAST(c_custkey % 60 AS STRING) ELSE 'k' || CAST(c_custkey AS STRING) END AS key, c_name AS name, c_mktsegment AS type, c_custkey AS record_id FROM customer"
_ONLY_MENTIONED = "SELECT 'k' || CAST(s_suppkey * 3 AS STRING) AS key, CASE s_suppkey % 11 WHEN 0 THEN '' ELSE s_name END AS name, 'Supplier' AS type, -s_suppkey AS record_id FROM supplier"
_KNOWN_TYPES = "SELECT CASE n_nationkey % 5 WHEN 0 THEN '?!' WHEN 1 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT n_name FROM nation"


@query(
    f"WITH k AS ({_KNOWN}), m AS ({_ONLY_MENTIONED}), t AS (SELECT name, {_NAME('name')} AS n FROM ({_KNOWN_TYPES})) "
    "SELECT 'BlankKnown' AS defect, key AS item FROM k WHERE trim(key) = '' OR trim(name) = '' OR trim(type) = '' UNION ALL SELECT 'BlankMentioned', key FROM m WHERE trim(key) = '' OR trim(name) = '' OR trim(type) = '' "
    "UNION ALL SELECT 'RepeatedKey', key FROM k GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'RepeatedKey', key FROM m GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'KnownAndMentioned', key FROM (SELECT DISTINCT key FROM k) JOIN (SELECT DISTINCT key FROM m) USING (key) "
    "UNION ALL SELECT 'BlankType', name FROM t WHERE n = '' UNION ALL SELECT 'RepeatedType', n FROM t WHERE n <> '' GROUP BY n HAVING count(*) > 1 UNION ALL SELECT 'RecordSeenBefore', CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey IN (SELECT record_id FROM k UNION SELECT record_id FROM m)"
)
def prior_defects(spark, sf_dir):
    known, mentioned = sql_input(spark, sf_dir, _KNOWN), sql_input(spark, sf_dir, _ONLY_MENTIONED)
    seen = known.select("record_id").union(mentioned.select("record_id"))
    return records.prior_defects(known, mentioned, sql_input(spark, sf_dir, _KNOWN_TYPES), seen, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")), False)


@query("SELECT n_name, 'nation/' || substr(sha256(CAST(length(CAST(n_nationkey AS STRING)) AS STRING) || ':' || CAST(n_nationkey AS STRING) || CAST(length(n_name) AS STRING) || ':' || n_name || CAST(length(CAST(n_regionkey AS STRING)) AS STRING) || ':' || CAST(n_regionkey AS STRING)), 1, 16) || '/1' AS record_id FROM nation")
def table_records(spark, sf_dir):
    """Rows of any table as records, with ids by content."""
    return readers.table_records(table(spark, sf_dir, "nation"), "nation").select("n_name", "record_id")


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def json_values(spark, sf_dir):
    flat = records.flattened_json(table(spark, sf_dir, "events"), "props")
    return flat.select("event_id", F.explode("fields").alias("name", "value"))


@query("SELECT a.s_suppkey AS id_a, b.n_nationkey AS id_b FROM supplier a CROSS JOIN nation b")
def all_cross_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"))
    return blocking.all_cross(s, n).select(F.col("a_ord").alias("id_a"), F.col("b_ord").alias("id_b"))


@query(f"WITH {_scored()} SELECT id_a, id_b, round(llr, 6) AS llr, cls FROM scored")
def link_parts_tiled(spark, sf_dir):
    """The pairs of link_parts_scored, with every block of more than 50 records joined in tiles."""
    df = parts(spark, sf_dir)
    p = estimate.from_non_match_agreement({r["field"]: r["u"] for r in estimate.non_match_agreement(df, PART_FIELDS).collect()}, M)
    pairs = compare.with_levels(blocking.blocked_pairs(df, [["p_name"]], most=50), dict.fromkeys(PART_FIELDS, compare.EXACT)).withColumn("llr", score.llr(p))
    return rounded(pairs.select(F.col("a_record_id").alias("id_a"), F.col("b_record_id").alias("id_b"), "llr", score.classify(F.col("llr")).alias("cls")), "llr")


@query("SELECT c_custkey AS record_id FROM customer ORDER BY sha256('3/' || CAST(c_custkey AS STRING)), c_custkey LIMIT 40")
def hash_ordered_sample(spark, sf_dir):
    """Forty customers in hash order; a sampling operator."""
    return review.hash_sample(table(spark, sf_dir, "customer"), "c_custkey", 40, 3).select(F.col("c_custkey").alias("record_id"))


# ---------------------------------------------------------------- folding

_ODD = lambda c: f"CASE WHEN doc_id % 2 = 1 THEN replace(replace(replace({c}, 'ä', 'ä'), 'é', 'é'), 'a', 'ａ') ELSE {c} END"  # noqa: E731  decomposed and full-width
_FOLDED = lambda c: f"nfc_normalize(replace({c}, 'ａ', 'a'))"


@query(f"WITH d AS (SELECT doc_id, {_ODD('text')} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(lower(regexp_replace({_FOLDED('text')}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))) AS name_key, sha256(nfc_normalize(text)) AS canonical FROM d")
def folded_texts(spark, sf_dir):
    """Whole texts, half of them written with decomposed and full-width letters, by their folded and canonical forms."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"{_ODD('text')} AS text")
    return d.select("doc_id", F.sha2(text.name_key(F.col("text")), 256).alias("name_key"), F.sha2(text.canonical(F.col("text")), 256).alias("canonical"))


_SPELT = "SELECT c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'ä' || c_mktsegment WHEN 1 THEN ' ä' || lower(c_mktsegment) WHEN 2 THEN 'Ä' || c_mktsegment || ' ' ELSE c_mktsegment END AS name, CAST(c_nationkey AS STRING) AS nation FROM customer"


@query(f"WITH c AS (SELECT ord, nation, upper(trim(nfc_normalize(name))) AS k FROM ({_SPELT})) SELECT a.ord AS id_a, b.ord AS id_b FROM c a JOIN c b ON a.ord < b.ord AND a.k = b.k AND a.nation = b.nation")
def folded_blocks(spark, sf_dir):
    """Blocking by names that are spelt composed, decomposed, in either case and padded."""
    c = records.prepared(sql_input(spark, sf_dir, _SPELT), ["name", "nation"])
    return profiles.paired(c, [["name", "nation"]], [], as_it_is).select(F.col("a_ord").alias("id_a"), F.col("b_ord").alias("id_b"))


@query("SELECT s_suppkey AS record_id, s_name AS as_is, coalesce(s_name, '') AS missing_empty, coalesce(s_name, '   ') AS missing_blank, '  ' || s_name || ' ' AS padded, upper(s_name) AS upper, lower(s_name) AS lower, replace(CAST(DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) AS STRING), '-', '') AS plain, CAST(DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) AS STRING) AS dates_dashed, strftime(DATE '2020-01-01' + CAST(s_suppkey AS INTEGER), '%d/%m/%Y') AS dates_slashed, CAST(s_suppkey AS STRING) || '.0' AS numbers_as_decimals FROM supplier")
def source_rewrites(spark, sf_dir):
    """Every rewrite of values."""
    s = table(spark, sf_dir, "supplier").withColumn("plain", F.date_format(F.expr("date_add(DATE '2020-01-01', CAST(s_suppkey AS INT))"), "yyyyMMdd"))
    of = {n: variants.rewrite(F.col("s_name"), n) for n in ("as_is", "missing_empty", "missing_blank", "padded", "upper", "lower")}
    of |= {n: variants.rewrite(F.col("plain"), n) for n in ("dates_dashed", "dates_slashed")} | {"numbers_as_decimals": variants.rewrite(F.col("s_suppkey").cast("string"), "numbers_as_decimals")}
    return s.select(F.col("s_suppkey").alias("record_id"), "plain", *[c.alias(n) for n, c in of.items()])


# ---------------------------------------------------------------- parameters through the plan

_JACCARD = "len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"


@query(
    f"WITH {_PARTS}, {_u(['p_brand'])}, v AS (SELECT p_type AS v, count(*) AS c, list_distinct(regexp_extract_all(p_type, '[\\p{{L}}\\p{{Nd}}]+')) AS t FROM parts WHERE p_type IS NOT NULL GROUP BY p_type), "
    f"l AS (SELECT CAST(s >= 0.3 AS INT) + CAST(s >= 1.0 AS INT) AS g, w FROM (SELECT {_JACCARD} AS s, (a.c * b.c)::DOUBLE AS w FROM v a JOIN v b ON a.v < b.v UNION ALL SELECT 1.0::DOUBLE, (c * (c - 1) // 2)::DOUBLE FROM v)), "
    "s AS (SELECT sum(CASE WHEN g = 1 THEN w ELSE 0 END) / sum(w) AS u1, sum(CASE WHEN g = 2 THEN w ELSE 0 END) / sum(w) AS u2 FROM l), b AS (SELECT least(0.99::DOUBLE, greatest(0.01::DOUBLE, u1)) AS u1, least(0.99::DOUBLE, greatest(0.01::DOUBLE, u2)) AS u2 FROM s), "
    "z AS (SELECT u1, u2, 1 - u1 - u2 AS r FROM b), y AS (SELECT u1, u2, least(0.99::DOUBLE, greatest(0.01::DOUBLE, r)) AS u0, r FROM z), x AS (SELECT CASE WHEN r BETWEEN 0.01 AND 0.99 THEN 1.0::DOUBLE ELSE u0 + u1 + u2 END AS d, u0, u1, u2 FROM y) "
    "SELECT 'p_type' AS field, 0 AS level, round(u0 / d, 6) AS u FROM x UNION ALL SELECT 'p_type', 1, round(u1 / d, 6) FROM x UNION ALL SELECT 'p_type', 2, round(u2 / d, 6) FROM x UNION ALL SELECT 'p_brand', 0, round(1 - u_p_brand, 6) FROM u UNION ALL SELECT 'p_brand', 1, round(u_p_brand, 6) FROM u"
)
def u_per_level(spark, sf_dir):
    """u of every level, from distinct values and their counts: all pairs of parts stand behind it."""
    how = {"p_brand": compare.EXACT, "p_type": compare.Comparison("token_jaccard", (0.3, 1.0))}
    found = estimate.level_agreement(parts(spark, sf_dir), how)
    return spark.createDataFrame([(f, k, round(x, 6)) for f, u in found.items() for k, x in enumerate(u)], "field string, level int, u double")


_RARE = {"p_brand": {"BRAND#11": 0.5, "BRAND#12": 0.02, "BRAND#23": 0.001}}
_GIVEN_U = {"p_name": 0.02, "p_brand": 0.1, "p_type": 0.2}
_GIVEN = ", ".join(f"{x}::DOUBLE AS u_{f}" for f, x in _GIVEN_U.items())
_GAIN = "CASE WHEN a.p_brand = b.p_brand THEN CASE a.p_brand " + " ".join(f"WHEN '{v}' THEN ln(0.1::DOUBLE / greatest({x}::DOUBLE, 0.01::DOUBLE))" for v, x in _RARE["p_brand"].items()) + " ELSE 0.0 END ELSE 0.0 END"


@query(f"WITH {_PARTS}, u AS (SELECT {_GIVEN}), s AS (SELECT a.id AS id_a, b.id AS id_b, {_llr(list(_GIVEN_U))} + {_GAIN} AS llr FROM parts a JOIN parts b ON a.id < b.id AND a.p_name = b.p_name CROSS JOIN u) SELECT id_a, id_b, round(llr, 6) AS llr, CASE WHEN llr >= 4 THEN 'Match' WHEN llr <= -4 THEN 'NonMatch' ELSE 'GrayZone' END AS cls FROM s")
def supplied_parameters(spark, sf_dir):
    """The whole plan with supplied parameters and value frequencies: nothing is fitted, rare brands say more."""
    p = estimate.with_frequencies(estimate.from_non_match_agreement(_GIVEN_U, M), _RARE)
    return rounded(linkage.analyze(parts(spark, sf_dir), linkage.Options(list(_GIVEN_U), [["p_name"]]), parameters=p).pairs, "llr")


def _fixed_em(rounds: int, u: dict[str, float]) -> str:
    """Expectation maximisation with u pinned, unrolled."""
    f = ["p_brand", "p_type", "p_size"]
    bound = lambda x: f"least(0.99::DOUBLE, greatest(0.01::DOUBLE, {x}))"
    of = lambda c: f"{u[c]}::DOUBLE" if c in u else f"u_{c}"
    out = [f"WITH {_PARTS}, pat AS (SELECT {', '.join(f'CAST(a.{c} = b.{c} AS INT) AS {c}' for c in f)}, count(*)::DOUBLE AS n FROM parts a JOIN parts b ON a.id < b.id AND a.p_name = b.p_name GROUP BY 1, 2, 3)", f"t0 AS (SELECT 0.5::DOUBLE AS prior, {', '.join(f'0.9::DOUBLE AS m_{c}, 0.1::DOUBLE AS u_{c}' for c in f)})"]
    for k in range(rounds):
        x = " + ".join(f"CASE WHEN {c} = 1 THEN ln(m_{c} / {of(c)}) ELSE ln((1 - m_{c}) / (1 - {of(c)})) END" for c in f)
        out.append(f"r{k} AS (SELECT pat.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(prior) - ln(1 - prior) + {x}))) AS r FROM pat CROSS JOIN t{k})")
        out.append(f"t{k + 1} AS (SELECT (sum(n * r) + 0.5::DOUBLE) / (sum(n) + 1) AS prior, " + ", ".join(f"{bound(f'sum(n * r * {c}) / sum(n * r)')} AS m_{c}, {bound(f'sum(n * (1 - r) * {c}) / sum(n * (1 - r))')} AS u_{c}" for c in f) + f" FROM r{k})")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(m_{c}, 6) AS m, round({of(c)}, 6) AS u, round(prior, 6) AS prior FROM t{rounds}" for c in f)


_PINNED = {"p_brand": 0.04, "p_type": 0.15}


@query(_fixed_em(4, _PINNED))
def em_fixed_u(spark, sf_dir):
    """Four rounds of the plan's estimation with u of two fields pinned; nothing is relabelled."""
    options = linkage.Options(["p_brand", "p_type", "p_size"], [["p_name"]], most_rounds=4, tolerance=1e-12)
    p = linkage.analyze(parts(spark, sf_dir), options, fixed_u={f: [1 - x, x] for f, x in _PINNED.items()}).parameters
    return spark.createDataFrame([(f, round(p.m[f][1], 6), round(p.u[f][1], 6), round(p.prior, 6)) for f in p.m], "field string, m double, u double, prior double")


# ---------------------------------------------------------------- clusters, candidates, review

_ANSWERED = "SELECT 'e' || CAST(CASE p_partkey % 3 WHEN 0 THEN p_size ELSE p_partkey % 40 END AS STRING) AS entity_id, p_partkey AS record_id FROM part"


@query(f"WITH c AS (SELECT p_partkey AS record_id, p_brand AS cluster_id FROM part), e AS ({_ANSWERED}) SELECT cluster_id, count(DISTINCT entity_id) AS n_entities FROM e JOIN c USING (record_id) GROUP BY cluster_id HAVING count(DISTINCT entity_id) > 1 AND count(DISTINCT record_id) > 1")
def split_clusters(spark, sf_dir):
    """Groups of parts whose records an answer gives to several entities."""
    clusters = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("cluster_id"))
    return cluster.split_clusters(clusters, sql_input(spark, sf_dir, _ANSWERED))


_CONFIRMED = "SELECT 'm' || CAST(s_suppkey AS STRING) AS a, CASE s_suppkey % 3 WHEN 0 THEN 'm' || CAST(s_suppkey % 17 AS STRING) ELSE 'iri' || CAST(s_suppkey % 9 AS STRING) END AS b FROM supplier"


@query(f"WITH RECURSIVE c AS ({_CONFIRMED}), e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r AS (SELECT a AS key, a AS x FROM e UNION SELECT r.key, e.b FROM r JOIN e ON r.x = e.a), k AS (SELECT key, min(x) AS identity FROM r GROUP BY key) SELECT q.key, coalesce(k.identity, q.key) AS identity FROM (SELECT a AS key FROM c UNION SELECT b FROM c UNION SELECT n_name FROM nation) q LEFT JOIN k USING (key)")
def confirmed_identity(spark, sf_dir):
    """What confirmed merges make one, nations' names beside them as keys that no merge names."""
    confirmed = sql_input(spark, sf_dir, _CONFIRMED)
    keys = confirmed.select(F.col("a").alias("key")).union(confirmed.select("b")).union(sql_input(spark, sf_dir, "SELECT n_name FROM nation"))
    return cluster.confirmed_identity(confirmed, keys)


@query(f"WITH {_scored()}, o AS (SELECT 0 AS kind, id_a, id_b, round(llr, 9) AS llr FROM scored WHERE cls = 'GrayZone' UNION ALL SELECT 1, id_b, id_a, round(llr - 0.5, 9) FROM scored WHERE cls = 'GrayZone') SELECT kind, id_a, id_b, round(llr, 6) AS llr FROM (SELECT * FROM o ORDER BY o.llr DESC, kind, id_a, id_b LIMIT 300)")
def gray_budget_shared(spark, sf_dir):
    """A budget of 300 shared by undecided pairs and undecided candidates; the limit is the feature."""
    return rounded(first_gray(spark, sf_dir, 300, {0: 0.0, 1: -0.5}).select("kind", "id_a", "id_b", "llr"), "llr")


@query(f"WITH c AS ({_CHAIN}), n AS (SELECT key, first(name ORDER BY ord) AS name, first(type ORDER BY ord) AS type, list('r' || CAST(ord AS STRING)) AS records FROM c WHERE m = 2 GROUP BY key), b AS (SELECT 'k' || CAST(c_custkey AS STRING) AS key, c_name AS name, c_mktsegment AS type, ['old' || CAST(c_nationkey AS STRING), 'r' || CAST(c_custkey AS STRING)] AS records FROM customer), u AS (SELECT key, coalesce(b.name, n.name) AS name, coalesce(b.type, n.type) AS type, list_sort(list_distinct(list_concat(coalesce(b.records, []), coalesce(n.records, [])))) AS records FROM b FULL JOIN n USING (key)) SELECT key, name, type, array_to_string(records, ',') AS records FROM u WHERE key NOT IN (SELECT key FROM c WHERE m = 0)")
def chain_mentioned_upsert(spark, sf_dir):
    """Mentioned entities of earlier calls merged with this call's; keys that became known leave."""
    e = chained(spark, sf_dir)
    before = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.array(F.concat(F.lit("old"), F.col("c_nationkey").cast("string")), F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).alias("records"))
    return chain.accumulated(before, chain.to_mentioned(e), chain.to_known(e)).withColumn("records", F.array_join("records", ","))


@query(f"SELECT p_partkey AS record_id, round(CASE p_size % 3 WHEN 0 THEN least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(x + ln({_PRIOR}::DOUBLE) - ln(1 - {_PRIOR}::DOUBLE)))))) WHEN 1 THEN least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(x + ln({_PRIOR}::DOUBLE) - ln(1 - {_PRIOR}::DOUBLE) + ln(c / (1 - c))))))) ELSE c END, 6) AS confidence FROM (SELECT *, CAST(p_partkey % 23 AS DOUBLE) - 11 AS x, CAST(p_partkey % 19 + 1 AS DOUBLE) / 20 AS c FROM part)")
def known_fusion(spark, sf_dir):
    """A model's confidence with the strongest candidate of a known entity: match, undecided or none."""
    p = table(spark, sf_dir, "part")
    cls = F.when(F.col("p_size") % 3 == 0, score.MATCH).when(F.col("p_size") % 3 == 1, score.GRAY)
    c = (F.col("p_partkey") % 19 + 1).cast("double") / F.lit(20.0)
    return rounded(p.select(F.col("p_partkey").alias("record_id"), confidence.fused_known(c, (F.col("p_partkey") % 23).cast("double") - F.lit(11.0), cls, _PRIOR).alias("confidence")), "confidence")


@query("SELECT p_partkey AS record_id, CASE WHEN p_size >= 30 THEN 'AutoApply' ELSE 'Review' END AS tier, p_name AS rationale, CASE WHEN p_size >= 30 THEN 'Settled' ELSE 'Escalated' END AS step, '[\"r' || CAST(p_partkey AS STRING) || '\",\"s' || CAST(p_size AS STRING) || '\"]' AS sources FROM part")
def provenance_stamps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tier = F.when(F.col("p_size") >= 30, "AutoApply").otherwise("Review")
    step = F.when(F.col("p_size") >= 30, "Settled").otherwise("Escalated")
    stamp = confidence.stamp(tier, F.col("p_name"), step, F.array(F.concat(F.lit("r"), F.col("p_partkey").cast("string")), F.concat(F.lit("s"), F.col("p_size").cast("string"))))
    return p.select(F.col("p_partkey").alias("record_id"), stamp.alias("x")).select("record_id", "x.*")


_SEEN = "SELECT a.s_suppkey AS record_id, b.s_suppkey AS candidate_id FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR abs(a.s_suppkey - b.s_suppkey) = 3)"
_SAID = "CASE WHEN (record_id + candidate_id) % 11 = 0 THEN 'CannotTell' WHEN (record_id + candidate_id) % 3 = 0 THEN 'Same' ELSE 'Different' END"


def seen_pairs(spark, sf_dir):
    """The rows of _SEEN by equi-joins, one for each side of its OR: a nested loop over all suppliers takes its place otherwise."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    a, b = (s.withColumnsRenamed({"id": f"{x}_id", "nation": f"{x}_nation"}) for x in "ab")
    near = a.withColumn("_to", F.explode(F.array(F.col("a_id") - 3, F.col("a_id") + 3))).join(b, F.col("_to") == F.col("b_id")).where(~F.coalesce(F.col("a_nation") == F.col("b_nation"), F.lit(False)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = a.repartition(n).join(b, F.col("a_nation") == F.col("b_nation")).where("a_id <> b_id")
    return own.select("a_id", "b_id").unionByName(near.select("a_id", "b_id")).toDF("record_id", "candidate_id")


@query(
    f"WITH v AS (SELECT *, {_SAID} AS outcome FROM ({_SEEN})), c AS (SELECT s_suppkey AS record_id, s_nationkey AS cluster_id, s_nationkey % 2 AS odd, count(*) OVER (PARTITION BY s_nationkey)::DOUBLE AS size FROM supplier), j AS (SELECT v.record_id, v.outcome, o.cluster_id = t.cluster_id AS ins FROM v JOIN c o ON v.record_id = o.record_id JOIN c t ON v.candidate_id = t.record_id), "
    "s AS (SELECT record_id, sum(CASE WHEN outcome = 'Different' AND ins THEN 1.0 ELSE 0 END) AS d, sum(CASE WHEN outcome = 'Same' AND NOT ins THEN 1.0 ELSE 0 END) AS m, sum(CASE WHEN outcome = 'CannotTell' AND ins THEN 1.0 ELSE 0 END) AS oi, sum(CASE WHEN outcome = 'CannotTell' AND NOT ins THEN 1.0 ELSE 0 END) AS oo FROM j GROUP BY record_id), "
    "x AS (SELECT odd, size, coalesce(d, 0) AS d, coalesce(m, 0) AS m, coalesce(oi, 0) AS oi, coalesce(oo, 0) AS oo FROM c LEFT JOIN s USING (record_id)) "
    "SELECT CASE odd WHEN 0 THEN 'Even' ELSE 'Odd' END AS stratum, count(*) AS population, count(*) AS n_sampled, sum(CAST(oi + oo > 0 AS BIGINT))::BIGINT AS n_excluded, round(avg(CASE WHEN oi + oo = 0 THEN (size - d) / size END), 6) AS review_precision, round(avg(CASE WHEN oi + oo = 0 THEN (size - d) / (size - d + m) END), 6) AS review_recall, round(avg((size - d - oi) / size), 6) AS precision_low, round(avg((size - d) / size), 6) AS precision_high, round(avg((size - d - oi) / (size - d - oi + m + oo)), 6) AS recall_low, round(avg((size - d) / (size - d + m)), 6) AS recall_high FROM x GROUP BY odd"
)
def review_by_stratum(spark, sf_dir):
    """All suppliers reviewed by one of two reviewers, scored a stratum at a time."""
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_nationkey").alias("cluster_id"))
    seen = seen_pairs(spark, sf_dir)
    verdicts = seen.select(F.lit("r1").alias("reviewer_id"), "record_id", "candidate_id", F.expr(_SAID).alias("outcome")).unionByName(seen.select(F.lit("r2").alias("reviewer_id"), "record_id", "candidate_id", F.lit("Same").alias("outcome")))
    strata = clusters.select("record_id", F.when(F.col("cluster_id") % 2 == 0, "Even").otherwise("Odd").alias("stratum"))
    sample = strata.join(strata.groupBy("stratum").agg(F.count("*").alias("population")), "stratum")
    out = review.scores_by_stratum(review.scored_sample(sample, clusters, verdicts, "r1", seen))
    return rounded(out, *[c for c in out.columns if c.startswith(("review", "precision", "recall"))])


# ---------------------------------------------------------------- export


@query(
    f"SELECT '<{_BASE}c' || CAST(c_custkey AS STRING) || '> a owl:NamedIndividual, <{_BASE}' || c_mktsegment || '> ; rdfs:label \"' || c_name || '\" ; ev:denotedBy \"r' || CAST(c_custkey AS STRING) || '\" ; ev:claim \"bought by ' || c_name || '\" ; ev:cites [ ev:recordId \"r' || CAST(c_custkey AS STRING) || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ' ; ev:fieldName \"name\"' ELSE '' END || ' ] ; ev:confidence \"' || printf('%.6f', CAST(c_custkey % 20 AS DOUBLE) / 20) || '\"^^xsd:decimal ; ev:basis \"' || CASE WHEN c_custkey % 3 = 0 THEN 'declared' ELSE 'inferred' END || '\" .' AS line FROM customer "
    f"UNION ALL SELECT '<{_BASE}c' || CAST(c_custkey AS STRING) || '> <{_BASE}near> <{_BASE}n' || CAST(c_nationkey AS STRING) || '> .' FROM customer"
)
def turtle_statements(spark, sf_dir):
    """Customers and what they are near to, as a document's individuals and relations with their provenance."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    cited = F.array(F.struct(F.concat(F.lit("r"), key).alias("record_id"), F.when(F.col("c_custkey") % 2 == 0, "name").alias("field_name")))
    told = [F.concat(F.lit("bought by "), "c_name").alias("claim"), cited.alias("sources"), ((F.col("c_custkey") % 20).cast("double") / F.lit(20.0)).alias("confidence"), F.when(F.col("c_custkey") % 3 == 0, "Declared").otherwise("Inferred").alias("basis")]
    iri = F.concat(F.lit(f"{_BASE}c"), key)
    entities = c.select(iri.alias("iri"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.array(F.concat(F.lit("r"), key)).alias("denoted_by"), *told)
    relations = c.select(F.lit("near").alias("name"), iri.alias("from_iri"), F.concat(F.lit(f"{_BASE}n"), F.col("c_nationkey").cast("string")).alias("to_iri"), *told)
    kinds = c.limit(0).select(F.lit("a").alias("sub"), F.lit("b").alias("super"), *told)
    out = turtle.document(entities, relations, kinds, _BASE, folded=False)
    return out.where((F.col("part") == 7) | ((F.col("part") == 8) & ~F.startswith("line", F.lit("[]")))).select("line")


# ---------------------------------------------------------------- more checks and measures


@query(f"WITH {_LABELLED}, x AS (SELECT same, 'ratio' AS scale, llr AS v FROM scored UNION ALL SELECT same, 'posterior', llr + ln({_PRIOR}::DOUBLE) - ln(1 - {_PRIOR}::DOUBLE) FROM scored) SELECT scale, CASE WHEN v >= 4 THEN 'Match' WHEN v <= -4 THEN 'NonMatch' ELSE 'GrayZone' END AS cls, same, count(*) AS n FROM x GROUP BY 1, 2, 3")
def threshold_scales(spark, sf_dir):
    """The same thresholds on the ratio and on the posterior's log odds, by label."""
    return metrics.scale_comparison(labelled_patterns(spark, sf_dir), _PRIOR, weight="n")


@query(f"WITH c AS (SELECT conv_id, turn, {_TOKS('text')} AS w FROM conversations WHERE role = 'assistant'), s AS (SELECT a.conv_id, a.turn, list_distinct(flatten(list({_TOKS('q.text')}))) AS h FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn), o AS (SELECT CAST(c.conv_id AS STRING) || '/' || CAST(c.turn AS STRING) AS claim_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(coalesce(h, []), x)))::DOUBLE / len(w) END AS s FROM c LEFT JOIN s USING (conv_id, turn)) SELECT claim_id, round(s, 6) AS overlap, coalesce(s >= 0.3, FALSE) AS is_supported FROM o")
def grounding_claims(spark, sf_dir):
    """Answers as claims that cite every earlier turn of their conversation, by folded words."""
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claim_id")
    claims = c.where("role = 'assistant'").select(key, "conv_id", "turn", F.coalesce("text", F.lit("")).alias("claim"))
    sources = claims.select("claim_id", "conv_id", F.col("turn").alias("_at")).join(c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), "conv_id").where("turn < _at")
    return rounded(grounding.check_claims(claims.select("claim_id", "claim"), sources.select("claim_id", "text")), "overlap")


_GROUPED = "SELECT 'g' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) AS entity_id, 'group ' || CAST(c_custkey % 5 AS STRING) AS name, c_custkey AS record_id FROM customer UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE 'group 1' END, c_custkey FROM customer"
_POINTS = "SELECT c_custkey AS record_id, CASE c_custkey % 3 WHEN 0 THEN ' key  ' || CAST(c_custkey + 1 AS STRING) WHEN 1 THEN 'Key ' || CAST(c_custkey AS STRING) ELSE 'GROUP 1' END AS value FROM customer"
_OWN_KEYS = "SELECT c_custkey AS record_id, 'key ' || CAST(c_custkey AS STRING) AS key FROM customer"


@query(f"WITH d AS ({_GROUPED}), r AS (SELECT DISTINCT record_id, upper(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS t FROM ({_POINTS})), k AS (SELECT record_id AS other, upper(key) AS t FROM ({_OWN_KEYS})), b AS (SELECT DISTINCT d.entity_id, r.record_id FROM r JOIN k ON r.t = k.t AND r.record_id <> k.other JOIN d ON d.record_id = k.other), h AS (SELECT d.entity_id, d.record_id, EXISTS (SELECT 1 FROM r WHERE r.record_id = d.record_id AND r.t = upper(d.name)) OR EXISTS (SELECT 1 FROM b WHERE b.record_id = d.record_id AND b.entity_id = d.entity_id) AS hit FROM d), w AS (SELECT *, sum(CAST(NOT hit AS INT)) OVER (PARTITION BY record_id) AS remain FROM h) SELECT entity_id, record_id FROM w WHERE hit AND remain > 0")
def demotion_by_key(spark, sf_dir):
    """Denotations that fall as a reference field holds the name, or the key of another record that denotes the entity."""
    return checks.demotions(sql_input(spark, sf_dir, _GROUPED), sql_input(spark, sf_dir, _POINTS), sql_input(spark, sf_dir, _OWN_KEYS))


_TOLD = "SELECT CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE 'rel' || CAST(o_orderkey AS STRING) END AS name, 'e' || CAST(o_custkey AS STRING) AS from_id, 'e' || CAST(o_custkey + o_orderkey % 7 AS STRING) AS to_id, 'told' AS claim, CAST(o_orderkey % 22 AS DOUBLE) / 20 AS confidence, o_orderkey AS ord FROM orders"


@query(f"WITH {_REASONS}, l AS ({_TOLD}), p AS (SELECT DISTINCT entity_id FROM m), a AS (SELECT DISTINCT entity_id FROM m WHERE reason IS NULL), x AS (SELECT *, CASE WHEN trim(name) = '' THEN 'MissingField' WHEN NOT confidence BETWEEN 0 AND 1 THEN 'ConfidenceOutOfRange' WHEN ord % 31 = 0 THEN 'NoSource' WHEN from_id NOT IN (SELECT entity_id FROM p) OR to_id NOT IN (SELECT entity_id FROM p) THEN 'DanglingEndpoint' WHEN from_id NOT IN (SELECT entity_id FROM a) OR to_id NOT IN (SELECT entity_id FROM a) THEN 'EndpointRejected' END AS reason FROM l) SELECT 'Relation' AS kind, name AS element_id, reason, from_id || ' -> ' || to_id AS detail FROM x WHERE reason IS NOT NULL")
def relation_rejections(spark, sf_dir):
    """Relations with defects of their own or of their ends."""
    e = proposed(spark, sf_dir)
    told = sql_input(spark, sf_dir, _TOLD).withColumn("sources", F.when(F.col("ord") % 31 != 0, F.array(F.lit("r"))))
    return checks.checked_relations(told, e, checks.checked_entities(e, sql_input(spark, sf_dir, _KEYS))[0])[1]
