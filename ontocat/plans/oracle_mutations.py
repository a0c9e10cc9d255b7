"""DuckDB SQL oracles of the mutation queries: the same set algebra over command rows."""

from __future__ import annotations

from ontocat.functions.scalars import VOCAB_PREFIXES
from ontocat.model import DEFAULT_NAMESPACES, USER_NS
from ontocat.plans.registry import EXPORT_BASE


def mint_sql(x: str) -> str:
    e = f"url_encode({x})"
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"('{USER_NS}' || {e})"


def expand_sql(col: str) -> str:
    arms = " ".join(
        f"WHEN '{p}' THEN '{iri}' || substr({col}, {len(p) + 2})" for p, iri in sorted(DEFAULT_NAMESPACES.items())
    )
    return f"(CASE WHEN strpos({col}, ':') > 0 THEN CASE split_part({col}, ':', 1) {arms} END END)"


def store_sql(full: str) -> str:
    ordered = sorted(((p, i) for p, i in DEFAULT_NAMESPACES.items() if p in VOCAB_PREFIXES),
                     key=lambda kv: (-len(kv[1]), kv[0]))
    arms = " ".join(f"WHEN starts_with({full}, '{iri}') THEN '{p}:' || substr({full}, {len(iri) + 1})"
                    for p, iri in ordered)
    return f"(CASE {arms} ELSE {full} END)"


SET_UNION = "SELECT s, p, o, o_kind FROM g UNION SELECT s, p, o, o_kind FROM adds"

TABLE_CMDS = """
, cmds AS (
  SELECT s_suppkey * 3 AS seq, concat('t/', s_suppkey) AS uri, concat('main.suppliers.', replace(s_name, '#', '_')) AS name FROM supplier
  UNION ALL SELECT s_suppkey * 3 + 1, concat('ts/', s_nationkey), concat('main.nations.', replace(s_name, '#', '_')) FROM supplier
  UNION ALL SELECT s_suppkey * 3 + 2, NULL, concat('main.', s_nationkey, '.', s_name) FROM supplier)"""

COLUMN_CMDS = """
, cmds AS (
  SELECT p_partkey * 2 AS seq, concat('c/', p_partkey) AS uri, concat('main.parts.', replace(p_brand, '#', '_'), '.p', p_partkey) AS name FROM part
  UNION ALL SELECT p_partkey * 2 + 1, NULL, concat('main.parts.', p_brand, '.', p_name) FROM part)"""


def register_sql(cls: str) -> str:
    return f"""
, c2 AS (SELECT seq, coalesce(nullif(uri, ''), {mint_sql('name')}) AS uri, name FROM cmds)
, firsts AS (SELECT uri, arg_min(name, seq) AS name FROM c2 GROUP BY uri)
, fresh AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (
    SELECT 1 FROM g WHERE g.s = f.uri AND g.p = 'rdf:type' AND g.o = '{cls}' AND g.o_kind = 'iri'))
, adds AS (SELECT uri AS s, 'rdf:type' AS p, '{cls}' AS o, 'iri' AS o_kind FROM fresh
           UNION ALL SELECT uri, 'uc:name', name, 'lit' FROM fresh)
{SET_UNION}"""


INVENTORY = f"""
, inv AS (
  SELECT 'main' AS catalog, lower(c_mktsegment) AS schema, replace(c_name, '#', '_') AS tbl, CAST(NULL AS VARCHAR) AS col FROM customer
  UNION ALL SELECT 'main', lower(c_mktsegment), replace(c_name, '#', '_'), concat('o', o_orderkey)
  FROM orders JOIN customer ON o_custkey = c_custkey)
, tn AS (SELECT DISTINCT concat_ws('.', catalog, schema, tbl) AS name FROM inv)
, tf AS (SELECT {mint_sql('name')} AS uri, name FROM tn)
, tfresh AS (SELECT * FROM tf WHERE uri NOT IN (SELECT s FROM g WHERE p = 'rdf:type' AND o = 'uc:Table' AND o_kind = 'iri'))
, g1 AS (SELECT s, p, o, o_kind FROM g
         UNION SELECT uri, 'rdf:type', 'uc:Table', 'iri' FROM tfresh
         UNION SELECT uri, 'uc:name', name, 'lit' FROM tfresh)
, cn AS (SELECT DISTINCT concat_ws('.', catalog, schema, tbl, col) AS name FROM inv WHERE col IS NOT NULL)
, cf AS (SELECT {mint_sql('name')} AS uri, name FROM cn)
, cfresh AS (SELECT * FROM cf WHERE uri NOT IN (SELECT s FROM g1 WHERE p = 'rdf:type' AND o = 'uc:Column' AND o_kind = 'iri'))
SELECT s, p, o, o_kind FROM g1
UNION SELECT uri, 'rdf:type', 'uc:Column', 'iri' FROM cfresh
UNION SELECT uri, 'uc:name', name, 'lit' FROM cfresh"""

CONCEPT_INSERT_CMDS = """
, cmds AS (
  SELECT CAST(n_nationkey AS BIGINT) AS seq, CASE WHEN n_regionkey = 3 THEN NULL ELSE concat('n/', n_nationkey) END AS uri,
         concat('Nation ', n_name) AS label,
         CASE WHEN n_nationkey % 2 = 0 THEN 'rdfs_class' WHEN n_nationkey % 3 = 0 THEN 'skos_concept' ELSE 'bogus' END AS type,
         CASE WHEN n_regionkey = 0 THEN '' ELSE concat('from ', n_name) END AS comment,
         CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN CAST([] AS VARCHAR[])
              ELSE [lower(n_name), concat('x ', n_name)] END AS alt_labels
  FROM nation
  UNION ALL SELECT p_partkey + 100, concat('ty/', p_type), p_type, 'skos_concept', '', [p_brand] FROM part)"""

INSERT_CONCEPTS = CONCEPT_INSERT_CMDS + f"""
, ok AS (SELECT coalesce(nullif(uri, ''), {mint_sql('label')}) AS uri, label,
                CASE type WHEN 'rdfs_class' THEN 'rdfs:Class' ELSE 'skos:Concept' END AS type_iri, comment, alt_labels
         FROM cmds WHERE type IN ('rdfs_class', 'skos_concept'))
, adds AS (SELECT uri AS s, 'rdf:type' AS p, type_iri AS o, 'iri' AS o_kind FROM ok
   UNION ALL SELECT uri, 'rdfs:label', label, 'lit' FROM ok
   UNION ALL SELECT uri, 'rdfs:comment', comment, 'lit' FROM ok WHERE coalesce(comment, '') <> ''
   UNION ALL SELECT uri, 'skos:altLabel', unnest(alt_labels), 'lit' FROM ok)
{SET_UNION}"""

INSERT_CONCEPTS_REJECTED = CONCEPT_INSERT_CMDS + """
SELECT seq, uri, label, type FROM cmds WHERE type NOT IN ('rdfs_class', 'skos_concept')"""

INSERT_PROPERTIES = f"""
, cmds AS (
  SELECT CAST(r_regionkey AS BIGINT) AS seq, CASE WHEN r_regionkey = 0 THEN NULL ELSE concat('pr/', r_regionkey) END AS uri,
         concat(r_name, ' property') AS label, concat('r/', r_regionkey) AS domain,
         CASE WHEN r_regionkey = 2 THEN 'xsd:string' WHEN r_regionkey % 2 = 0 THEN concat('n/', r_regionkey) ELSE '' END AS range, [lower(r_name)] AS alt_labels
  FROM region
  UNION ALL SELECT s_suppkey + 100, concat('sp/', s_nationkey), concat('Supplier ', s_nationkey), concat('n/', s_nationkey),
         NULL, [s_name] FROM supplier)
, ok AS (SELECT coalesce(nullif(uri, ''), {mint_sql('label')}) AS uri, label, domain, range, alt_labels FROM cmds)
, adds AS (SELECT uri AS s, 'rdf:type' AS p, 'rdf:Property' AS o, 'iri' AS o_kind FROM ok
   UNION ALL SELECT uri, 'rdfs:label', label, 'lit' FROM ok
   UNION ALL SELECT uri, 'rdfs:domain', domain, 'iri' FROM ok WHERE coalesce(domain, '') <> ''
   UNION ALL SELECT uri, 'rdfs:range', range, 'iri' FROM ok WHERE coalesce(range, '') <> ''
   UNION ALL SELECT uri, 'skos:altLabel', unnest(alt_labels), 'lit' FROM ok)
{SET_UNION}"""

REMOVE_SP = """
SELECT s, p, o, o_kind FROM g WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.s = g.s AND rm.p = g.p)
UNION SELECT s, p, o, o_kind FROM adds"""

UPDATE_CONCEPTS = """
, cmds AS (
  SELECT CAST(n_nationkey * 2 AS BIGINT) AS seq, concat('n/', n_nationkey) AS uri, upper(n_name) AS label,
         concat('c1 ', n_name) AS comment, CAST(NULL AS VARCHAR[]) AS alt_labels FROM nation
  UNION ALL SELECT n_nationkey * 2 + 1, concat('n/', n_nationkey % 10), concat('L2 ', n_name),
         CASE WHEN n_regionkey IN (0, 1) THEN '' ELSE concat('c2 ', n_name) END,
         CASE WHEN n_regionkey = 2 THEN CAST([] AS VARCHAR[]) WHEN n_regionkey = 3 THEN [concat('a2 ', n_name)] ELSE NULL END
  FROM nation
  UNION ALL SELECT c_custkey + 100, concat('n/', c_nationkey), concat('L ', c_name),
         CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('C ', c_name) END,
         CASE WHEN c_custkey % 3 = 0 THEN [concat('ca ', c_name)] ELSE NULL END FROM customer)
, per AS (
  SELECT uri, arg_max_null(label, seq) AS label,
         arg_max(comment, seq) FILTER (WHERE coalesce(comment, '') <> '') AS comment,
         arg_max(alt_labels, seq) FILTER (WHERE alt_labels IS NOT NULL) AS alt_labels,
         bool_or(alt_labels IS NOT NULL) AS set_alts
  FROM cmds GROUP BY uri)
, rm AS (SELECT uri AS s, 'rdfs:label' AS p FROM per
   UNION ALL SELECT uri, 'rdfs:comment' FROM per WHERE comment IS NOT NULL
   UNION ALL SELECT uri, 'skos:altLabel' FROM per WHERE set_alts)
, adds AS (SELECT uri AS s, 'rdfs:label' AS p, label AS o, 'lit' AS o_kind FROM per
   UNION ALL SELECT uri, 'rdfs:comment', comment, 'lit' FROM per WHERE comment IS NOT NULL
   UNION ALL SELECT uri, 'skos:altLabel', unnest(alt_labels), 'lit' FROM per WHERE set_alts)
""" + REMOVE_SP

UPDATE_PROPERTIES = """
, cmds AS (
  SELECT CAST(r_regionkey AS BIGINT) AS seq, concat('pr/', r_regionkey + 1) AS uri, concat('P ', r_name) AS label,
         concat('pc ', r_name) AS comment, concat('r/', r_regionkey) AS domain, ' ' AS range,
         CAST(NULL AS VARCHAR[]) AS alt_labels FROM region
  UNION ALL SELECT o_orderkey + 100, concat('pr/', left(o_orderpriority, 1)), concat('P ', o_orderkey),
         CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE concat('pc ', o_orderkey) END,
         concat('r/', o_orderkey % 5),
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('n/', o_orderkey % 25) END,
         CASE WHEN o_orderkey % 4 = 0 THEN [concat('pa ', o_orderkey)] ELSE NULL END FROM orders)
, c2 AS (SELECT seq, uri, label, alt_labels,
                nullif(trim(comment), '') AS comment,
                nullif(trim(domain), '') AS domain,
                nullif(trim(range), '') AS range FROM cmds)
, per AS (
  SELECT uri, arg_max_null(label, seq) AS label, arg_max_null(comment, seq) AS comment,
         arg_max_null(domain, seq) AS domain, arg_max_null(range, seq) AS range,
         arg_max(alt_labels, seq) FILTER (WHERE alt_labels IS NOT NULL) AS alt_labels,
         bool_or(alt_labels IS NOT NULL) AS set_alts
  FROM c2 GROUP BY uri)
, rm AS (SELECT uri AS s, unnest(['rdfs:label', 'rdfs:comment', 'rdfs:domain', 'rdfs:range']) AS p FROM per
   UNION ALL SELECT uri, 'skos:altLabel' FROM per WHERE set_alts)
, adds AS (SELECT uri AS s, 'rdfs:label' AS p, label AS o, 'lit' AS o_kind FROM per
   UNION ALL SELECT uri, 'rdfs:comment', comment, 'lit' FROM per WHERE comment IS NOT NULL
   UNION ALL SELECT uri, 'rdfs:domain', domain, 'iri' FROM per WHERE domain IS NOT NULL
   UNION ALL SELECT uri, 'rdfs:range', range, 'iri' FROM per WHERE range IS NOT NULL
   UNION ALL SELECT uri, 'skos:altLabel', unnest(alt_labels), 'lit' FROM per WHERE set_alts)
""" + REMOVE_SP

REL_ADD_CMDS = f"""
, cmds AS (
  SELECT CAST(n_nationkey AS BIGINT) AS seq, concat('n/', n_nationkey) AS subject_uri,
         CASE WHEN n_nationkey % 4 = 0 THEN 'skos:broader' WHEN n_nationkey % 4 = 1 THEN 'rdfs:subClassOf'
              WHEN n_nationkey % 4 = 2 THEN 'user:relatedTo' ELSE 'bad:thing' END AS predicate_type,
         CASE WHEN n_regionkey = 4 THEN NULL WHEN n_regionkey = 3 THEN 'http://www.w3.org/2002/07/owl#Thing'
              ELSE concat('r/', (n_nationkey + 1) % 5) END AS object_uri FROM nation
  UNION ALL SELECT p_partkey + 100, concat('ty/', p_type), 'skos:related', concat('b/', replace(p_brand, '#', '')) FROM part)
, res AS (SELECT *, {expand_sql('predicate_type')} AS full_p FROM cmds)
, good AS (SELECT * FROM res WHERE coalesce(subject_uri, '') <> '' AND coalesce(predicate_type, '') <> ''
           AND coalesce(object_uri, '') <> '' AND full_p IS NOT NULL)"""

ADD_RELATIONSHIPS = REL_ADD_CMDS + f"""
, adds AS (SELECT subject_uri AS s, {store_sql('full_p')} AS p, {store_sql('object_uri')} AS o, 'iri' AS o_kind FROM good)
{SET_UNION}"""

ADD_RELATIONSHIPS_REJECTED = REL_ADD_CMDS + """
SELECT seq, subject_uri, predicate_type, object_uri FROM res
WHERE seq NOT IN (SELECT seq FROM good)"""

DELETE_RELATIONSHIPS = f"""
, cmds AS (
  SELECT concat('n/', n_nationkey) AS subject_uri, 'rdfs:subClassOf' AS predicate_type, concat('r/', n_regionkey) AS object_uri FROM nation
  UNION ALL SELECT concat('n/', n_nationkey), 'skos:broader', concat('r/', n_regionkey) FROM nation
  UNION ALL SELECT concat('ty/', p_type), 'skos:narrower', concat('b/', replace(p_brand, '#', '')) FROM part WHERE p_size > 25)
, rm AS (SELECT subject_uri AS s, {store_sql(expand_sql('predicate_type'))} AS p, object_uri AS o FROM cmds
         WHERE {expand_sql('predicate_type')} IS NOT NULL)
SELECT s, p, o, o_kind FROM g
WHERE NOT EXISTS (SELECT 1 FROM rm WHERE rm.s = g.s AND rm.p = g.p AND rm.o = g.o AND g.o_kind = 'iri')"""

DELETE_RELATIONSHIPS_REJECTED = """
SELECT CAST(n_nationkey + 1000000000 AS BIGINT) AS seq, concat('n/', n_nationkey) AS subject_uri,
       CASE WHEN n_nationkey % 4 = 1 THEN 'bad:thing' ELSE 'rdfs:subClassOf' END AS predicate_type,
       CASE WHEN n_nationkey % 4 = 1 THEN concat('r/', n_nationkey) ELSE '' END AS object_uri
FROM nation WHERE n_nationkey % 6 = 5"""

ASSIGN_CONCEPTS = f"""
, adds AS (
  SELECT concat('t/', c_custkey) AS s, 'uc:conceptAssignment' AS p, concat('r/', c_nationkey % 5) AS o, 'iri' AS o_kind FROM customer
  UNION ALL SELECT concat('t/', c_custkey), 'uc:conceptAssignment', concat('n/', c_nationkey), 'iri' FROM customer)
{SET_UNION}"""

ASSIGN_PROPERTIES = f"""
, adds AS (SELECT concat('c/', o_orderkey) AS s, 'uc:propertyAssignment' AS p, concat('pr/', o_orderkey % 5 + 1) AS o,
                  'iri' AS o_kind FROM orders)
{SET_UNION}"""

DELETE_OBJECTS = """
, rm AS (SELECT concat('n/', n_nationkey) AS s FROM nation WHERE n_regionkey = 0
         UNION ALL SELECT concat('t/', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT s, p, o, o_kind FROM g WHERE s NOT IN (SELECT s FROM rm)"""

COMMAND_LOG = """
, cu AS (SELECT c_custkey AS k, c_custkey * 16 AS q, concat('t/', c_custkey) AS t, concat('mc/', c_nationkey) AS m, concat('r/', c_custkey % 5) AS r
         FROM customer)
, ins AS (
  SELECT q AS seq, t AS s, 'uc:conceptAssignment' AS p, r AS o, 'iri' AS o_kind FROM cu
  UNION ALL SELECT q + 1, t, 'rdf:type', 'uc:Table', 'iri' FROM cu
  UNION ALL SELECT q + 1, t, 'uc:name', concat('again ', k), 'lit' FROM cu
            WHERE t NOT IN (SELECT s FROM g WHERE p = 'rdf:type' AND o = 'uc:Table' AND o_kind = 'iri')
  UNION ALL SELECT q + 3, t, 'rdf:type', 'uc:Table', 'iri' FROM cu
  UNION ALL SELECT q + 3, t, 'uc:name', concat('anew ', k), 'lit' FROM cu WHERE k % 3 = 0
  UNION ALL SELECT q + 4, m, unnest(['rdf:type', 'rdfs:label', 'rdfs:comment', 'skos:altLabel']),
                   unnest(['skos:Concept', concat('L', k), concat('C', k % 3), concat('A', k % 4)]), unnest(['iri', 'lit', 'lit', 'lit']) FROM cu
  UNION ALL SELECT q + 5, m, 'rdfs:label', concat('U', k), 'lit' FROM cu WHERE k % 7 = 0
  UNION ALL SELECT q + 5, m, 'skos:altLabel', concat('B', k), 'lit' FROM cu WHERE k % 14 = 0
  UNION ALL SELECT q + 6, m, 'skos:broader', r, 'iri' FROM cu
  UNION ALL SELECT q + 8, t, 'uc:conceptAssignment', m, 'iri' FROM cu)
, res AS (SELECT q + 5 AS seq, m AS s, 'rdfs:label' AS p FROM cu WHERE k % 7 = 0
          UNION ALL SELECT q + 5, m, 'skos:altLabel' FROM cu WHERE k % 14 = 0)
, rs AS (SELECT s, p, max(seq) AS x FROM res GROUP BY s, p)
, dr AS (SELECT t AS s, max(q + 2) AS x FROM cu WHERE k % 3 = 0 GROUP BY t)
, de AS (SELECT m AS s, 'skos:broader' AS p, concat('r/', (k + 2) % 5) AS o, 'iri' AS o_kind, max(q + 7) AS x FROM cu WHERE k % 2 = 0 GROUP BY ALL)
, last AS (SELECT s, p, o, o_kind, max(seq) AS a FROM (SELECT seq, s, p, o, o_kind FROM ins UNION ALL SELECT -1, s, p, o, o_kind FROM g) GROUP BY ALL)
SELECT last.s, last.p, last.o, last.o_kind FROM last
LEFT JOIN rs ON rs.s = last.s AND rs.p = last.p LEFT JOIN dr ON dr.s = last.s
LEFT JOIN de ON de.s = last.s AND de.p = last.p AND de.o = last.o AND de.o_kind = last.o_kind
WHERE a >= greatest(coalesce(rs.x, -1), coalesce(dr.x, -1), coalesce(de.x, -1))"""

COMMAND_LOG_REJECTED = """
SELECT c_custkey * 16 + 2 AS seq, 'delete-objects' AS kind FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey * 16 + 5, 'update-concepts' FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey * 16 + 7, 'delete-relationships' FROM customer WHERE c_custkey % 2 <> 0
UNION ALL SELECT c_custkey * 16 + 9, 'add-relationships' FROM customer
UNION ALL SELECT c_custkey * 16 + 10, 'compact' FROM customer"""

MUTATION_BODIES = {
    "command_log": COMMAND_LOG,
    "command_log_rejected": "SELECT CAST(seq AS BIGINT) AS seq, kind FROM (" + COMMAND_LOG_REJECTED + ")",
    "upsert_tables": TABLE_CMDS + register_sql("uc:Table"),
    "upsert_columns": COLUMN_CMDS + register_sql("uc:Column"),
    "register_inventory": INVENTORY,
    "insert_concepts": INSERT_CONCEPTS,
    "insert_concepts_rejected": INSERT_CONCEPTS_REJECTED,
    "insert_properties": INSERT_PROPERTIES,
    "update_concepts": UPDATE_CONCEPTS,
    "update_properties": UPDATE_PROPERTIES,
    "add_relationships": ADD_RELATIONSHIPS,
    "add_relationships_rejected": ADD_RELATIONSHIPS_REJECTED,
    "delete_relationships": DELETE_RELATIONSHIPS,
    "delete_relationships_rejected": DELETE_RELATIONSHIPS_REJECTED,
    "assign_concepts": ASSIGN_CONCEPTS,
    "assign_properties": ASSIGN_PROPERTIES,
    "delete_objects": DELETE_OBJECTS,
}


# ------------------------------------------------------------ import / export

_SUP = "http://example.com/ontology/supplier/"
_VOCAB_LIST = ", ".join(f"'{p}'" for p in VOCAB_PREFIXES)


def export_term_sql(t: str) -> str:
    return f"(CASE WHEN strpos({t}, ':') > 0 AND split_part({t}, ':', 1) IN ({_VOCAB_LIST}) THEN {expand_sql(t)} ELSE {t} END)"


def compact_all_sql(x: str) -> str:
    ordered = sorted(DEFAULT_NAMESPACES.items(), key=lambda kv: (-len(kv[1]), kv[0]))
    arms = " ".join(f"WHEN starts_with({x}, '{iri}') THEN '{p}:' || substr({x}, {len(iri) + 1})" for p, iri in ordered)
    return f"(CASE {arms} END)"


PARSED = f"""
, parsed AS (
  SELECT concat('{_SUP}', s_suppkey) AS s, 'rdf:type' AS p, 'uc:Table' AS o, 'iri' AS o_kind,
         CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM supplier
  UNION ALL SELECT concat('{_SUP}', s_suppkey), 'uc:name', concat('main.suppliers.', s_name), 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT concat('{_SUP}', s_suppkey), '{USER_NS}nation', CAST(s_nationkey AS VARCHAR), 'lit', 'xsd:integer', NULL
            FROM supplier
  UNION ALL SELECT concat('{_SUP}', s_suppkey), 'rdfs:label', concat('Supplier "', s_suppkey, '"', chr(10), 'line'), 'lit',
            NULL, 'en' FROM supplier
  UNION ALL SELECT concat('_:imp_s', s_suppkey), 'rdfs:comment', concat('bnode of ', s_suppkey), 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT concat('t/', s_suppkey), 'rdf:type', 'uc:Table', 'iri', NULL, NULL FROM supplier
  UNION ALL SELECT concat('{_SUP}', s_suppkey), '{USER_NS}since', concat(1990 + s_nationkey, '-01-0', 1 + s_nationkey % 9),
            'lit', 'xsd:date', NULL FROM supplier
  UNION ALL SELECT concat('{_SUP}', s_suppkey), '{USER_NS}active', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END,
            'lit', 'xsd:boolean', NULL FROM supplier
  UNION ALL SELECT concat('http://example.com/ontology/document/', doc_id), 'rdfs:comment', text, 'lit', NULL, NULL
            FROM documents WHERE text IS NOT NULL)
, gfull AS (SELECT s, p, o, o_kind, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM g)
, added AS (SELECT DISTINCT * FROM parsed EXCEPT SELECT * FROM gfull)"""

IMPORT_MERGE = PARSED + "\nSELECT * FROM added"

IMPORT_MERGED_GRAPH = PARSED + "\nSELECT * FROM gfull UNION SELECT * FROM added"

IMPORT_REJECTS = "SELECT concat('supplier ', s_suppkey, ' is not a triple') AS value FROM supplier"

_TTL = "http://example.com/ontology/supplier/"
_TTL_NS = "CASE WHEN s_suppkey > 5 THEN 'http://example.com/ontology/other/' ELSE 'http://example.com/ontology/' END"
IMPORT_TURTLE = f"""
, parsed AS (
  SELECT concat('{_TTL}', s_suppkey) AS s, 'rdf:type' AS p, 'uc:Table' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype,
         CAST(NULL AS VARCHAR) AS o_lang FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), 'rdf:type', concat('http://example.com/ontology/class/', s_nationkey), 'iri', NULL, NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), 'uc:name', concat('main.suppliers.', s_name), 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), 'rdfs:label', concat('Supplier "', s_suppkey, '"', chr(10), 'line'), 'lit', NULL, 'en' FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), 'rdfs:label', 'x.y; "z"', 'lit', NULL, 'en-gb' FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), concat({_TTL_NS}, 'nation'), CAST(s_nationkey AS VARCHAR), 'lit', 'xsd:integer', NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), concat({_TTL_NS}, 'balance'), concat(s_nationkey, '.5'), 'lit', 'xsd:decimal', NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), concat({_TTL_NS}, 'active'), CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, 'lit',
            'xsd:boolean', NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), concat({_TTL_NS}, 'since'), concat(1990 + s_nationkey, '-01-0', 1 + s_nationkey % 9), 'lit',
            'xsd:date', NULL FROM supplier
  UNION ALL SELECT concat('{_TTL}', s_suppkey), 'rdfs:seeAlso', '_:', 'bnode', NULL, NULL FROM supplier
  UNION ALL SELECT '_:', 'rdfs:comment', concat('bnode', chr(10), 'of ', s_suppkey), 'lit', NULL, NULL FROM supplier
  UNION ALL SELECT concat('http://example.com/ontology/document/', doc_id), 'rdfs:comment', text, 'lit', NULL, NULL FROM documents
            WHERE text IS NOT NULL)
, gfull AS (SELECT s, p, o, o_kind, CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM g)
SELECT DISTINCT * FROM parsed EXCEPT SELECT * FROM gfull"""

IMPORT_TURTLE_REJECTS = """
SELECT concat('<supplier/', s_suppkey, '> rdfs:comment nosuch:k .') AS value FROM supplier
UNION ALL SELECT concat('supplier ', s_suppkey, ' is not a triple .') FROM supplier"""

_INT_TYPES = ", ".join(f"'{t}'" for t in (
    "xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte", "xsd:nonNegativeInteger", "xsd:positiveInteger",
    "xsd:negativeInteger", "xsd:nonPositiveInteger", "xsd:unsignedInt", "xsd:unsignedLong", "xsd:unsignedShort",
    "xsd:unsignedByte"))

LITERAL_DECODE = PARSED + f"""
SELECT s, p, o, o_kind, o_datatype,
       CASE WHEN o_datatype IN ({_INT_TYPES}) THEN TRY_CAST(o AS BIGINT) END AS value_long,
       CASE WHEN o_datatype IN ('xsd:decimal', 'xsd:double', 'xsd:float') THEN TRY_CAST(o AS DOUBLE) END AS value_double,
       CASE WHEN o_datatype = 'xsd:boolean' THEN CASE WHEN o IN ('true', '1') THEN true WHEN o IN ('false', '0') THEN false END
       END AS value_boolean,
       CASE WHEN o_datatype = 'xsd:date' THEN TRY_CAST(o AS DATE) END AS value_date,
       CASE WHEN o_datatype = 'xsd:dateTime' THEN TRY_CAST(o AS TIMESTAMP) END AS value_timestamp,
       CASE WHEN o_datatype IS NULL OR o_datatype = 'xsd:string' THEN o END AS value_string
FROM (SELECT s, p, o, o_kind, o_datatype, o_lang FROM gfull UNION SELECT * FROM added) m"""

def escape_iri_sql(x: str) -> str:
    """SQL form of :func:`ontocat.sources.ntriples.escape_iri` (backslash first)."""
    from ontocat.sources.ntriples import IRI_FORBIDDEN

    e = x
    for ch in IRI_FORBIDDEN:
        lit = ch.replace("'", "''")
        e = f"replace({e}, '{lit}', '\\u{ord(ch):04X}')"
    return e


EXPORT_TRIPLES = f"""
SELECT concat_ws(' ',
  CASE WHEN starts_with(s, '_:') THEN s ELSE '<' || {escape_iri_sql(export_term_sql('s'))} || '>' END,
  '<' || {escape_iri_sql(export_term_sql('p'))} || '>',
  CASE o_kind WHEN 'lit' THEN '"' || replace(replace(replace(replace(o, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') || '"'
              WHEN 'bnode' THEN o ELSE '<' || {escape_iri_sql(export_term_sql('o'))} || '>' END,
  '.') AS value
FROM g"""



def _based(term: str, is_iri: str) -> str:
    return f"CASE WHEN {is_iri} AND NOT regexp_matches({term}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN '{EXPORT_BASE}' || {term} ELSE {term} END"


EXPORT_TURTLE = f"""
SELECT {_based('s', "NOT starts_with(s, '_:')")} AS s, {_based('p', 'true')} AS p, {_based('o', "o_kind = 'iri'")} AS o, o_kind,
       CAST(NULL AS VARCHAR) AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang
FROM g"""

SCALAR_NAMES = """
, names AS (
  SELECT concat(c_name, ' ', lower(c_mktsegment), '/x~y*z+w%v?u=t&s#r''q(p)o!n é') AS name, 'main' AS catalog,
         lower(c_mktsegment) AS schema,
         CASE WHEN c_acctbal < 0 THEN '' ELSE concat(c_name, ' (', c_nationkey, ')!*''~') END AS tbl
  FROM customer)"""


def _uri_component_sql(x: str) -> str:
    e = f"url_encode({x})"
    for enc, ch in (("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = f"replace({e}, '{enc}', '{ch}')"
    return e


GRAPH_IRIS = f"""
, iris AS (SELECT DISTINCT {export_term_sql('t')} AS iri FROM (
    SELECT s AS t FROM g WHERE NOT starts_with(s, '_:') UNION SELECT p FROM g UNION SELECT o FROM g WHERE o_kind = 'iri'))"""

NAMESPACE_TABLE = f"""
, binds AS (
    SELECT DISTINCT prefix, iri FROM (VALUES {', '.join(f"('{p}', '{iri}')" for p, iri in sorted(DEFAULT_NAMESPACES.items()))}) v(prefix, iri)
    UNION SELECT concat('s', s_suppkey), concat('t/', s_suppkey) FROM supplier
    UNION SELECT p_brand, concat('ty/', p_type) FROM part)
, prefixes AS (SELECT prefix, count(*) AS n FROM binds GROUP BY prefix)"""

SCALAR_BODIES = {
    "namespace_names": GRAPH_IRIS + NAMESPACE_TABLE + """
, valid AS (SELECT b.prefix, b.iri AS ns FROM binds b JOIN prefixes p ON p.prefix = b.prefix AND p.n = 1)
, longest AS (SELECT i.iri, max(length(v.ns)) AS n FROM iris i JOIN valid v ON starts_with(i.iri, v.ns) GROUP BY i.iri)
, named AS (SELECT l.iri, min(v.prefix) || ':' || substr(l.iri, any_value(l.n) + 1) AS qname
            FROM longest l JOIN valid v ON v.ns = left(l.iri, l.n) GROUP BY l.iri)
SELECT i.iri, n.qname, CASE WHEN n.qname IS NOT NULL THEN i.iri END AS expanded FROM iris i LEFT JOIN named n ON n.iri = i.iri""",
    "namespace_conflicts": NAMESPACE_TABLE + """
SELECT b.prefix, b.iri FROM binds b JOIN prefixes p ON p.prefix = b.prefix AND p.n > 1""",
    "import_merge": IMPORT_MERGE,
    "import_merged_graph": IMPORT_MERGED_GRAPH,
    "import_rejects": IMPORT_REJECTS,
    "import_turtle": IMPORT_TURTLE,
    "import_turtle_rejects": IMPORT_TURTLE_REJECTS,
    "export_triples": EXPORT_TRIPLES,
    "export_turtle": EXPORT_TURTLE,
    "literal_decode": LITERAL_DECODE,
    "mint_iri": SCALAR_NAMES + f"\nSELECT name, {mint_sql('name')} AS iri FROM names",
    "mint_iri_parts": SCALAR_NAMES + f"""
SELECT catalog, schema, tbl,
       CASE WHEN coalesce(catalog, '') <> '' AND coalesce(schema, '') <> '' AND coalesce(tbl, '') <> ''
            THEN '{USER_NS}' || {_uri_component_sql("concat_ws('.', catalog, schema, tbl)")} END AS iri
FROM names""",
    "qualified_names": """
SELECT concat_ws('.', 'main', lower(c_mktsegment), replace(c_name, '#', '_')) AS table_name, CAST(NULL AS VARCHAR) AS column_name
FROM customer
UNION ALL
SELECT concat_ws('.', 'main', lower(c_mktsegment), replace(c_name, '#', '_')),
       concat_ws('.', 'main', lower(c_mktsegment), replace(c_name, '#', '_'), concat('o', o_orderkey))
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "local_name": GRAPH_IRIS + "\nSELECT iri, split_part(split_part(iri, '/', -1), '#', -1) AS local_name FROM iris",
    "predicate_qname": GRAPH_IRIS + f"\nSELECT iri, {compact_all_sql('iri')} AS qname FROM iris",
    "expand_curie": REL_ADD_CMDS + f"""
, curies AS (SELECT p AS curie FROM g UNION SELECT predicate_type FROM cmds)
SELECT curie, {expand_sql('curie')} AS iri FROM curies""",
    "entity_by_uri": """
SELECT t.s AS uri, n.o AS name
FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
WHERE t.p = 'rdf:type' AND t.o = 'uc:Table' AND t.o_kind = 'iri'
  AND t.s IN (SELECT concat('t/', c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY')""",
}
MUTATION_BODIES.update(SCALAR_BODIES)
