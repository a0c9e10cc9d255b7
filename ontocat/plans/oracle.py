"""DuckDB SQL oracles for the registered queries.

Each entry is a complete SQL text over the driver's tables (registered as
views). It rebuilds the derived graph and current tags with the definitions of
FIXTURES.md, then restates the operator in plain SQL. Column names equal the
Spark query's.
"""

from __future__ import annotations

from ontocat.plans.registry import LIST_FILTERS, SEARCH_KINDS, SEARCH_QUERIES

GRAPH_CTE = """
g AS (
  SELECT DISTINCT s, p, o, k AS o_kind FROM (
    SELECT concat('r/', r_regionkey) AS s, 'rdf:type' AS p, 'rdfs:Class' AS o, 'iri' AS k FROM region
    UNION ALL SELECT concat('r/', r_regionkey), 'rdfs:label', r_name, 'lit' FROM region
    UNION ALL SELECT concat('n/', n_nationkey), 'rdfs:subClassOf', CASE WHEN n_nationkey % 11 = 10 THEN 'gone/1' ELSE concat('r/', n_regionkey) END, 'iri' FROM nation
    UNION ALL SELECT concat('n/', n_nationkey), 'rdf:type', 'rdfs:Class', 'iri' FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT concat('n/', n_nationkey), 'skos:broader', concat('r/', n_regionkey), 'iri' FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT concat('n/', n_nationkey), 'rdfs:label', n_name, 'lit' FROM nation WHERE n_nationkey % 7 <> 6
    UNION ALL SELECT concat('n/', n_nationkey), 'rdfs:comment', concat('Nation ', n_name), 'lit' FROM nation
    UNION ALL SELECT concat('n/', n_nationkey), 'skos:altLabel', lower(n_name), 'lit' FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT concat('n/', n_nationkey), 'skos:altLabel', concat('alt ', n_name), 'lit' FROM nation WHERE n_nationkey % 10 = 0
    UNION ALL SELECT concat('ty/', p_type), 'rdf:type', 'skos:Concept', 'iri' FROM part
    UNION ALL SELECT concat('ty/', p_type), 'rdfs:label', p_type, 'lit' FROM part
    UNION ALL SELECT concat('ty/', p_type), 'skos:narrower', concat('b/', replace(p_brand, '#', '')), 'iri' FROM part
    UNION ALL SELECT concat('b/', replace(p_brand, '#', '')), 'rdf:type', 'owl:Class', 'iri' FROM part
    UNION ALL SELECT concat('b/', replace(p_brand, '#', '')), 'rdfs:label', p_brand, 'lit' FROM part
    UNION ALL SELECT concat('pr/', left(o_orderpriority, 1)), 'rdf:type', 'rdf:Property', 'iri' FROM orders
    UNION ALL SELECT concat('pr/', left(o_orderpriority, 1)), 'rdfs:label', o_orderpriority, 'lit' FROM orders
    UNION ALL SELECT concat('pr/', left(o_orderpriority, 1)), 'skos:altLabel', lower(o_orderpriority), 'lit' FROM orders WHERE left(o_orderpriority, 1) <> '5'
    UNION ALL SELECT concat('pr/', left(o_orderpriority, 1)), 'rdfs:domain', CASE WHEN left(o_orderpriority, 1) = '5' THEN 'n/6' ELSE concat('r/', left(o_orderpriority, 1)) END, 'iri' FROM orders
    UNION ALL SELECT concat('pr/', left(o_orderpriority, 1)), 'rdfs:range', concat('n/', left(o_orderpriority, 1)), 'iri' FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2')
    UNION ALL SELECT concat('t/', c_custkey), 'rdf:type', 'uc:Table', 'iri' FROM customer
    UNION ALL SELECT concat('t/', c_custkey), 'uc:name', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_')), 'lit' FROM customer WHERE c_custkey % 50 <> 49
    UNION ALL SELECT concat('t/', c_custkey), 'uc:conceptAssignment', concat('n/', c_nationkey), 'iri' FROM customer
    UNION ALL SELECT concat('t/', c_custkey), 'uc:conceptAssignment', 'ty/PROMO', 'iri' FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT concat('t/', c_custkey), 'uc:conceptAssignment', 'gone/2', 'iri' FROM customer WHERE c_custkey % 97 = 0
    UNION ALL SELECT concat('c/', o_orderkey), 'rdf:type', 'uc:Column', 'iri' FROM orders WHERE o_orderkey % 13 <> 12
    UNION ALL SELECT concat('c/', o_orderkey), 'uc:name', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_'), '.o', o_orderkey), 'lit' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 29 <> 28
    UNION ALL SELECT concat('c/', o_orderkey), 'uc:propertyAssignment', concat('pr/', left(o_orderpriority, 1)), 'iri' FROM orders
    UNION ALL SELECT concat('pt/', p_partkey), 'rdf:type', 'skos:Concept', 'iri' FROM part
    UNION ALL SELECT concat('pt/', p_partkey), 'rdfs:label', p_name, 'lit' FROM part WHERE p_partkey % 17 <> 16
    UNION ALL SELECT concat('pt/', p_partkey), 'skos:broader', concat('ty/', p_type), 'iri' FROM part
    UNION ALL SELECT concat('pt/', p_partkey), 'skos:altLabel', concat(p_name, ' ', p_brand), 'lit' FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT concat('sp/', s_suppkey), 'rdf:type', 'rdf:Property', 'iri' FROM supplier
    UNION ALL SELECT concat('sp/', s_suppkey), 'rdfs:label', s_name, 'lit' FROM supplier
    UNION ALL SELECT concat('sp/', s_suppkey), 'rdfs:domain', concat('pt/', s_suppkey), 'iri' FROM supplier
    UNION ALL SELECT concat('sp/', s_suppkey), 'rdfs:range', concat('n/', s_nationkey), 'iri' FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT concat('sp/', s_suppkey), 'skos:altLabel', lower(s_name), 'lit' FROM supplier WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT concat('t/', c_custkey), 'uc:conceptAssignment', 'pt/1', 'iri' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'r/0', 'skos:altLabel', concat('syn ', c_name), 'lit' FROM customer
  ) AS raw_triples
)"""

CURRENT_TAGS_CTE = """
cur AS (
  SELECT DISTINCT entity_type, entity_name, tag_key FROM (
    SELECT 'tables' AS entity_type, concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_')) AS entity_name, concat('TYPE_', n_name) AS tag_key
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    UNION ALL SELECT 'tables', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_')), concat('BRAND_', p_brand)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 'columns', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_'), '.o', o_orderkey), concat('TYPE_', o_orderpriority)
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'columns', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_'), '.o', o_orderkey), 'TYPE_OLD'
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'columns', concat('main.', lower(c_mktsegment), '.', replace(c_name, '#', '_'), '.o', o_orderkey), 'TYPEX'
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0
  ) AS raw_tags
)"""

# Named building blocks, in dependency order. Unreferenced ones are not evaluated.
COMMON_CTES = [
    GRAPH_CTE,
    CURRENT_TAGS_CTE,
    """
lab AS (SELECT s AS uri, o AS label FROM g WHERE p = 'rdfs:label')""",
    """
members_bag AS (
  SELECT s AS uri FROM g WHERE p = 'rdf:type' AND o = 'rdfs:Class' AND o_kind = 'iri'
  UNION ALL SELECT s FROM g WHERE p = 'rdfs:subClassOf'
  UNION ALL SELECT s FROM g WHERE p = 'rdf:type' AND o = 'skos:Concept' AND o_kind = 'iri')""",
    """
members AS (SELECT DISTINCT uri FROM members_bag)""",
    """
props AS (SELECT s AS uri FROM g WHERE p = 'rdf:type' AND o = 'rdf:Property' AND o_kind = 'iri')""",
    """
ta AS (
  SELECT a.s AS table_uri, n.o AS table_name, a.o AS concept_uri, l.o AS concept_name
  FROM g a
  LEFT JOIN g n ON n.p = 'uc:name' AND n.s = a.s
  LEFT JOIN g l ON l.p = 'rdfs:label' AND l.s = a.o
  WHERE a.p = 'uc:conceptAssignment')""",
    """
ca AS (
  SELECT a.s AS column_uri, n.o AS column_name, a.o AS property_uri, l.o AS property_name
  FROM g a
  LEFT JOIN g n ON n.p = 'uc:name' AND n.s = a.s
  LEFT JOIN g l ON l.p = 'rdfs:label' AND l.s = a.o
  WHERE a.p = 'uc:propertyAssignment')""",
    """
pairs AS (
  SELECT 'tables' AS type, table_name AS name, concept_name AS tag FROM ta
  WHERE coalesce(table_name, '') <> '' AND coalesce(concept_name, '') <> ''
  UNION ALL
  SELECT 'columns', column_name, property_name FROM ca
  WHERE coalesce(column_name, '') <> '' AND coalesce(property_name, '') <> '')""",
]


def with_common(body: str) -> str:
    return "WITH" + ",".join(COMMON_CTES) + "\n" + body


def _plan_sql(limit: int, prefix: str = "TYPE_") -> str:
    n = len(prefix)
    return f"""
, new_t AS (SELECT DISTINCT type AS entity_type, name AS entity_name, '{prefix}' || tag AS tag_key FROM pairs)
, ents AS (SELECT DISTINCT entity_type, entity_name FROM new_t)
, old_t AS (
    SELECT DISTINCT c.entity_type, c.entity_name, c.tag_key
    FROM cur c JOIN ents e ON c.entity_type = e.entity_type AND c.entity_name = e.entity_name
    WHERE left(c.tag_key, {n}) = '{prefix}')
, ch AS (
    SELECT entity_type, entity_name, tag_key, 'add' AS action FROM (SELECT * FROM new_t EXCEPT SELECT * FROM old_t) a
    UNION ALL
    SELECT entity_type, entity_name, tag_key, 'delete' AS action FROM (SELECT * FROM old_t EXCEPT SELECT * FROM new_t) d)
, ncur AS (SELECT entity_type, entity_name, count(*) AS n_current FROM cur GROUP BY entity_type, entity_name)
, per AS (
    SELECT e.entity_type, e.entity_name,
           coalesce(max(nc.n_current), 0)
           + count(CASE WHEN ch.action = 'add' THEN 1 END)
           - count(CASE WHEN ch.action = 'delete' THEN 1 END) AS resulting
    FROM ents e
    LEFT JOIN ncur nc ON nc.entity_type = e.entity_type AND nc.entity_name = e.entity_name
    LEFT JOIN ch ON ch.entity_type = e.entity_type AND ch.entity_name = e.entity_name
    GROUP BY e.entity_type, e.entity_name)
SELECT ch.entity_type, ch.entity_name, ch.tag_key, ch.action, per.resulting >= {limit} AS skipped
FROM ch JOIN per ON ch.entity_type = per.entity_type AND ch.entity_name = per.entity_name
"""


def expand_sql(col: str) -> str:
    """SQL form of :func:`ontocat.functions.scalars.expand_curie` for the default namespaces."""
    from ontocat.model import DEFAULT_NAMESPACES

    arms = " ".join(
        f"WHEN '{p}' THEN '{iri}' || substr({col}, {len(p) + 2})" for p, iri in sorted(DEFAULT_NAMESPACES.items())
    )
    return f"CASE WHEN strpos({col}, ':') > 0 THEN CASE split_part({col}, ':', 1) {arms} END END"


TYPE_RANK_SQL = "CASE WHEN o = 'rdfs:Class' THEN '0' WHEN o = 'skos:Concept' THEN '1' ELSE '2' END"

DETAIL_CTES = f"""
, lmin AS (SELECT uri, min(label) AS label FROM lab GROUP BY uri)
, cmin AS (SELECT s AS uri, min(o) AS comment FROM g WHERE p = 'rdfs:comment' GROUP BY s)
, tmin AS (SELECT s AS uri, substr(min({TYPE_RANK_SQL} || o), 2) AS type FROM g WHERE p = 'rdf:type' GROUP BY s)
, alts AS (SELECT s AS uri, count(*) AS n_alt_labels FROM g WHERE p = 'skos:altLabel' GROUP BY s)
, rel AS (
    SELECT r.s AS uri, {{expand}} AS predicate, r.o AS object, l.label AS object_label, r.p AS predicate_type
    FROM g r JOIN members m ON m.uri = r.s LEFT JOIN lab l ON l.uri = r.o
    WHERE r.p IN ('rdfs:subClassOf', 'skos:broader', 'skos:narrower'))
, cprops AS (
    SELECT x.o AS concept, x.s AS uri, n.label AS name, 'domain' AS role
    FROM g x JOIN props pr ON pr.uri = x.s LEFT JOIN lab n ON n.uri = x.s WHERE x.p = 'rdfs:domain'
    UNION ALL
    SELECT x.o, x.s, n.label, 'range'
    FROM g x JOIN props pr ON pr.uri = x.s LEFT JOIN lab n ON n.uri = x.s WHERE x.p = 'rdfs:range')
"""


def _detail_select(base: str) -> str:
    return f"""
SELECT b.uri, lmin.label, cmin.comment, coalesce({expand_sql('tmin.type')}, tmin.type) AS type, coalesce(alts.n_alt_labels, 0) AS n_alt_labels
FROM {base} b LEFT JOIN lmin ON lmin.uri = b.uri LEFT JOIN cmin ON cmin.uri = b.uri
LEFT JOIN tmin ON tmin.uri = b.uri LEFT JOIN alts ON alts.uri = b.uri"""


def trigram_sql(x: str) -> str:
    """SQL trigram set of ``x`` (same rules as :func:`ontocat.functions.trigrams.trigrams`)."""
    return (
        "list_distinct(flatten(list_transform("
        f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def _values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({cols}))"


def _search_sql(queries: str, extra_cols: str = "") -> str:
    return f"""
, qs AS {queries}
, qt AS (SELECT DISTINCT query, {trigram_sql('query')} AS gq FROM qs)
, tt AS (SELECT text, {trigram_sql('text')} AS gt FROM (SELECT DISTINCT o AS text FROM g WHERE o_kind = 'lit'))
, pairs_s AS (SELECT qt.query, tt.text, len(list_intersect(qt.gq, tt.gt)) AS shared, len(qt.gq) AS nq, len(tt.gt) AS nt
              FROM qt, tt)
, hits AS (SELECT query, text FROM pairs_s WHERE shared > 0 AND 10 * shared >= 3 * (nq + nt - shared))
, found AS (SELECT DISTINCT h.query, x.s AS uri, h.text FROM hits h JOIN g x ON x.o = h.text AND x.o_kind = 'lit')
"""


def uri_component_sql(x: str) -> str:
    """SQL ``encodeURIComponent``."""
    e = f"url_encode({x})"
    for enc, ch in (("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = f"replace({e}, '{enc}', '{ch}')"
    return e


def display_label_sql(label: str, uri: str) -> str:
    local = f"split_part({uri}, '/', -1)"
    return f"CASE WHEN coalesce({label}, '') = '' THEN split_part({local}, '#', -1) ELSE {label} END"


GRAPH_VIEW_CTES = f"""
, tabs AS (SELECT t.s AS uri, n.o AS name FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
           WHERE t.p = 'rdf:type' AND t.o = 'uc:Table' AND t.o_kind = 'iri')
, cols AS (SELECT t.s AS uri, n.o AS name FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
           WHERE t.p = 'rdf:type' AND t.o = 'uc:Column' AND t.o_kind = 'iri')
, conc AS (SELECT DISTINCT m.uri, l.label FROM members m LEFT JOIN lab l ON l.uri = m.uri)
, dom AS (SELECT d.s AS uri, d.o AS domain, l.label AS domain_label FROM g d JOIN lab l ON l.uri = d.o WHERE d.p = 'rdfs:domain')
, rng AS (SELECT r.s AS uri, r.o AS range, l.label AS range_label FROM g r JOIN lab l ON l.uri = r.o WHERE r.p = 'rdfs:range')
, prop_rows AS (
    SELECT DISTINCT pr.uri, n.label AS name, dom.domain, dom.domain_label, rng.range, rng.range_label
    FROM props pr LEFT JOIN lab n ON n.uri = pr.uri LEFT JOIN dom ON dom.uri = pr.uri LEFT JOIN rng ON rng.uri = pr.uri)
, nodes AS (
    SELECT uri AS id, {display_label_sql('label', 'uri')} AS label, 'concept' AS type,
           '/concepts?concept_uri=' || {uri_component_sql('uri')} AS url FROM conc
    UNION ALL SELECT uri, {display_label_sql('name', 'uri')}, 'property',
           '/properties?property_uri=' || {uri_component_sql('uri')} FROM prop_rows
    UNION ALL SELECT uri, {display_label_sql('name', 'uri')}, 'table',
           '/tables?table_uri=' || {uri_component_sql('uri')} FROM tabs
    UNION ALL SELECT uri, {display_label_sql('name', 'uri')}, 'column',
           '/columns?column_uri=' || {uri_component_sql('uri')} FROM cols)
, hascol AS (
    SELECT t.table_uri, c.uri AS column_uri
    FROM (SELECT uri, string_split({display_label_sql('name', 'uri')}, '.') AS parts FROM cols) c
    JOIN (SELECT name, min(uri) AS table_uri FROM tabs WHERE name IS NOT NULL GROUP BY name) t
      ON t.name = array_to_string(c.parts[1:3], '.')
    WHERE len(c.parts) >= 4)
, early_ids AS (SELECT uri AS id FROM members UNION SELECT uri FROM props
                UNION SELECT s FROM g WHERE p = 'rdf:type' AND o = 'uc:Table' AND o_kind = 'iri')
, all_ids AS (SELECT id FROM early_ids UNION SELECT s FROM g WHERE p = 'rdf:type' AND o = 'uc:Column' AND o_kind = 'iri')
, links AS (
    SELECT DISTINCT * FROM (
      SELECT r.s AS source, r.o AS target, r.p AS type
      FROM g r JOIN members m ON m.uri = r.s
      WHERE r.p IN ('rdfs:subClassOf', 'skos:broader', 'skos:narrower') AND r.o <> ''
        AND r.o IN (SELECT uri FROM members)
      UNION ALL SELECT uri, domain, 'domain' FROM prop_rows WHERE domain IN (SELECT uri FROM members)
      UNION ALL SELECT uri, range, 'range' FROM prop_rows WHERE range IN (SELECT uri FROM members)
      UNION ALL SELECT table_uri, concept_uri, 'assignment' FROM ta
        WHERE table_uri IN (SELECT id FROM early_ids) AND concept_uri IN (SELECT id FROM early_ids)
      UNION ALL SELECT table_uri, column_uri, 'hasColumn' FROM hascol
      UNION ALL SELECT column_uri, property_uri, 'propertyAssignment' FROM ca
        WHERE column_uri IN (SELECT uri FROM cols) AND column_uri IN (SELECT id FROM all_ids)
          AND property_uri IN (SELECT id FROM all_ids)) x)
"""


ORACLE: dict[str, str] = {
    "tables": with_common("""
SELECT t.s AS uri, n.o AS name
FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
WHERE t.p = 'rdf:type' AND t.o = 'uc:Table' AND t.o_kind = 'iri'"""),
    "columns": with_common("""
SELECT t.s AS uri, n.o AS name
FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
WHERE t.p = 'rdf:type' AND t.o = 'uc:Column' AND t.o_kind = 'iri'"""),
    "concepts": with_common("""
SELECT DISTINCT m.uri, l.label FROM members m LEFT JOIN lab l ON l.uri = m.uri"""),
    "properties": with_common("""
, dom AS (SELECT d.s AS uri, d.o AS domain, l.label AS domain_label FROM g d JOIN lab l ON l.uri = d.o WHERE d.p = 'rdfs:domain')
, rng AS (SELECT r.s AS uri, r.o AS range, l.label AS range_label FROM g r JOIN lab l ON l.uri = r.o WHERE r.p = 'rdfs:range')
SELECT DISTINCT pr.uri, n.label AS name, dom.domain, dom.domain_label, rng.range, rng.range_label
FROM props pr LEFT JOIN lab n ON n.uri = pr.uri LEFT JOIN dom ON dom.uri = pr.uri LEFT JOIN rng ON rng.uri = pr.uri"""),
    "concepts_alt_labels": with_common("""
, rows AS (
  SELECT DISTINCT m.uri, l.label, a.o AS alt
  FROM members m LEFT JOIN lab l ON l.uri = m.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = m.uri)
SELECT uri, label, alt AS alt_label FROM rows"""),
    "concepts_alt_labels_bag": with_common("""
SELECT m.uri, l.label, a.o AS alt_label, count(*) AS n
FROM members_bag m LEFT JOIN lab l ON l.uri = m.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = m.uri
GROUP BY m.uri, l.label, a.o"""),
    "concept_alt_label_pairs": with_common("""
SELECT m.uri, l.label, a.o AS alt_label, count(*) AS n
FROM members_bag m LEFT JOIN lab l ON l.uri = m.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = m.uri
GROUP BY m.uri, l.label, a.o"""),
    "properties_alt_labels": with_common("""
SELECT pr.uri, n.label AS name, a.o AS alt_label
FROM props pr LEFT JOIN lab n ON n.uri = pr.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = pr.uri"""),
    "table_assignments": with_common("SELECT * FROM ta"),
    "column_assignments": with_common("SELECT * FROM ca"),
    "tag_mappings": with_common("""
SELECT name, type, tag, count(*) AS n FROM pairs GROUP BY type, name, tag"""),
    "tag_mapping_pairs": with_common("SELECT type, name, tag FROM pairs"),
    "concept_detail": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + """
, req AS (SELECT uri FROM members UNION ALL SELECT o FROM g WHERE p = 'uc:conceptAssignment')
, base AS (SELECT DISTINCT r.uri FROM req r JOIN g ON g.s = r.uri)""" + _detail_select("base")),
    "property_detail": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + """
, base AS (SELECT DISTINCT pr.uri FROM props pr JOIN g a ON a.p = 'uc:propertyAssignment' AND a.o = pr.uri)
, d AS (SELECT x.s AS uri, x.o AS domain, l.label AS domain_label FROM g x LEFT JOIN lab l ON l.uri = x.o WHERE x.p = 'rdfs:domain')
, dmin AS (SELECT d.uri, d.domain, min(d.domain_label) AS domain_label FROM d
           JOIN (SELECT uri, min(domain) AS domain FROM d GROUP BY uri) m ON m.uri = d.uri AND m.domain = d.domain
           GROUP BY d.uri, d.domain)
, r AS (SELECT x.s AS uri, x.o AS range, l.label AS range_label FROM g x LEFT JOIN lab l ON l.uri = x.o WHERE x.p = 'rdfs:range')
, rmin AS (SELECT r.uri, r.range, min(r.range_label) AS range_label FROM r
           JOIN (SELECT uri, min(range) AS range FROM r GROUP BY uri) m ON m.uri = r.uri AND m.range = r.range
           GROUP BY r.uri, r.range)
SELECT b.uri, lmin.label, cmin.comment, dmin.domain, dmin.domain_label, rmin.range, rmin.range_label,
       coalesce(alts.n_alt_labels, 0) AS n_alt_labels
FROM base b LEFT JOIN lmin ON lmin.uri = b.uri LEFT JOIN cmin ON cmin.uri = b.uri
LEFT JOIN dmin ON dmin.uri = b.uri LEFT JOIN rmin ON rmin.uri = b.uri LEFT JOIN alts ON alts.uri = b.uri"""),
    "concept_relationships": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + "SELECT * FROM rel"),
    "alt_labels": with_common("""
SELECT s AS uri, o AS alt_label FROM g WHERE p = 'skos:altLabel'"""),
    "concept_properties": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + "SELECT * FROM cprops"),
    "concept_summary": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + """
, base AS (SELECT DISTINCT m.uri FROM members m JOIN g ON g.s = m.uri)
, det AS (""" + _detail_select("base") + """)
, nrel AS (SELECT uri, count(*) AS n FROM rel GROUP BY uri)
, ntab AS (SELECT concept_uri AS uri, count(*) AS n FROM ta GROUP BY concept_uri)
, nprp AS (SELECT concept AS uri, count(*) AS n FROM cprops GROUP BY concept)
SELECT det.*, coalesce(nrel.n, 0) AS n_relationships, coalesce(ntab.n, 0) AS n_assigned_tables,
       coalesce(nprp.n, 0) AS n_properties
FROM det LEFT JOIN nrel ON nrel.uri = det.uri LEFT JOIN ntab ON ntab.uri = det.uri LEFT JOIN nprp ON nprp.uri = det.uri"""),
    "concept_summary_items": with_common(DETAIL_CTES.replace("{expand}", expand_sql("r.p")) + """
, base AS (SELECT DISTINCT m.uri FROM members m JOIN g ON g.s = m.uri)
, items AS (
    SELECT uri, 'relationship' AS section, object AS i_uri, object_label AS i_label, predicate_type AS i_role
    FROM rel WHERE uri IN (SELECT uri FROM base)
    UNION ALL
    SELECT concept_uri, 'assigned_table', table_uri, table_name, 'assignment' FROM ta WHERE concept_uri IN (SELECT uri FROM base)
    UNION ALL
    SELECT concept, 'property', uri, name, role FROM cprops WHERE concept IN (SELECT uri FROM base))
SELECT uri, section, i_uri AS item_uri, i_label AS item_label, i_role AS item_role FROM items"""),
    "assigned_objects": with_common("""
, req AS (SELECT uri FROM members UNION SELECT uri FROM props)
SELECT ta.concept_uri AS uri, ta.table_uri, ta.table_name, ta.concept_uri, ta.concept_name,
       CAST(NULL AS VARCHAR) AS column_uri, CAST(NULL AS VARCHAR) AS column_name,
       CAST(NULL AS VARCHAR) AS property_uri, CAST(NULL AS VARCHAR) AS property_name
FROM ta JOIN req ON req.uri = ta.concept_uri
UNION ALL
SELECT ca.property_uri, NULL, NULL, NULL, NULL, ca.column_uri, ca.column_name, ca.property_uri, ca.property_name
FROM ca JOIN req ON req.uri = ca.property_uri"""),
    "trigram_search": with_common(_search_sql(_values([(q,) for q in SEARCH_QUERIES], "query"))
                                  + "SELECT query, uri, text FROM found"),
    "trigram_search_kind": with_common(
        _search_sql(_values([(q, k) for q in SEARCH_QUERIES for k in SEARCH_KINDS], "query, kind")) + """
SELECT f.query, q.kind, f.uri, f.text FROM found f JOIN qs q ON q.query = f.query
WHERE q.kind IS NULL OR q.kind = 'all'
   OR (q.kind = 'concept' AND f.uri IN (SELECT uri FROM members))
   OR (q.kind = 'property' AND f.uri IN (SELECT uri FROM props))"""),
    "list_filter": with_common(f"""
, fs AS {_values([(q,) for q in LIST_FILTERS], "q")}
, items AS (
    SELECT 'concepts' AS list, m.uri, l.label,
           concat_ws(' ', coalesce(string_agg(a.o, ' ' ORDER BY a.o), ''), m.uri, coalesce(l.label, 'None')) AS text
    FROM members_bag m LEFT JOIN lab l ON l.uri = m.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = m.uri
    GROUP BY m.uri, l.label
    UNION ALL
    SELECT 'properties', pr.uri, n.label,
           concat_ws(' ', coalesce(string_agg(a.o, ' ' ORDER BY a.o), ''), pr.uri, coalesce(n.label, 'None'))
    FROM props pr LEFT JOIN lab n ON n.uri = pr.uri LEFT JOIN g a ON a.p = 'skos:altLabel' AND a.s = pr.uri
    GROUP BY pr.uri, n.label
    UNION ALL
    SELECT 'tables', t.s, n.o, concat_ws(' ', t.s, coalesce(n.o, 'None'))
    FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
    WHERE t.p = 'rdf:type' AND t.o = 'uc:Table' AND t.o_kind = 'iri'
    UNION ALL
    SELECT 'columns', t.s, n.o, concat_ws(' ', t.s, coalesce(n.o, 'None'))
    FROM g t LEFT JOIN g n ON n.p = 'uc:name' AND n.s = t.s
    WHERE t.p = 'rdf:type' AND t.o = 'uc:Column' AND t.o_kind = 'iri')
SELECT fs.q, items.list, items.uri, items.label FROM items JOIN fs ON strpos(upper(items.text), upper(fs.q)) > 0"""),
    "graph_nodes": with_common(GRAPH_VIEW_CTES + "SELECT * FROM nodes"),
    "graph_links": with_common(GRAPH_VIEW_CTES + "SELECT * FROM links"),
    "has_column": with_common(GRAPH_VIEW_CTES + "SELECT * FROM hascol"),
    "graph_stats": with_common(GRAPH_VIEW_CTES + """
SELECT t.type, coalesce(c.n, 0) AS n
FROM (VALUES ('concept'), ('property'), ('table'), ('column')) AS t(type)
LEFT JOIN (SELECT type, count(*) AS n FROM nodes GROUP BY type) c ON c.type = t.type"""),
    "tag_sync_plan": with_common(_plan_sql(50)),
    "tag_sync_plan_limit25": with_common(_plan_sql(25)),
    "tag_changes_from_json": with_common(_plan_sql(50).replace(
        "SELECT ch.entity_type, ch.entity_name, ch.tag_key, ch.action, per.resulting >= 50 AS skipped",
        "SELECT ch.entity_type, ch.entity_name, ch.tag_key, ch.action, "
        "CASE WHEN ch.action = 'delete' THEN 0 ELSE 1 END AS step") + " WHERE per.resulting < 50"),
    "tag_sync_applied": with_common(_plan_sql(50).replace("SELECT ch.entity_type", ", plan AS (SELECT ch.entity_type", 1) + """)
(SELECT entity_type, entity_name, tag_key FROM cur
 EXCEPT SELECT entity_type, entity_name, tag_key FROM plan WHERE action = 'delete' AND NOT skipped)
UNION SELECT entity_type, entity_name, tag_key FROM plan WHERE action = 'add' AND NOT skipped"""),
}

from ontocat.plans.oracle_mutations import MUTATION_BODIES  # noqa: E402

ORACLE.update({k: with_common(v) for k, v in MUTATION_BODIES.items()})
ORACLE["snapshot_log"] = " UNION ".join(
    f"SELECT s, p, o, o_kind FROM ({ORACLE[k]}) {k}" for k in ("assign_concepts", "assign_properties"))

# The mapping and plan after the mixed log, from the graph it leaves.
_KEPT = ORACLE["command_log"].replace("\nSELECT last.s,", """
, left_graph AS (SELECT last.s,""", 1) + """)
, kept AS (
  SELECT 'tables' AS type, n.o AS name, l.o AS tag FROM left_graph a JOIN left_graph n ON n.s = a.s AND n.p = 'uc:name'
         JOIN left_graph l ON l.s = a.o AND l.p = 'rdfs:label' WHERE a.p = 'uc:conceptAssignment' AND n.o <> '' AND l.o <> ''
  UNION ALL SELECT 'columns', n.o, l.o FROM left_graph a JOIN left_graph n ON n.s = a.s AND n.p = 'uc:name'
         JOIN left_graph l ON l.s = a.o AND l.p = 'rdfs:label' WHERE a.p = 'uc:propertyAssignment' AND n.o <> '' AND l.o <> '')
, kept_counts AS (SELECT name, type, tag, count(*) AS n FROM kept GROUP BY ALL)"""
ORACLE["tag_mappings_kept"] = _KEPT + "\nSELECT name, type, tag, n FROM kept_counts"
ORACLE["tag_sync_changed"] = _KEPT + """
, old_counts AS (SELECT name, type, tag, count(*) AS n FROM pairs GROUP BY ALL)
, changed AS (SELECT DISTINCT type, name FROM (
    (SELECT name, type, tag, n FROM kept_counts EXCEPT SELECT name, type, tag, n FROM old_counts)
    UNION ALL (SELECT name, type, tag, n FROM old_counts EXCEPT SELECT name, type, tag, n FROM kept_counts)) x)""" + _plan_sql(50).replace(
    "FROM pairs)", "FROM kept WHERE (type, name) IN (SELECT (type, name) FROM changed))")
