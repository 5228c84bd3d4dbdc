"""Queries on dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import graph as g
from telar.plans.inputs import derive, oracle
from telar.sources.files import settled

TRIPLES = """
SELECT l_orderkey % 200 AS graph_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS seq,
  concat('Nodo ', chr(CAST(65 + l_partkey % 7 AS INT)), '.') AS subject, CASE l_orderkey % 3 WHEN 0 THEN 'milestone' WHEN 1 THEN 'risk' ELSE 'clause' END AS subject_type,
  CASE l_linenumber % 7 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'blocks' WHEN 2 THEN 'requires' WHEN 3 THEN 'related_to' WHEN 4 THEN 'triggered_by' WHEN 5 THEN 'conflicts_with' ELSE 'mentions' END AS relation,
  concat('nodo  ', chr(CAST(65 + l_suppkey % 7 AS INT))) AS object, CASE l_orderkey % 2 WHEN 0 THEN 'stakeholder' ELSE 'resource' END AS object_type, CAST(l_linenumber AS DOUBLE) / 10 AS confidence
FROM {lineitem}"""
SENTENCES = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'El pago final se libera tras la entrega provisoria.' WHEN 1 THEN concat('El módulo', CAST(o_orderkey AS STRING), ' requiere el servidor central.')
  WHEN 2 THEN 'Si el respaldo falla, se aplicará la multa diaria.' ELSE 'Nada que ver.' END AS text,
  CASE o_orderkey % 4 WHEN 0 THEN 'sin datos' WHEN 1 THEN concat('Ok: [{"subject": {"id": "Hito Uno!", "label": "Hito ', CAST(o_orderkey AS STRING), '", "type": "MILESTONE"}, "predicate": "BLOCKS", "object": {"label": "B", "type": "cosa"}, "confidence": 0.5}] fin')
  WHEN 2 THEN '[{"subject": {"id": "a"}, "predicate": "odd", "object": {"id": "b", "label": "B", "type": "risk"}}]' ELSE '[broken' END AS reply
FROM {orders}"""


def triples(spark, d):
    return derive(spark, d, TRIPLES)


def texts(spark, d):
    return derive(spark, d, SENTENCES)


def named(spark, d):
    return g.nodes(triples(spark, d))


def linked(spark, d):
    return g.edges(triples(spark, d))


def found(spark, d):
    """Cycles of the graphs within the limit of nodes."""
    accepted = g.limits(named(spark, d)).filter("accepted").select("graph_id")
    return g.cycles(linked(spark, d).join(accepted, "graph_id", "left_semi"))


def pattern_triples(spark, d):
    return g.pattern_triples(texts(spark, d), ["doc_id"])


def json_triples(spark, d):
    return g.json_triples(texts(spark, d), ["doc_id"])


def coerce_types(spark, d):
    e = derive(spark, d, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Risk' WHEN 1 THEN 'odd' ELSE NULL END AS node, CASE event_id % 4 WHEN 0 THEN 'BLOCKS' WHEN 1 THEN 'x' ELSE 'mentions' END AS relation FROM {events}")
    return e.select("event_id", g.coerce_node(F.col("node")).alias("node"), g.coerce_relation(F.col("relation")).alias("relation"))


def node_id(spark, d):
    return derive(spark, d, "SELECT p_partkey, concat('  ', p_name, ' (', p_type, ')  n.', CAST(p_partkey AS STRING), ' y una cola bastante larga para el corte') AS label FROM {part}").select("p_partkey", g.node_id(F.col("label")).alias("node_id"))


def graph_nodes(spark, d):
    return named(spark, d)


def graph_edges(spark, d):
    return linked(spark, d)


def merge_graph(spark, d):
    """A graph's winners are kept; a further section is merged with them, and the triples before aren't read again."""
    t = triples(spark, d)
    kept = settled(g.edge_winners(t.filter("seq % 2 = 1")), "graph")
    return g.shown_edges(g.merged_edges(kept, g.edge_winners(t.filter("seq % 2 = 0"), 1)))


def find_cycles(spark, d):
    return g.describe_cycles(found(spark, d), named(spark, d)).withColumn("path", F.array_join("path", ","))


def graph_limits(spark, d):
    t = derive(spark, d, "SELECT l_orderkey % 50 AS graph_id, l_linenumber AS seq, concat('p', CAST(l_partkey % (l_orderkey % 50 + 5) AS STRING)) AS subject, 'risk' AS subject_type, 'x' AS object, 'risk' AS object_type FROM {lineitem}")
    return g.limits(g.nodes(t))


def graph_lookup(spark, d):
    return g.degrees(linked(spark, d))


def graph_summary(spark, d):
    return g.summary(named(spark, d), linked(spark, d), found(spark, d))


def export_graph(spark, d):
    """Graphs of all orders; those without a triple are empty."""
    every = derive(spark, d, "SELECT DISTINCT o_orderkey % 210 AS graph_id FROM {orders}")
    return g.mermaid(named(spark, d), linked(spark, d), graphs=every)


def mermaid_edges(spark, d):
    return linked(spark, d).select("graph_id", "source", "target", g.mermaid_edge().alias("line"))


def export_graphml(spark, d):
    return g.graphml(named(spark, d), linked(spark, d)).select("graph_id", "part", "line")


QUERIES = {f.__name__: f for f in (
    pattern_triples, json_triples, coerce_types, node_id, graph_nodes, graph_edges, merge_graph, find_cycles, graph_limits, graph_lookup, graph_summary, export_graph, mermaid_edges, export_graphml)}

T = oracle(TRIPLES)
ID = "replace(lower(regexp_replace(regexp_replace({0}, '[.]', '', 'g'), ' +', ' ', 'g')), ' ', '_')"
N = f"""t AS ({T}), m AS (SELECT graph_id, {ID.format('subject')} AS node_id, seq, 0 AS side, subject AS label, subject_type AS type FROM t UNION ALL SELECT graph_id, {ID.format('object')}, seq, 1, object, object_type FROM t),
n AS (SELECT graph_id, node_id, min(row(seq, side, label, type)) AS r FROM m GROUP BY 1, 2), nn AS (SELECT graph_id, node_id, r[3] AS label, r[4] AS type FROM n),
e AS (SELECT graph_id, {ID.format('subject')} AS source, {ID.format('object')} AS target, max(row({{0}}, relation, confidence)) AS r FROM t GROUP BY 1, 2, 3), ee AS (SELECT graph_id, source, target, r[2] AS relation, r[3] AS weight FROM e)"""
N0 = N.format("seq")
C = """small AS (SELECT graph_id FROM nn GROUP BY 1 HAVING count(*) <= 50),
walk AS (SELECT graph_id, source AS a, target AS z, [source] AS p FROM ee JOIN small USING (graph_id) WHERE target >= source
  UNION ALL SELECT w.graph_id, w.a, ee.target, list_append(w.p, w.z) FROM walk w JOIN ee ON ee.graph_id = w.graph_id AND ee.source = w.z
  WHERE w.z <> w.a AND ee.target >= w.a AND (ee.target = w.a OR ee.target <> w.z AND NOT list_contains(w.p, ee.target))),
c AS (SELECT graph_id, p FROM walk WHERE a = z)"""
ORACLES = {
    "pattern_triples": """SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'Pago Final' WHEN 1 THEN 'Módulo' || o_orderkey ELSE 'Respaldo' END AS subject, CASE o_orderkey % 4 WHEN 0 THEN 'milestone' WHEN 1 THEN 'requirement' ELSE 'resource' END AS subject_type,
      CASE o_orderkey % 4 WHEN 0 THEN 'triggered_by' WHEN 1 THEN 'requires' ELSE 'blocks' END AS relation, CASE o_orderkey % 4 WHEN 0 THEN 'Entrega Provisoria' WHEN 1 THEN 'Servidor Central' ELSE 'Multa Diaria' END AS object,
      CASE o_orderkey % 4 WHEN 0 THEN 'milestone' WHEN 1 THEN 'resource' ELSE 'risk' END AS object_type, CAST(CASE o_orderkey % 4 WHEN 2 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 4 < 3""",
    "json_triples": """SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS seq, CASE o_orderkey % 4 WHEN 1 THEN 'Hito ' || o_orderkey ELSE 'Unknown' END AS subject, CASE o_orderkey % 4 WHEN 1 THEN 'milestone' ELSE 'requirement' END AS subject_type, CASE o_orderkey % 4 WHEN 1 THEN 'hito_uno' ELSE 'a' END AS subject_id,
      CASE o_orderkey % 4 WHEN 1 THEN 'blocks' ELSE 'related_to' END AS relation, 'B' AS object, CASE o_orderkey % 4 WHEN 1 THEN 'requirement' ELSE 'risk' END AS object_type, CASE o_orderkey % 4 WHEN 1 THEN 'unknown' ELSE 'b' END AS object_id, CAST(CASE o_orderkey % 4 WHEN 1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence
      FROM orders WHERE o_orderkey % 4 IN (1, 2)""",
    "coerce_types": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'risk' ELSE 'requirement' END AS node, CASE event_id % 4 WHEN 0 THEN 'blocks' WHEN 1 THEN 'related_to' ELSE 'mentions' END AS relation FROM events",
    "node_id": "SELECT p_partkey, left(replace(lower(p_name), ' ', '_') || '_' || lower(p_type) || '_n' || p_partkey || '_y_una_cola_bastante_larga_para_el_corte', 50) AS node_id FROM part",
    "graph_nodes": f"WITH {N0} SELECT graph_id, node_id, label, type FROM nn",
    "graph_edges": f"WITH {N0} SELECT graph_id, source, target, relation, weight FROM ee",
    "merge_graph": f"WITH {N.format('CASE WHEN seq % 2 = 1 THEN 0 ELSE 1 END, seq')} SELECT graph_id, source, target, r[3] AS relation, r[4] AS weight FROM e",
    "find_cycles": f"""WITH RECURSIVE {N0}, {C}, l AS (SELECT graph_id, map_from_entries(list((node_id, label))) AS names FROM nn GROUP BY 1) SELECT c.graph_id, array_to_string(p, ',') AS path, CASE WHEN len(p) <= 3 THEN 'high' ELSE 'medium' END AS severity,
      'Dependencia circular: ' || array_to_string(list_transform(list_append(p, p[1]), lambda x: element_at(names, x)[1]), ' → ') AS description FROM c JOIN l USING (graph_id)""",
    "graph_limits": """SELECT graph_id, n AS n_nodes, n <= 50 AS accepted, CASE WHEN n > 30 THEN 'Grafo grande: ' || n || ' nodos' END AS warning FROM (SELECT l_orderkey % 50 AS graph_id, count(DISTINCT l_partkey % (l_orderkey % 50 + 5)) + 1 AS n FROM lineitem GROUP BY 1)""",
    "graph_lookup": f"WITH {N0} SELECT graph_id, node_id, CAST(sum(o) AS BIGINT) AS edges_from, CAST(sum(i) AS BIGINT) AS edges_to FROM (SELECT graph_id, source AS node_id, 1 AS o, 0 AS i FROM ee UNION ALL SELECT graph_id, target, 0, 1 FROM ee) GROUP BY 1, 2",
    "graph_summary": f"""WITH RECURSIVE {N0}, {C} SELECT a.graph_id, nodes, edges, coalesce(k, 0) AS deadlocks, coalesce(k, 0) > 0 AS has_deadlocks FROM (SELECT graph_id, count(*) AS nodes FROM nn GROUP BY 1) a JOIN (SELECT graph_id, count(*) AS edges FROM ee GROUP BY 1) b USING (graph_id) LEFT JOIN (SELECT graph_id, count(*) AS k FROM c GROUP BY 1) USING (graph_id)""",
    "export_graph": f"""WITH {N0}, x AS (SELECT graph_id, 0 AS o, node_id AS a, '' AS b, '    ' || node_id || CASE type WHEN 'milestone' THEN '(("' || label || '"))' WHEN 'risk' THEN '[/"' || label || '"\\]' WHEN 'stakeholder' THEN '[["' || label || '"]]' ELSE '["' || label || '"]' END AS line FROM nn
      UNION ALL SELECT graph_id, 1, source, target, '    ' || source || ' -->|' || relation || '| ' || target FROM ee), y AS (SELECT graph_id, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY o, a, b) AS mermaid FROM x GROUP BY 1)
      SELECT graph_id, coalesce(mermaid, 'graph TD' || chr(10) || '    empty[No nodes]') AS mermaid FROM (SELECT DISTINCT o_orderkey % 210 AS graph_id FROM orders) o LEFT JOIN y USING (graph_id)""",
    "mermaid_edges": f"WITH {N0} SELECT graph_id, source, target, source || ' -->|' || upper(relation) || '| ' || target AS line FROM ee",
    "export_graphml": f"""WITH {N0} SELECT graph_id, CAST(0 AS INT) AS part, '<node id="' || node_id || '"><data key="label">' || label || '</data><data key="type">' || type || '</data></node>' AS line FROM nn
      UNION ALL SELECT graph_id, 1, '<edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data></edge>' FROM ee""",
}
