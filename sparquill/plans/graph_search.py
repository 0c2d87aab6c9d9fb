"""Searches in graphs: regions, nations and suppliers as a call tree, parts as entities; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import graph as op
from sparquill.plans.graph import DEG, E, N, _edges, _nodes
from sparquill.sources.tables import table


def _tree(spark, d):
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    down = nation.select(name("R", "n_regionkey").alias("src"), name("N", "n_nationkey").alias("dst"))
    return down.unionAll(supplier.select(name("N", "s_nationkey"), name("S", "s_suppkey"))).withColumn("type", F.lit("calls"))


def _tree_nodes(spark, d):
    parts = [table(spark, d, t).select(F.concat(F.lit(t[0].upper()), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.lit(kind).alias("type")) for t, k, n, kind in (("region", "r_regionkey", "r_name", "structure"), ("nation", "n_nationkey", "n_name", "procedure"), ("supplier", "s_suppkey", "s_name", "variable"))]
    x = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return x.withColumns({"qualified_name": F.concat_ws("::", "type", "name"), "metadata": F.create_map(F.lit("id"), F.col("id"), F.lit("kind"), F.col("type"))})


def graph_named(spark, d):
    return op.named(_nodes(spark, d), ["red widget", "WIDGET", "no such part"])


def graph_leaf_chains(spark, d):
    return op.leaf_chains(_tree(spark, d), ["R3", "R1"], ["N1"]).select(F.array_join("path", ">").alias("path"))


def graph_call_chains(spark, d):
    return op.call_chains(_tree(spark, d), "R2", 2).select(F.array_join("chain", ">").alias("chain"))


def graph_call_depth(spark, d):
    return op.call_depth(_tree(spark, d), _tree_nodes(spark, d).where("type <> 'variable'").select("id"))


def graph_flows(spark, d):
    return op.process_flows(_tree_nodes(spark, d), _tree(spark, d))


def graph_related(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.split("p_type", " ").alias("capabilities"), F.split("p_name", " ").alias("keywords"))
    return op.related(p, _edges(spark, d), 1, 25)


def graph_external(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 40).alias("external"))
    own = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return op.external_dependencies(nodes, _edges(spark, d), own)


def graph_entities(spark, d):
    return op.entities(_tree_nodes(spark, d), "procedure", kind="procedure", name="NATION_7").unionAll(op.entities(_tree_nodes(spark, d), None, id="S7")).select("id", "name")


def graph_metadata(spark, d):
    return op.with_metadata(_tree_nodes(spark, d), "kind", "structure").select("id").unionAll(op.with_metadata(_tree_nodes(spark, d), "absent").select("id"))


def graph_full_text(spark, d):
    return op.full_text(_tree_nodes(spark, d), "r1").select("id", F.array_join("fields", ",").alias("fields"), "match_count")


def graph_edges_between(spark, d):
    return op.edges_between(_edges(spark, d), src=3, kind="calls").groupBy("dst").agg(F.count("*").alias("n"))


def graph_functionality(spark, d):
    return op.functionality(_tree_nodes(spark, d), _tree(spark, d), "n_1")


def graph_strong_components(spark, d):
    """Calls among parts: sizes of the groups of parts that reach each other."""
    return op.strong_components(_edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


def graph_coupling_order(spark, d):
    return op.coupling_order(_nodes(spark, d), _edges(spark, d))


T = "t AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"
TN = "tn AS (SELECT 'R' || r_regionkey AS id, r_name AS name, 'structure' AS type FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'procedure' FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'variable' FROM supplier)"
FULL = "f AS (SELECT id, list_filter([CASE WHEN contains(lower(name), '{t}') THEN 'name' END, CASE WHEN contains(lower(type || '::' || name), '{t}') THEN 'qualified_name' END, CASE WHEN contains(lower(id), '{t}') THEN 'metadata.id' END, CASE WHEN contains(lower(type), '{t}') THEN 'metadata.kind' END], lambda x: x IS NOT NULL) AS l FROM tn)"
SQL = {
    "graph_named": f"WITH {N}, p AS (SELECT id, name FROM n WHERE type = 'procedure') SELECT 'red widget' AS asked, id, name FROM p WHERE name = 'red widget' OR (contains(lower(name), 'red widget') AND NOT EXISTS (FROM p WHERE name = 'red widget')) UNION ALL SELECT 'WIDGET', id, name FROM p WHERE name = 'WIDGET' OR (contains(lower(name), 'widget') AND NOT EXISTS (FROM p WHERE name = 'WIDGET'))",
    "graph_leaf_chains": f"WITH {T}, c AS (SELECT a.src AS r, a.dst AS n, b.dst AS s FROM t a JOIN t b ON b.src = a.dst WHERE a.src IN ('R3', 'R1') AND a.dst <> 'N1') SELECT r || '>' || n || '>' || s AS path FROM c ORDER BY r DESC, n, s LIMIT 10",
    "graph_call_chains": f"WITH {T} SELECT 'R2>' || dst AS chain FROM t WHERE src = 'R2' UNION ALL SELECT 'R2>' || a.dst || '>' || b.dst FROM t a JOIN t b ON b.src = a.dst WHERE a.src = 'R2'",
    "graph_call_depth": f"WITH {T}, {TN} SELECT id AS start, CASE WHEN EXISTS (SELECT 1 FROM t a JOIN t b ON b.src = a.dst WHERE a.src = id) THEN 2 WHEN EXISTS (SELECT 1 FROM t WHERE src = id) THEN 1 ELSE 0 END AS depth FROM tn WHERE type <> 'variable'",
    "graph_flows": f"""WITH RECURSIVE {T}, {TN}, o AS (SELECT src, count(*) AS o FROM t GROUP BY 1), en AS (SELECT id FROM tn JOIN o ON src = id WHERE o >= 3 ORDER BY id LIMIT 10),
      r(entry, id, depth, path) AS (SELECT id, id, 0, [id] FROM en UNION ALL SELECT entry, dst, depth + 1, list_append(path, dst) FROM r JOIN t ON src = id),
      p AS (SELECT entry, id, depth, row_number() OVER (PARTITION BY entry ORDER BY depth, path) AS place FROM r), k AS (SELECT *, count(*) OVER (PARTITION BY entry) AS n FROM p WHERE place <= 20)
      SELECT entry, id, CAST(place AS INT) AS place, depth, coalesce(o > 2, false) AS decision FROM k LEFT JOIN o ON src = id WHERE n >= 3""",
    "graph_related": f"""WITH {E}, x AS (SELECT p_partkey AS id, p_brand AS f, string_split(p_type, ' ') AS c, string_split(p_name, ' ') AS k FROM part), m AS (SELECT * FROM x WHERE id = 1),
      s AS (SELECT x.id, 3.0 * len(list_intersect(x.c, m.c)) + 0.5 * len(list_intersect(x.k, m.k)) + 5 * (CAST(EXISTS (FROM e WHERE src = 1 AND dst = x.id) AS INT) + CAST(EXISTS (FROM e WHERE dst = 1 AND src = x.id) AS INT)) + CAST(x.f = m.f AS INT) AS score FROM x, m WHERE x.id <> 1)
      SELECT id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25""",
    "graph_external": f"WITH {E} SELECT b.p_name AS name, arg_min(a.p_brand, [src, dst]) AS called_by FROM e JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE type = 'calls' AND a.p_size < 10 AND b.p_size > 40 GROUP BY 1",
    "graph_entities": f"WITH {TN} SELECT id, name FROM tn WHERE (type = 'procedure' AND name = 'NATION_7') OR id = 'S7'",
    "graph_metadata": f"WITH {TN} SELECT id FROM tn WHERE type = 'structure'",
    "graph_full_text": f"WITH {TN}, {FULL.format(t='r1')} SELECT id, array_to_string(l, ',') AS fields, len(l) AS match_count FROM f WHERE len(l) > 0",
    "graph_edges_between": f"WITH {E} SELECT dst, count(*) AS n FROM e WHERE src = 3 AND type = 'calls' GROUP BY 1",
    "graph_functionality": f"""WITH {T}, {TN}, {FULL.format(t='n_1')}, m AS (SELECT * FROM tn WHERE contains(lower(name), 'n_1')), p AS (SELECT id FROM m WHERE type = 'procedure')
      SELECT type AS part, id, NULL AS other FROM m UNION ALL SELECT 'called_by', dst, src FROM t WHERE dst IN (FROM p) UNION ALL SELECT 'calls', src, dst FROM t WHERE src IN (FROM p) UNION ALL SELECT 'full_text', id, NULL FROM f WHERE len(l) > 0""",
    "graph_coupling_order": f"WITH {E}, {N}, {DEG}, c AS (SELECT id, round(least((i + o) / 20, 1.0), 4) AS coupling FROM d) SELECT id, coupling, row_number() OVER (ORDER BY coupling, id) AS place FROM c",
}

QUERIES = {f.__name__: f for f in (
    graph_named, graph_leaf_chains, graph_call_chains, graph_call_depth, graph_flows, graph_related, graph_external, graph_entities, graph_metadata, graph_full_text, graph_edges_between,
    graph_functionality, graph_strong_components, graph_coupling_order,
)}
