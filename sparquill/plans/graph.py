"""Graph queries: parts are nodes; consecutive lines of an order are edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparquill.operators import graph as op
from sparquill.sources.tables import table


def _nodes(spark, d):
    kind = F.when(F.col("p_size") < 10, "variable").when(F.col("p_size") < 20, "structure").otherwise("procedure")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("name"))


def _edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("src"), F.col("l_returnflag"), F.col("l_partkey"))
    nxt = lines.select("src", F.lead("l_partkey").over(w).alias("dst"), F.when(F.col("l_returnflag") == "N", "calls").otherwise("uses").alias("type"))
    return nxt.where("dst IS NOT NULL")


def _downward(spark, d):
    """The same edges from the smaller part to the larger one, so that they have no cycles."""
    e = _edges(spark, d)
    return e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "type")


E = """e AS (SELECT src, dst, type FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, CASE WHEN l_returnflag = 'N' THEN 'calls' ELSE 'uses' END AS type FROM lineitem) WHERE dst IS NOT NULL)"""
N = "n AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'variable' WHEN p_size < 20 THEN 'structure' ELSE 'procedure' END AS type, p_name AS name FROM part)"
DEG = "d AS (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM n LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id))"


def graph_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", op.entity_id(F.lit("part"), F.col("p_name"), F.col("p_brand")).alias("entity_id"))


def graph_distinct_edges(spark, d):
    return op.distinct_edges(_edges(spark, d))


def graph_upsert(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_quantity", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("nr"), F.col("l_suppkey"))
    return op.upsert(rows.groupBy("l_partkey", "nr").agg(F.max("l_quantity").alias("quantity")), "l_partkey", "nr")


def graph_neighbours(spark, d):
    return op.neighbours(_edges(spark, d), [1, 2, 3], "both")


def graph_callees(spark, d):
    return op.neighbours(_edges(spark, d), list(range(10)), "out", "calls")


def graph_statistics(spark, d):
    return op.statistics(_nodes(spark, d), _edges(spark, d))


def graph_common(spark, d):
    return op.common_targets(_edges(spark, d), 25).select("dst", "callers", F.array_join("samples", ",").alias("samples"))


def graph_coupling(spark, d):
    return op.coupling(_nodes(spark, d), _edges(spark, d))


def graph_induced(spark, d):
    return op.induced(_edges(spark, d), _nodes(spark, d).where("type = 'structure'")).groupBy("src").agg(F.count("*").alias("n"))


def graph_reach(spark, d):
    start = spark.createDataFrame([(1,), (2,)], "id long")
    return op.reach(_edges(spark, d), start, 3, "out", [5, 7, 9])


def graph_impact(spark, d):
    start = spark.createDataFrame([(3,)], "id long")
    return op.reach(_edges(spark, d), start, 2, "in").where("depth > 0").select("id", (F.col("depth") > 1).alias("indirect"))


def graph_vicinity(spark, d):
    return op.reach(_edges(spark, d), spark.createDataFrame([(11,)], "id long"), 2, "both")


def graph_paths(spark, d):
    return op.simple_paths(_edges(spark, d), 1, 2, 3).select(F.array_join("path", ">").alias("path"))


def graph_entry_distance(spark, d):
    return op.entry_distance(_nodes(spark, d), _downward(spark, d), 4).groupBy("distance").agg(F.count("*").alias("n"))


def graph_unreferenced(spark, d):
    return op.unreferenced(_nodes(spark, d), _downward(spark, d).where("type = 'calls'"))


def graph_adjacency(spark, d):
    return op.adjacency(_edges(spark, d))


def _sides(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), "p_brand", "p_size")
    a = p.where("id % 3 <> 0").select("id", "type", "name", F.col("p_brand").alias("value"), F.array("type").alias("tags"))
    b = p.where("id % 2 = 0").select("id", F.lit("x").alias("type"), F.lit("").alias("name"), F.when(F.col("id") % 5 == 0, "").otherwise(F.col("p_size").cast("string")).alias("value"), F.array(F.lit("b"), F.col("type")).alias("tags"))
    return a, b


def graph_merge_nodes(spark, d):
    return op.merge_nodes(*_sides(spark, d)).withColumn("tags", F.array_join("tags", ","))


def graph_merge_edges(spark, d):
    e = _edges(spark, d)
    a = e.where("type = 'calls'").withColumn("weight", F.lit(1.0))
    b = e.where("src % 2 = 0").withColumn("weight", F.lit(2.0))
    return op.merge_edges(a, b, _nodes(spark, d).where("type <> 'variable'"))


def graph_resolve_external(spark, d):
    nodes = _nodes(spark, d).select("id", "name", (F.col("id") % 4 == 3).alias("is_external"))
    _, edges = op.resolve_external(nodes, _edges(spark, d))
    return edges


def graph_resolve_calls(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("caller"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("callee"))
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return op.resolve_calls(calls, c).groupBy("resolved").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


def graph_parents(spark, d):
    q = table(spark, d, "part").select(F.concat_ws("::", "p_type", "p_brand", "p_name").alias("q"))
    return q.groupBy(op.parent_name(F.col("q")).alias("parent")).agg(F.count("*").alias("n"))


def graph_directories(spark, d):
    return op.directories(table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")))


def graph_display(spark, d):
    return op.for_display(_nodes(spark, d), _edges(spark, d), 50)[0]


RECURSE = "WITH RECURSIVE {e}, r(id, depth) AS (SELECT * FROM (VALUES {start}) UNION SELECT s.t, r.depth + 1 FROM r JOIN ({steps}) s ON s.f = r.id WHERE r.depth < {depth}{extra}), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"
SQL = {
    "graph_ids": "SELECT p_partkey, left(sha256('part:' || p_name || ':' || p_brand), 16) AS entity_id FROM part",
    "graph_distinct_edges": f"WITH {E} SELECT src, dst, type, count(*) AS n FROM e GROUP BY ALL",
    "graph_upsert": "WITH x AS (SELECT l_partkey, l_orderkey * 100 + l_linenumber AS nr, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT l_partkey, max(nr) AS nr, arg_max(quantity, nr) AS quantity FROM x GROUP BY 1",
    "graph_neighbours": f"WITH {E} SELECT DISTINCT src AS id, dst AS neighbour FROM e WHERE src IN (1, 2, 3) UNION SELECT dst, src FROM e WHERE dst IN (1, 2, 3)",
    "graph_callees": f"WITH {E} SELECT DISTINCT src AS id, dst AS neighbour FROM e WHERE src < 10 AND type = 'calls'",
    "graph_statistics": f"WITH {E}, {N} SELECT 'node' AS what, type AS kind, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'degree', 'average_x1000', CAST(round(2000.0 * (SELECT count(*) FROM e) / greatest((SELECT count(*) FROM n), 1)) AS BIGINT)",
    "graph_common": f"WITH {E} SELECT dst, count(*) AS callers, array_to_string(list_sort(list_distinct(list(src)))[1:10], ',') AS samples FROM e GROUP BY 1 HAVING count(*) >= 25",
    "graph_coupling": f"WITH {E}, {N}, {DEG} SELECT id, round(least((i + o) / 20, 1.0), 4) AS coupling, CASE WHEN least((i + o) / 20, 1.0) > 0.7 THEN 'high' WHEN least((i + o) / 20, 1.0) > 0.3 THEN 'medium' ELSE 'low' END AS band, CASE WHEN o > 10 OR i > 20 THEN 'high' WHEN o > 5 OR i > 10 THEN 'medium' ELSE 'low' END AS complexity FROM d",
    "graph_induced": f"WITH {E}, {N}, k AS (SELECT id FROM n WHERE type = 'structure') SELECT src, count(*) AS n FROM e WHERE src IN (FROM k) AND dst IN (FROM k) GROUP BY 1",
    "graph_reach": RECURSE.format(e=E, start="(1, 0), (2, 0)", steps="SELECT DISTINCT src AS f, dst AS t FROM e WHERE dst NOT IN (5, 7, 9)", depth=3, extra="") + " SELECT id, depth FROM m",
    "graph_impact": RECURSE.format(e=E, start="(3, 0)", steps="SELECT DISTINCT dst AS f, src AS t FROM e", depth=2, extra="") + " SELECT id, depth > 1 AS indirect FROM m WHERE depth > 0",
    "graph_vicinity": RECURSE.format(e=E, start="(11, 0)", steps="SELECT src AS f, dst AS t FROM e UNION SELECT dst, src FROM e", depth=2, extra="") + " SELECT id, depth FROM m",
    "graph_paths": f"WITH {E}, s AS (SELECT DISTINCT src, dst FROM e), p1 AS (SELECT [src, dst] AS p FROM s WHERE src = 1 AND dst <> 1), p2 AS (SELECT list_append(p, dst) AS p FROM p1 JOIN s ON src = p[-1] WHERE p[-1] <> 2 AND NOT list_contains(p, dst)), p3 AS (SELECT list_append(p, dst) AS p FROM p2 JOIN s ON src = p[-1] WHERE p[-1] <> 2 AND NOT list_contains(p, dst)) SELECT array_to_string(p, '>') AS path FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) WHERE p[-1] = 2",
    "graph_entry_distance": f"WITH RECURSIVE {E}, {N}, k AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst), r(id, depth) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT dst FROM k) UNION SELECT k.dst, r.depth + 1 FROM r JOIN k ON k.src = r.id WHERE r.depth < 4), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT coalesce(depth, 999) AS distance, count(*) AS n FROM n LEFT JOIN m USING (id) GROUP BY 1",
    "graph_unreferenced": f"WITH {E}, {N} SELECT id FROM n WHERE id NOT IN (SELECT greatest(src, dst) FROM e WHERE type = 'calls' AND src <> dst)",
    "graph_adjacency": f"WITH {E} SELECT src, count(DISTINCT dst) AS n, array_to_string(list_sort(list_distinct(list(dst))), ',') AS targets FROM e GROUP BY 1",
    "graph_merge_nodes": """WITH a AS (SELECT p_partkey AS id, p_type AS type, p_name AS name, p_brand AS value FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS id, p_type AS ptype, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS value FROM part WHERE p_partkey % 2 = 0)
      SELECT coalesce(a.id, b.id) AS id, coalesce(type, 'x') AS type, coalesce(name, '') AS name, CASE WHEN b.value IS NULL OR b.value = '' THEN a.value ELSE b.value END AS value,
        array_to_string(list_sort(list_distinct(list_filter([type, CASE WHEN b.id IS NOT NULL THEN 'b' END, ptype], lambda x: x IS NOT NULL))), ',') AS tags,
        CASE WHEN b.id IS NULL THEN 'first' WHEN a.id IS NULL THEN 'second' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.id = b.id""",
    "graph_merge_edges": f"WITH {E}, {N}, k AS (SELECT id FROM n WHERE type <> 'variable'), x AS (SELECT *, 1.0 AS w FROM e WHERE type = 'calls' UNION ALL SELECT *, 2.0 FROM e WHERE src % 2 = 0) SELECT src, dst, type, CAST(min(w) AS DOUBLE) AS weight, count(*) AS copies FROM x WHERE src IN (FROM k) AND dst IN (FROM k) GROUP BY 1, 2, 3",
    "graph_resolve_external": f"WITH {E}, {N}, r AS (SELECT name, min(id) AS real FROM n WHERE id % 4 <> 3 GROUP BY 1), m AS (SELECT id, real FROM n JOIN r USING (name) WHERE id % 4 = 3) SELECT DISTINCT coalesce(a.real, src) AS src, coalesce(b.real, dst) AS dst, type FROM e LEFT JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst",
    "graph_resolve_calls": "WITH x AS (SELECT 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS callee FROM orders), j AS (SELECT callee, c_custkey FROM x LEFT JOIN customer ON c_name = callee) SELECT c_custkey IS NOT NULL AS resolved, count(*) AS n, count(DISTINCT callee) AS targets FROM j GROUP BY 1",
    "graph_parents": "SELECT p_type || '::' || p_brand AS parent, count(*) AS n FROM part GROUP BY 1",
    "graph_directories": "SELECT DISTINCT p_type AS parent, p_type || '/' || p_brand AS child FROM part UNION SELECT p_type || '/' || p_brand, p_type || '/' || p_brand || '/' || p_name FROM part",
    "graph_display": f"WITH {E}, {N}, {DEG}, r AS (SELECT id, type, row_number() OVER (PARTITION BY type = 'procedure' ORDER BY i + o DESC, id) AS k FROM n JOIN d USING (id) WHERE type NOT IN ('file', 'variable')) SELECT id, type FROM r WHERE k <= CASE WHEN type = 'procedure' THEN 40 ELSE 10 END",
}

QUERIES = {f.__name__: f for f in (
    graph_ids, graph_distinct_edges, graph_upsert, graph_neighbours, graph_callees, graph_statistics, graph_common, graph_coupling, graph_induced, graph_reach, graph_impact, graph_vicinity, graph_paths,
    graph_entry_distance, graph_unreferenced, graph_adjacency, graph_merge_nodes, graph_merge_edges, graph_resolve_external, graph_resolve_calls, graph_parents, graph_directories, graph_display,
)}
