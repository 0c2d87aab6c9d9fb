"""Property graphs as two tables: nodes (id, type, name, ...) and edges (src, dst, type, ...).

Traversals go level by level: a frontier joins the edges, leaves out what was seen (anti-join), and is written to
the shared folder, so a plan never grows with the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.ranks import first_of
from sparquill.sources.shared import stored


def entity_id(kind: Column, qualified_name: Column, path: Column) -> Column:
    """The first 16 hex digits of SHA-256 over type:qualified name:path."""
    return F.substring(F.sha2(F.concat_ws(":", kind, qualified_name, F.coalesce(path, F.lit(""))), 256), 1, 16)


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an ordinal."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (src, dst, type), with the number of its repeats."""
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, ids: list, direction: str = "both", kind: str | None = None) -> DataFrame:
    """(id, neighbour) of some nodes, each once."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    out = e.where(F.col("src").isin(ids)).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    into = e.where(F.col("dst").isin(ids)).select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    return {"out": out, "in": into, "both": out.unionAll(into)}[direction].distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of all nodes, in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by type; and the average degree times a thousand, rounded."""
    by_node = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.col("type").alias("kind"), "n")
    by_edge = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.col("type").alias("kind"), "n")
    n, m = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    degree = n.join(m).select(F.lit("degree"), F.lit("average_x1000"), F.round(2000.0 * F.col("m") / F.greatest("n", F.lit(1))).cast("long"))
    return by_node.unionAll(by_edge).unionAll(degree)


def common_targets(edges: DataFrame, least: int = 5, samples: int = 10) -> DataFrame:
    """(dst, callers, samples): targets with at least so many incoming edges, repeats counted; their first distinct sources."""
    pairs = edges.groupBy("dst", "src").agg(F.count("*").alias("k"))
    callers = pairs.groupBy("dst").agg(F.sum("k").alias("callers")).where(F.col("callers") >= least)
    return callers.join(first_of(pairs, "dst", "src", samples, "samples"), "dst").select("dst", "callers", "samples")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coupling, band, complexity): min((in + out) / 20, 1); bands at 0.3 and 0.7; complexity by degrees."""
    d = degrees(nodes, edges)
    c = F.least((F.col("in_degree") + F.col("out_degree")) / 20, F.lit(1.0))
    band = F.when(c > 0.7, "high").when(c > 0.3, "medium").otherwise("low")
    complexity = F.when((F.col("out_degree") > 10) | (F.col("in_degree") > 20), "high").when((F.col("out_degree") > 5) | (F.col("in_degree") > 10), "medium").otherwise("low")
    return d.select("id", F.round(c, 4).alias("coupling"), band.alias("band"), complexity.alias("complexity"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept ids."""
    ids = kept.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", exclude: list | None = None) -> DataFrame:
    """(id, depth): nodes within `depth` steps of the starts (id), with the fewest steps. Excluded nodes are not entered; starts stay."""
    both = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    steps = None
    for a, b in both:
        own = edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
        steps = own if steps is None else steps.unionAll(own)
    steps = steps.distinct()
    if exclude:
        steps = steps.where(~F.col("to").isin(exclude))
    seen = stored(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        new = frontier.select("id").join(steps, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def simple_paths(edges: DataFrame, start, end, most: int) -> DataFrame:
    """(path): all paths without a repeated node from start to end of at most so many edges."""
    steps = edges.select("src", "dst").distinct()
    paths = steps.where(F.col("src") == start).select(F.array("src", "dst").alias("path")).where(F.col("path")[0] != F.col("path")[1])
    done = paths.where(F.element_at("path", -1) == end)
    for _ in range(most - 1):
        open_ends = paths.where(F.element_at("path", -1) != end)
        paths = stored(open_ends.withColumn("src", F.element_at("path", -1)).join(steps, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        done = done.unionAll(paths.where(F.element_at("path", -1) == end))
    return done


def entry_distance(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(id, distance) to the nearest node that nothing points to; 999 if none within depth."""
    entries = nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    near = reach(edges, entries, depth)
    return nodes.select("id").join(near, "id", "left").select("id", F.coalesce("depth", F.lit(999)).alias("distance"))


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, n, targets): each source's distinct targets in order."""
    return edges.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))


def merge_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of nodes (id, type, name, value, tags): b's value wins unless it is null or empty, a's type and name; tags are united."""
    filled = lambda c: F.when((c == "") | c.isNull(), F.lit(None)).otherwise(c)
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, F.col("x.id") == F.col("y.id"), "full")
    none = F.array().cast("array<string>")
    origin = F.when(F.col("y.id").isNull(), "first").when(F.col("x.id").isNull(), "second").otherwise("both")
    first = lambda c: F.coalesce(filled(F.col(f"x.{c}")), F.col(f"y.{c}"))
    return j.select(F.coalesce("x.id", "y.id").alias("id"), first("type").alias("type"), first("name").alias("name"), F.coalesce(filled(F.col("y.value")), F.col("x.value")).alias("value"), F.array_sort(F.array_union(F.coalesce("x.tags", none), F.coalesce("y.tags", none))).alias("tags"), origin.alias("origin"))


def merge_edges(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, weight, copies): both edge lists without orphans; the first list's weight stands."""
    every = a.select("src", "dst", "type", "weight", F.lit(0).alias("k")).unionAll(b.select("src", "dst", "type", "weight", F.lit(1).alias("k")))
    return induced(every, nodes).groupBy("src", "dst", "type").agg(F.min_by("weight", F.struct("k", "weight")).alias("weight"), F.count("*").alias("copies"))


def resolve_external(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placeholders (is_external) are replaced by the first real node of their name: (nodes left, edges remapped, each once)."""
    real = nodes.where("NOT is_external").groupBy("name").agg(F.min("id").alias("real_id"))
    moved = nodes.where("is_external").join(real, "name").select("id", "real_id")
    left = nodes.join(moved, "id", "left_anti")
    to = lambda c: moved.select(F.col("id").alias(c), F.col("real_id").alias(f"new_{c}"))
    e = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    return left, e.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "type").distinct()


def resolve_calls(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """(caller, target, resolved): calls (caller, callee) by name; those without a procedure point to external::name."""
    p = procedures.groupBy("name").agg(F.min("id").alias("id"))
    j = calls.join(p, calls.callee == p.name, "left")
    return j.select("caller", F.coalesce("id", F.concat(F.lit("external::"), "callee")).alias("target"), F.col("id").isNotNull().alias("resolved"))


def parent_name(qualified: Column) -> Column:
    """a::b of a::b::c; null at the top."""
    parts = F.split(qualified, "::")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::"))


def directories(paths: DataFrame) -> DataFrame:
    """(parent, child): CONTAINS edges of all folders on the way to each path."""
    parts = F.split("path", "/")
    at = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("k"))
    join = lambda n: F.array_join(F.slice("p", F.lit(1), n), "/")
    return at.select(join(F.col("k") - 1).alias("parent"), join(F.col("k")).alias("child")).distinct()


def for_display(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most so many nodes, 80 % of them procedures, by degree; and the edges between them."""
    ranked = nodes.where(~F.col("type").isin("file", "variable")).join(degrees(nodes, edges), "id").withColumn("main", F.col("type") == "procedure")
    place = F.row_number().over(Window.partitionBy("main").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "id"))
    quota = F.when(F.col("main"), int(most * 0.8)).otherwise(most - int(most * 0.8))
    kept = ranked.withColumn("place", place).where(F.col("place") <= quota)
    return kept.select("id", "type"), induced(edges, kept)


def named(nodes: DataFrame, names: list[str], kind: str = "procedure") -> DataFrame:
    """(asked, id, name): nodes of a kind with each name asked for; for a name that none has, those that contain it, in any case."""
    asked = nodes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
    own = nodes.where(F.col("type") == kind).select("id", "name")
    exact = own.where(F.col("name").isin(names)).select(F.col("name").alias("asked"), "id", "name")
    # The names are a literal list, so partial ones are found in one scan, without a join.
    partial = own.select(F.explode(F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(n.lower())), F.lit(n)) for n in dict.fromkeys(names)]))).alias("asked"), "id", "name")
    return exact.unionAll(partial.join(F.broadcast(asked.join(exact.select("asked").distinct(), "asked", "left_anti")), "asked", "left_semi"))


def leaf_chains(edges: DataFrame, starts: list, exclude: list | None = None, most_edges: int = 5, n: int = 10) -> DataFrame:
    """(path): the first n paths from the starts to nodes that call nothing, over more than two nodes, in the order of a
    depth-first search: by start, then by callee at each step. Excluded nodes end a search, as do nodes on the path.
    """
    steps = edges.select("src", "dst").distinct()
    calling = steps.select(F.col("src").alias("id")).distinct().withColumn("calls", F.lit(True))
    allowed = lambda c: ~c.isin(exclude) if exclude else F.lit(True)
    spark = edges.sparkSession
    paths = spark.createDataFrame([(k, [s]) for k, s in enumerate(starts)], f"start int, path array<{edges.schema['src'].dataType.simpleString()}>").where(allowed(F.get("path", F.lit(0))))
    done = None
    for k in range(most_edges):
        nxt = paths.withColumn("src", F.element_at("path", -1)).join(steps, "src").where(~F.array_contains("path", F.col("dst")) & allowed(F.col("dst")))
        paths = stored(nxt.select("start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id")).join(calling, "id", "left").drop("id"))
        own = paths.where("calls IS NULL AND size(path) > 2").select("start", "path")
        done = own if done is None else done.unionAll(own)
        paths = paths.where("calls").select("start", "path")
    return done.orderBy("start", "path").limit(n).select("path")


def call_chains(edges: DataFrame, start, most: int = 3) -> DataFrame:
    """(chain): all chains of one to most + 1 calls from a node; nodes may repeat."""
    steps = edges.select("src", "dst").distinct()
    chains = steps.where(F.col("src") == start).select(F.array("src", "dst").alias("chain"))
    every = chains
    for _ in range(most):
        chains = stored(chains.withColumn("src", F.element_at("chain", -1)).join(steps, "src").select(F.concat("chain", F.array("dst")).alias("chain")))
        every = every.unionAll(chains)
    return every


def call_depth(edges: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(start, depth): the length of the longest chain of calls from each start (id), at most `most`."""
    steps = edges.select("src", "dst").distinct()
    ends = starts.select(F.col("id").alias("start"), F.col("id").alias("end")).distinct()
    found = ends.select("start", F.lit(0).alias("depth"))
    for k in range(1, most + 1):
        ends = stored(ends.join(steps, F.col("end") == F.col("src")).select("start", F.col("dst").alias("end")).distinct())
        found = found.unionAll(ends.select("start", F.lit(k).alias("depth")).distinct())
    return found.groupBy("start").agg(F.max("depth").alias("depth"))


def process_flows(nodes: DataFrame, edges: DataFrame, entries: int = 10, steps: int = 20, least: int = 3) -> DataFrame:
    """(entry, id, place, depth, decision): for the first nodes with at most two callers and three callees or more, what a
    breadth-first search meets first; flows of `least` steps or more. decision: more than two callees.
    """
    pairs = edges.select("src", "dst").distinct()
    d = degrees(nodes, pairs)
    first = d.where("in_degree <= 2 AND out_degree >= 3").orderBy("id").limit(entries)
    seen = stored(first.select(F.col("id").alias("entry"), "id", F.lit(1).alias("place"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, steps):
        met = frontier.join(pairs, F.col("id") == F.col("src")).groupBy("entry", F.col("dst").alias("id")).agg(F.min("place").alias("from_place"))
        new = met.join(seen.select("entry", "id"), ["entry", "id"], "left_anti").join(seen.groupBy("entry").agg(F.count("*").alias("had")), "entry")
        order = Window.partitionBy("entry").orderBy("from_place", "id")  # an entry has at most `steps` rows of a level's callers
        frontier = stored(new.select("entry", "id", (F.col("had") + F.row_number().over(order)).cast("int").alias("place"), F.lit(depth).alias("depth")).where(F.col("place") <= steps))
        if frontier.isEmpty():
            break
        seen = stored(seen.unionAll(frontier))
    long_ones = seen.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entry")
    return seen.join(long_ones, "entry").join(d.select("id", (F.col("out_degree") > 2).alias("decision")), "id").select("entry", "id", "place", "depth", "decision")


def related(nodes: DataFrame, edges: DataFrame, source, n: int = 10) -> DataFrame:
    """(id, score): the n nodes (id, file, capabilities, keywords) most related to one: three points for each shared
    capability, half for each keyword, five as its callee, five as its caller, one for the same file.
    """
    own = nodes.where(F.col("id") == source).select(F.col("file").alias("f"), F.col("capabilities").alias("c"), F.col("keywords").alias("k")).limit(1)
    ends = edges.where((F.col("src") == source) | (F.col("dst") == source)).select(F.when(F.col("src") == source, F.col("dst")).otherwise(F.col("src")).alias("id"), (F.col("src") == source).alias("out"))
    calls = ends.groupBy("id").agg((F.max(F.col("out").cast("int")) + F.max((~F.col("out")).cast("int"))).alias("calls"))
    j = nodes.where(F.col("id") != source).join(F.broadcast(own)).join(calls, "id", "left")  # own is one row
    score = 3.0 * F.size(F.array_intersect("capabilities", "c")) + 0.5 * F.size(F.array_intersect("keywords", "k")) + 5 * F.coalesce("calls", F.lit(0)) + (F.col("file") == F.col("f")).cast("int")
    return j.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)


def external_dependencies(nodes: DataFrame, edges: DataFrame, procedures: DataFrame) -> DataFrame:
    """(name, called_by): external nodes (id, name, external) that some procedures (id, name) call, with the first caller."""
    calls = edges.where("type = 'calls'").select("src", "dst").distinct()
    outside = nodes.where("external").select(F.col("id").alias("dst"), F.col("name").alias("name"))
    own = procedures.select(F.col("id").alias("src"), F.col("name").alias("caller"))
    return calls.join(own, "src").join(outside, "dst").groupBy("name").agg(F.min_by("caller", F.struct("src", "dst")).alias("called_by"))


def entities(nodes: DataFrame, kind: str | None = None, /, **equal) -> DataFrame:
    """Nodes of a kind for which each name is a column, or a key of the map `metadata`, of that value."""
    out = nodes if kind is None else nodes.where(F.col("type") == kind)
    for name, value in equal.items():
        in_map = F.try_element_at("metadata", F.lit(name)).eqNullSafe(str(value))
        out = out.where(in_map | F.col(name).eqNullSafe(value) if name in nodes.columns else in_map)
    return out


def with_metadata(nodes: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Nodes whose map `metadata` has a key, with a value if one is given."""
    return nodes.where(F.map_contains_key("metadata", key) if value is None else F.try_element_at("metadata", F.lit(key)).eqNullSafe(value))


def full_text(nodes: DataFrame, term: str) -> DataFrame:
    """(id, fields, match_count): nodes whose name, qualified name or metadata values contain a term, in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    own = F.array_compact(F.array(*[F.when(has(F.col(c)), F.lit(c)) for c in ("name", "qualified_name")]))
    more = F.transform(F.filter(F.map_entries("metadata"), lambda e: has(e["value"])), lambda e: F.concat(F.lit("metadata."), e["key"]))
    fields = F.concat(own, F.array_sort(more))
    return nodes.select("id", fields.alias("fields"), F.size(fields).alias("match_count")).where("match_count > 0")


def edges_between(edges: DataFrame, src=None, dst=None, kind: str | None = None) -> DataFrame:
    """Edges with the ends and the type that are given."""
    for column, value in (("src", src), ("dst", dst), ("type", kind)):
        edges = edges if value is None else edges.where(F.col(column) == value)
    return edges


def functionality(nodes: DataFrame, edges: DataFrame, term: str) -> DataFrame:
    """(part, id, other): nodes whose name contains a term, by type; callers and callees of such procedures; full-text hits."""
    by_name = nodes.where(F.contains(F.lower("name"), F.lit(term.lower())))
    found = by_name.where(F.col("type").isin("procedure", "variable", "structure")).select(F.col("type").alias("part"), "id", F.lit(None).cast(nodes.schema["id"].dataType).alias("other"))
    own = by_name.where("type = 'procedure'").select("id")
    calls = edges.where("type = 'calls'").select("src", "dst").distinct()
    called_by = calls.join(own.withColumnRenamed("id", "dst"), "dst").select(F.lit("called_by").alias("part"), F.col("dst").alias("id"), F.col("src").alias("other"))
    callees = calls.join(own.withColumnRenamed("id", "src"), "src").select(F.lit("calls").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"))
    text_hits = full_text(nodes, term).select(F.lit("full_text").alias("part"), "id", F.lit(None).cast(nodes.schema["id"].dataType).alias("other"))
    return found.unionAll(called_by).unionAll(callees).unionAll(text_hits)


def _spread(values: DataFrame, steps: DataFrame) -> DataFrame:
    """values (id, v) after each node has taken the least v of all nodes that reach it along steps (src, dst).

    Stored ids and values pack into small files, so Spark would broadcast them through the driver in every round: joins are marked for merging.
    """
    now = stored(values)
    while True:
        met = steps.join(now.hint("merge"), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "v")
        new = stored(now.unionAll(met).groupBy("id").agg(F.min("v").alias("v")))
        if now.join(new.withColumnRenamed("v", "w").hint("merge"), "id").where("v <> w").isEmpty():
            return new
        now = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes on cycles: strongly connected groups of two nodes or more, named by a member.

    Nodes without a caller or a callee are trimmed. Then each node takes the least node that reaches it as its
    colour, and what can reach that node within the colour is its group; the rest goes round again. Only the edges
    are joined, and what is left shrinks with every round.
    """
    left = stored(edges.where("src <> dst").select("src", "dst").distinct())
    groups = None
    while not left.isEmpty():
        while True:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi")
            inner = stored(inner.select("src", "dst"))
            if inner.count() == left.count():
                break
            left = inner
        if left.isEmpty():
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = _spread(nodes.withColumn("v", F.col("id")), left)
        same = left.join(colour.select(F.col("id").alias("src"), F.col("v").alias("a")).hint("merge"), "src").join(colour.select(F.col("id").alias("dst"), F.col("v").alias("b")).hint("merge"), "dst").where("a = b")
        # Backwards within a colour from its root: all that the root's value reaches against the edges.
        marked = _spread(colour.select("id", F.when(F.col("id") == F.col("v"), 0).otherwise(1).alias("v")), same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        group = stored(marked.where("v = 0").select("id").join(colour.hint("merge"), "id").select("id", F.col("v").alias("component")))
        groups = group if groups is None else groups.unionAll(group)
        gone = group.select("id")
        left = stored(left.join(gone.withColumnRenamed("id", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst").hint("merge"), "dst", "left_anti").select("src", "dst"))
    if groups is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return groups.join(sizes.hint("merge"), "component").select("id", "component")


def coupling_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coupling, place): nodes from the least coupled one on, ties by id; the places come from counts of each coupling value, so no
    window holds all nodes.
    """
    c = coupling(nodes, edges).select("id", "coupling")
    before = Window.orderBy("coupling").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of the few coupling values
    base = c.groupBy("coupling").agg(F.count("*").alias("n")).select("coupling", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("coupling").orderBy("id"))
    return c.withColumn("inner", inner).join(F.broadcast(base), "coupling").select("id", "coupling", (F.col("base") + F.col("inner")).alias("place"))
