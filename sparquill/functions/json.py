"""Nested JSON as path-value rows, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.sources.shared import stored


def flatten(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value): the leaves of JSON strings, arrays as [k]; null leaves are ''. Empty objects and arrays are leaves.

    Each step explodes the objects and arrays that the one before has left, and writes them, so each document is
    parsed once, and there are as many steps as the deepest one has levels. Documents that don't parse have no rows.
    """
    at = stored(rows.select(key, F.lit("").alias("path"), F.try_parse_json(document).alias("v")).where("v IS NOT NULL"))
    leaves = None
    while True:
        kind = F.schema_of_variant("v")
        nested = (F.startswith(kind, F.lit("OBJECT<")) | F.startswith(kind, F.lit("ARRAY<"))) & ~F.to_json("v").isin("{}", "[]")
        own = at.where(~nested).select(key, "path", F.coalesce(F.try_variant_get("v", "$", "string"), F.when(F.is_variant_null("v"), "").otherwise(F.to_json("v"))).alias("value"))
        leaves = own if leaves is None else leaves.unionAll(own)
        inner = at.where(nested)
        if inner.isEmpty():
            return leaves
        exploded = rows.sparkSession.sql(f"SELECT t.{key}, t.path, e.pos, e.key AS k, e.value AS v FROM {{level}} t, LATERAL variant_explode(t.v) e", level=inner)
        step = F.when(F.col("k").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("k")))
        at = stored(exploded.select(key, F.concat("path", step).alias("path"), "v"))


def lower_keys(leaves: DataFrame) -> DataFrame:
    """Leaves with their paths in lower case, as if all keys had been; of paths that become equal the value of the last one by its spelling."""
    others = [c for c in leaves.columns if c not in ("path", "value")]
    return leaves.groupBy(*others, F.lower("path").alias("lower_path")).agg(F.max_by("value", "path").alias("value")).withColumnRenamed("lower_path", "path").select(*leaves.columns)


def metrics(leaves: DataFrame, key: str) -> DataFrame:
    """(key, leaves, depth, arrays, empty): counts over flattened documents."""
    deep = F.size(F.split("path", r"\."))
    return leaves.groupBy(key).agg(F.count("*").alias("leaves"), F.max(deep).alias("depth"), F.count_distinct(F.when(F.contains("path", F.lit("[")), F.regexp_extract("path", r"^([^\[]*)\[", 1))).alias("arrays"), F.count_if(F.col("value") == "").alias("empty"))


def find_all(leaves: DataFrame, name: str) -> DataFrame:
    """Leaves whose last name, without its index, is `name`, in any case."""
    return leaves.where(F.lower(F.regexp_replace(F.substring_index("path", ".", -1), r"\[\d+\]", "")) == name.lower())


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, change): added, removed, filled (was empty) or changed leaves."""
    b, a = before.select(key, "path", F.col("value").alias("b")), after.select(key, "path", F.col("value").alias("a"))
    j = b.join(a, [key, "path"], "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when((F.col("b") == "") & (F.col("a") != ""), "filled").when(F.col("a") != F.col("b"), "changed")
    return j.select(key, "path", change.alias("change")).where("change IS NOT NULL")


def similarity(fields1: Column, fields2: Column, missing1: Column, missing2: Column) -> Column:
    """0.7 times the Jaccard similarity of fields and 0.3 times that of missing ones; two empty sets are alike."""
    jaccard = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return 0.7 * jaccard(fields1, fields2) + 0.3 * jaccard(missing1, missing2)


def fingerprint(fields: Column, missing: Column) -> Column:
    """The first 16 hex digits of MD5 over sorted fields and missing marks."""
    marks = F.array_sort(F.concat(fields, F.transform(missing, lambda m: F.concat(F.lit("missing:"), m))))
    return F.substring(F.md5(F.array_join(marks, "|")), 1, 16)


def context_key(source: Column, clearing: Column, parties: Column) -> Column:
    """source|clearing|sorted names of the true entries of map parties, or none."""
    active = F.array_join(F.array_sort(F.map_keys(F.map_filter(parties, lambda k, v: v))), ",")
    return F.concat_ws("|", source, clearing, F.when(active == "", "none").otherwise(active))


def nodes(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, at, path, parent, top, name, kind, value, member): every object, array and scalar below the root of JSON strings.

    at are the places along the path, by which nodes sort as they are read; objects are read in the order of their
    keys. top is the path's first key and name the node's own, in lower case; an array's items have the name of the
    array, those of arrays in arrays none. kind is object, array, string, number, boolean or null. value is the
    text of a scalar, null for null, and the JSON of an object or array. member tells keys of objects from items.
    """
    at = stored(rows.select(key, F.array().cast("array<int>").alias("at"), F.lit("").alias("path"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("member"), F.try_parse_json(document).alias("v")).where("v IS NOT NULL"))
    found = None
    while not at.isEmpty():
        step = rows.sparkSession.sql(f"SELECT t.{key}, t.at, t.path AS parent, t.top, t.name, t.member, e.pos, e.key AS json_key, e.value AS v FROM {{level}} t, LATERAL variant_explode(t.v) e", level=at)
        own = F.lower("json_key")
        text = F.when(F.col("json_key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("parent") == "", "").otherwise("."), F.col("json_key")))
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        kind = F.when(kind == "VOID", "null").when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
        level = stored(step.select(
            key, F.concat("at", F.array(F.col("pos"))).alias("at"), F.concat("parent", text).alias("path"), "parent", F.coalesce("top", own).alias("top"),
            F.when(F.col("json_key").isNotNull(), own).when(F.col("member"), F.col("name")).alias("name"), F.col("json_key").isNotNull().alias("member"), kind.alias("kind"), "v",
        ))
        value = F.when(F.col("kind").isin("object", "array"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
        part = level.select(key, "at", "path", "parent", "top", "name", "kind", value.alias("value"), "member")
        found = part if found is None else found.unionAll(part)
        at = level.where("kind IN ('object', 'array')").select(key, "at", "path", "top", "name", "member", "v")
    return found if found is not None else rows.sparkSession.createDataFrame([], rows.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">") + ", at array<int>, path string, parent string, top string, name string, kind string, value string, member boolean")


def rebuilt(leaves: DataFrame, key: str) -> DataFrame:
    """(key, document): nested JSON from rows (key, path, value), where a path is an array of keys and value is JSON.

    Objects are put together from the deepest level up, their keys in order. Of rows with one path the value that is
    the greatest stays; a row on the way to a deeper one is left out.
    """
    level = stored(leaves.groupBy(key, "path").agg(F.max("value").alias("value")))
    deepest = level.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        here, others = level.where(F.size("path") == depth), level.where(F.size("path") < depth)
        member = F.struct(F.element_at("path", -1).alias("name"), "value")
        joined = F.transform(F.array_sort(F.collect_list(member)), lambda m: F.concat(F.to_json(F.array(m["name"])).substr(F.lit(2), F.length(F.to_json(F.array(m["name"]))) - 2), F.lit(":"), m["value"]))
        objects = here.groupBy(key, F.slice("path", 1, depth - 1).alias("path")).agg(F.concat(F.lit("{"), F.array_join(joined, ","), F.lit("}")).alias("value"))
        others = others.join(objects.select(key, "path"), [key, "path"], "left_anti")
        level = stored(others.unionByName(objects))
    return level.where(F.size("path") == 0).select(key, F.col("value").alias("document"))


def moves(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, name, from_path, to_path): subtrees that two tables of nodes() have at different paths under one name.

    A subtree that stays where it was does not count, nor does one whose parent moves with it. Equal subtrees pair in
    the order they are read.
    """
    def lone(some: DataFrame, other: DataFrame) -> DataFrame:
        gone = some.where("member").join(other.select(key, "path").hint("merge"), [key, "path"], "left_anti")  # never broadcast: all nodes
        rank = Window.partitionBy(key, "name", "kind", "value").orderBy("at")
        return gone.select(key, "name", "kind", F.coalesce("value", F.lit("")).alias("value"), "path", "parent", F.row_number().over(rank).alias("nr"))

    b, a = lone(before, after), lone(after, before)
    on = [key, "name", "kind", "value", "nr"]
    met = stored(b.withColumnsRenamed({"path": "from_path", "parent": "from_parent"}).hint("merge").join(a.withColumnsRenamed({"path": "to_path", "parent": "to_parent"}), on))
    above = met.select(key, F.col("from_path").alias("from_parent"), F.col("to_path").alias("to_parent"))
    return met.join(above.hint("merge"), [key, "from_parent", "to_parent"], "left_anti").select(key, "name", "from_path", "to_path")
