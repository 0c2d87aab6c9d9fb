"""Document fingerprints: weighted SimHash and permuted block tables, in built-in functions only.

Terms are pairs of neighbouring words (A-Z lower-cased), each weighing as many votes as it has characters, 16 at
most, so that pairs of short common words count little. A text of one word has that word as its term; one
without words has fingerprint 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.common import lower_ascii, read, row_key, stored, text_of, words
from sparquill.llm.votes import hex64, likeness, simhash

MOST_WEIGHT = 16
NEIGHBOURS = 9  # bits of a doc_id within a group of neighbours: up to 512 ids
NO_ID = 1 << 60  # groups of rows without an id, after all others


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys (distinct in texts) and the long `fingerprint` of each text. Whole texts vote; null is empty."""
    w = F.col("w")
    n = F.size(w)
    kind = "array<struct<a:string,b:string>>"
    pairs = F.arrays_zip(F.slice(w, 1, n - 1).alias("a"), F.slice(w, 2, n - 1).alias("b")).cast(kind)
    single = F.array(F.struct(F.get(w, F.lit(0)).alias("a"), F.lit(None).cast("string").alias("b"))).cast(kind)
    rows = texts.select(*keys, words(lower_ascii(text_of(text))).alias("w"))
    rows = rows.select(*keys, F.inline_outer(F.when(n > 1, pairs).when(n == 1, single)).alias("a", "b"))
    weight = F.least(F.lit(MOST_WEIGHT), F.length("a") + F.coalesce(F.length("b"), F.lit(0)))
    hashed = F.when(F.col("a").isNotNull(), F.xxhash64("a", "b"))
    return simhash(rows.select(*keys, hashed.alias("h"), weight.alias("weight")), keys, weight="weight")


def successors(keys: DataFrame) -> DataFrame:
    """(key, next) for the distinct longs `key`: the next larger one; after the largest, the smallest.

    Range-partitioned, so that only one row of each partition meets the others'.
    """
    ranged = stored(keys.select("key").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min("key").alias("low"))
    every = Window.orderBy("low")  # a row for each partition
    whole = Window.partitionBy()
    first = first.select("part", F.coalesce(F.lead("low").over(every), F.min("low").over(whole)).alias("after"))
    inner = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("next", inner).join(first, "part").select("key", F.coalesce("next", "after").alias("next"))


def neighbour_groups(doc_id: Column, text: Column) -> Column:
    """A long that grows with doc_id; up to 512 ids share one, so no group holds many rows."""
    # The last choice never applies; it tells Spark that there is no null to filter, so that both readers of the shuffle share it.
    return F.coalesce(F.shiftright(doc_id.cast("long"), NEIGHBOURS), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 20)), F.lit(NO_ID))


def edited(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, next_row and edited of each row of docs (doc_id, text).

    edited: the last quarter of the text's code points, rounded down, replaced by the first as many (or all) of
    the next row's. Rows are in ascending order of doc_id, then text; rows without id come last, by hash of
    their text; the first row follows the last one. Texts are shuffled once: to groups of neighbouring ids.
    """
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), row_key().alias("row"), neighbour_groups(F.col("doc_id"), text).alias("near"))
    rows = rows.repartition("near")
    group = Window.partitionBy("near").orderBy(F.col("doc_id").asc_nulls_last(), "text", "row")
    inner = rows.select("near", "doc_id", "row", "text", F.lead("row").over(group).alias("next_row"), F.lead("text").over(group).alias("next_text"))
    heads = rows.select("near", "row", "text", F.row_number().over(group).alias("rank")).where("rank = 1")
    after = successors(docs.select(neighbour_groups(F.col("doc_id"), text).alias("key")))
    heads = heads.join(after, F.col("near") == F.col("next")).select(F.col("key").alias("after"), F.col("row").alias("head_row"), F.col("text").alias("head_text"))
    out = inner.join(heads, (F.col("near") == F.col("after")) & F.col("next_row").isNull(), "left")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    other = F.coalesce("next_text", "head_text")
    text = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))
    return out.select("row", "doc_id", "text", F.coalesce("next_row", "head_row").alias("next_row"), text.alias("edited"))


def block_tables(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """prints exploded to its rows in all permuted tables: `table_no` and the `prefix` to look up.

    The 64 bits are cut into blocks; for each choice of blocks - radius of them one table is keyed by their bits.
    Fingerprints within the radius differ in at most radius blocks, so they share a prefix in some table.
    """
    if not 0 < radius < blocks <= 16:
        raise ValueError("blocks must exceed the radius, and not 16")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    return prints.select("*", F.posexplode(keys).alias("table_no", "prefix"))


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fingerprint, match, distance): for each distinct fingerprint of queries all distinct ones of prints within radius.

    A pair that several tables find is taken from the first of them, so nothing needs to be made distinct.
    """
    asked = block_tables(queries.select("fingerprint").distinct(), radius, blocks)
    held = block_tables(prints.select("fingerprint").distinct(), radius, blocks).withColumnRenamed("fingerprint", "match")
    apart = F.col("fingerprint").bitwiseXOR(F.col("match"))
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    equal = [apart.bitwiseAND(F.lit(_signed(((1 << (e - s)) - 1) << s)).cast("long")) == 0 for s, e in zip(cuts, cuts[1:], strict=False)]
    first = F.lit(len(list(combinations(range(blocks), radius))))
    for k, chosen in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
        agree = equal[chosen[0]]
        for c in chosen[1:]:
            agree = agree & equal[c]
        first = F.when(agree, F.lit(k)).otherwise(first)
    joined = asked.join(held, ["table_no", "prefix"]).where(F.bit_count(apart) <= radius).where(F.col("table_no") == first)
    return joined.select("fingerprint", "match", F.bit_count(apart).alias("distance"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_documents(prints: DataFrame, asked: Column, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fingerprint, within): for the distinct fingerprints of the rows asked for, how many rows of prints are within the radius.

    Copies are counted, not paired: the tables hold distinct fingerprints.
    """
    held = stored(prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(asked, F.lit(False))).alias("asked")))
    found = near_fingerprints(held.where("asked"), held, radius, blocks)
    return found.join(held.select(F.col("fingerprint").alias("match"), "n"), "match").groupBy("fingerprint").agg(F.sum("n").alias("within"))


def document_fingerprints(docs: DataFrame, asked: Column | None = None, radius: int = 3) -> DataFrame:
    """For each row of docs (doc_id, text), repeated rows included: doc_id, n_chars, edited_sha256, long
    fingerprint and edited_fingerprint, near_edited, near_next, near_docs. A null text is empty, a null doc_id comes
    after all others. An empty table gives an empty result; other columns of docs are left out, whatever their names.

    near_docs is the number of other rows whose fingerprint is within the radius, for the rows asked for (a
    condition on doc_id), else null.
    """
    both = edited(docs).select("row", "doc_id", "next_row", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("version", "text"))
    prints = stored(fingerprint(both, ["row", "version", "doc_id", "next_row", "n_chars", "edited_sha256"]))
    own = prints.where("version = 0").drop("version")
    other = prints.where("version = 1").select("row", F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("row").alias("next_row"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(other, "row").join(after, "next_row")
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(name) for name, c in (("near_edited", "edited_fingerprint"), ("near_next", "next_fingerprint"))]
    out = out.select("row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
    if asked is None:
        return out.drop("row").withColumn("near_docs", F.lit(None).cast("long"))
    asking = own.where(F.coalesce(asked, F.lit(False))).select("row", "fingerprint").join(near_documents(own, asked, radius), "fingerprint").select("row", (F.col("within") - 1).alias("near_docs"))
    return out.join(asking, "row", "left").drop("row")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns near_docs, for every row whose id is divisible by 50, against all rows."""
    out = document_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 50 == 0)
    return out.withColumns({c: hex64(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
