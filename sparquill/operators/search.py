"""Text search: postings, term statistics, BM25, TF-IDF, phrases, proximity, fusion, reranking.

A corpus is exploded once into postings; scores join it to the query's terms, which are few, so the scan is
filtered by a broadcast of those before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators.ranks import spread_join
from sparquill.sources.shared import stored

K1, B = 1.5, 0.75
#: Terms of over so small a part of all (document, term) pairs are broadcast, fewer than this; all others are joined.
FREQUENT = 1_000_000
#: Words of 64 bits in the sketch of a word set, a power of 2.
SKETCH = 4
#: Sets, and words of sets, of a block whose pairs are verified at once, about.
MET = 1_000, 500_000
#: For each so many words of a set one more of its first ones must be shared.
LONG = 64
#: Bytes that tell frequent from rare words, a power of 2.
LEVELS = 1 << 20


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): every token at its place."""
    return docs.select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "term"))


def term_counts(docs: DataFrame) -> DataFrame:
    return postings(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("dl"))


def vocabulary(docs: DataFrame, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """(term, df, idf): terms of min_df to max_share of all documents; idf = ln(N / df)."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = df.join(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.col("n") * max_share)))
    return kept.select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def smoothed_idf(docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def matches(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, term, times, tf, dl): the query's terms in each document, counted without exploding it."""
    terms = list(dict.fromkeys(query.lower().split()))
    w = docs.select("doc_id", text.tokens(F.col("text")).alias("w"))
    times = query.lower().split()
    counted = [F.struct(F.lit(t).alias("term"), F.lit(times.count(t)).alias("times"), (F.size("w") - F.size(F.array_remove("w", t))).alias("tf")) for t in terms]
    return w.select("doc_id", F.size("w").alias("dl"), F.inline(F.array(*counted))).where("tf > 0")


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, score): idf = ln((N - df + 0.5) / (df + 0.5) + 1), k1 = 1.5, b = 0.75."""
    stats = document_lengths(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = matches(docs, query)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    joined = found.join(F.broadcast(df), "term").join(F.broadcast(stats))
    return joined.groupBy("doc_id").agg(F.sum(F.col("times") * idf * share).alias("score"))


def term_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, term, tf, dl) and (term, df): texts are split once, and both are read from what was written.

    Texts are dealt by document before they are split, so that terms are counted where they are.
    """
    w = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", text.tokens(F.col("text")).alias("w"))
    counts = stored(w.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
    return counts, stored(counts.groupBy("term").agg(F.count("*").alias("df")))


def with_df(counts: DataFrame, df: DataFrame) -> DataFrame:
    """counts with df. Frequent terms, most of the rows, meet a broadcast and stay where they are; only the rows of the others are dealt by term."""
    often = F.col("df") > (df.agg(F.sum("df")).first()[0] or 0) / FREQUENT
    few = F.broadcast(df.where(often))
    rest = counts.join(few.select("term"), "term", "left_anti").join(df.where(~often).hint("merge"), "term")
    return counts.join(few, "term").unionByName(rest)


def tf_idf(docs: DataFrame) -> DataFrame:
    """(doc_id, term, weight): share of the document's tokens times ln(N / df)."""
    counts, df = term_table(docs)
    n = docs.count()
    return with_df(counts, df).select("doc_id", "term", (F.col("tf") / F.col("dl") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))


def cosine(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, score): cosine of smoothed TF-IDF vectors, term counts as tf.

    Documents without a term of the query have no product, and are left out.
    """
    counts, df = term_table(docs)
    n, times = docs.count(), query.lower().split()
    asked = [t for t in dict.fromkeys(times)]
    idf = {r.term: math.log((n + 1) / (r.df + 1)) + 1 for r in df.where(F.col("term").isin(asked)).collect()}
    if not idf:
        return counts.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    q = {t: times.count(t) * x for t, x in idf.items()}
    q_norm = math.sqrt(sum(x * x for x in q.values()))
    weighted = with_df(counts, df)
    weight = F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    dot = F.try_element_at(F.create_map(*[F.lit(x) for kv in q.items() for x in kv]), F.col("term")) * weight
    sums = weighted.groupBy("doc_id").agg(F.sum(dot).alias("dot"), F.sqrt(F.sum(weight * weight)).alias("norm"))
    return sums.where("dot IS NOT NULL").select("doc_id", (F.col("dot") / (F.col("norm") * q_norm)).alias("score"))


def phrase_hits(docs: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, start): places where the phrase's words stand one after another."""
    terms = phrase.lower().split()
    w = docs.select("doc_id", text.tokens(F.col("text")).alias("w")).where(F.size("w") >= len(terms))
    starts = F.sequence(F.lit(0), F.size("w") - len(terms))
    hit = F.filter(starts, lambda k: F.slice("w", k + 1, len(terms)) == F.array(*[F.lit(t) for t in terms]))
    return w.select("doc_id", F.explode(hit).alias("start"))


def proximity(docs: DataFrame, first: str, second: str, most: int) -> DataFrame:
    """(doc_id, distance, p1, p2): the first closest pair of two words with at most `most` words between them.

    Each word looks only at the nearest other one before and after it, in one sorted pass.
    """
    at = postings(docs).where(F.col("term").isin(first, second))
    near = Window.partitionBy("doc_id").orderBy("pos")
    a, b = F.when(F.col("term") == first, F.col("pos")), F.when(F.col("term") == second, F.col("pos"))
    before = F.last(b, ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(b, ignorenulls=True).over(near.rowsBetween(1, Window.unboundedFollowing))
    sides = at.select("doc_id", a.alias("p1"), before.alias("before"), after.alias("after"))
    pairs = sides.select("doc_id", "p1", F.explode(F.array("before", "after")).alias("p2")).where("p1 IS NOT NULL AND p2 IS NOT NULL")
    pairs = pairs.withColumn("distance", F.abs(F.col("p1") - F.col("p2")) - 1).where(F.col("distance") <= most)
    best = pairs.groupBy("doc_id").agg(F.min(F.struct("distance", "p1", "p2")).alias("m"))
    return best.select("doc_id", "m.distance", "m.p1", "m.p2")


def top(scored: DataFrame, n: int, score: str = "score", places: int = 9) -> DataFrame:
    """The n best rows, ties by doc_id; scores are compared as rounded to `places`."""
    return scored.withColumn(score, F.round(score, places)).orderBy(F.desc(score), "doc_id").limit(n)


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """The n best rows with their rank from 1; the window runs over those n only."""
    best = top(scored, n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(doc_id, score): sum over ranked lists of 1 / (k + rank)."""
    union = lists[0].select("doc_id", "rank")
    for more in lists[1:]:
        union = union.unionAll(more.select("doc_id", "rank"))
    return union.groupBy("doc_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def min_max(c: Column, over: Window = None) -> Column:
    """Scaled to 0..1; 0 where all are equal."""
    w = over or Window.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))


def tanh_scaled(c: Column, k: float = 2.0) -> Column:
    return F.tanh(c / k)


def hybrid(lexical: DataFrame, other: DataFrame, weight: float = 0.5, least: float = 0.01) -> DataFrame:
    """(doc_id, score) of two scored lists: the first over its largest, the second min-max scaled, by weight."""
    top_score = lexical.agg(F.max("score").alias("m"))
    ends = other.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    a = lexical.join(F.broadcast(top_score)).select("doc_id", (F.col("score") / (F.col("m") + 1e-10)).alias("a"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    b = other.join(F.broadcast(ends)).select("doc_id", scaled.alias("b"))
    joined = a.join(b, "doc_id", "full").select("doc_id", (F.coalesce("a", F.lit(0.0)) * weight + F.coalesce("b", F.lit(0.0)) * (1 - weight)).alias("score"))
    return joined.where(F.col("score") >= least)


def rerank_features(docs: DataFrame, query: str) -> DataFrame:
    """doc_id and features of each document for a query, all in one projection.

    phrase: min(15 ln(1 + n), 40) for n literal places of the query; density: min(20 hits / span, 15) from two
    hits on; position: 10 (1 - first / length); coverage: 10 times the share of query words contained;
    keyword: 10 times the F1 of query words and the text's distinct words.
    """
    q = query.lower()
    terms = list(dict.fromkeys(q.split()))
    low = F.lower("text")
    w = docs.select("doc_id", low.alias("low"), text.tokens(F.col("text")).alias("w"))
    places = F.filter(F.transform("w", lambda x, k: F.when(x.isin(terms), k)), lambda k: k.isNotNull())
    w = w.withColumns({"n": (F.length("low") - F.length(F.replace("low", F.lit(q), F.lit("")))) / len(q), "hits": places, "size": F.size("w"), "distinct": F.size(F.array_distinct("w")), "both": F.size(F.array_intersect("w", F.array(*[F.lit(t) for t in terms])))})
    phrase = F.when(F.col("n") > 0, F.least(15 * F.log(1 + F.col("n")), F.lit(40.0))).otherwise(F.lit(0.0))
    span = F.array_max("hits") - F.array_min("hits") + 1
    density = F.when(F.size("hits") >= 2, F.least(20.0 * F.size("hits") / span, F.lit(15.0))).otherwise(F.lit(0.0))
    position = F.when(F.size("hits") > 0, 10 * (1 - F.array_min("hits") / F.col("size"))).otherwise(F.lit(0.0))
    coverage = sum((F.contains("low", F.lit(t)).cast("int") for t in terms), F.lit(0)) * (10.0 / len(terms))
    precision, recall = F.col("both") / F.greatest("distinct", F.lit(1)), F.col("both") / float(len(terms))
    keyword = F.when(F.col("both") > 0, 10 * 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return w.select("doc_id", phrase.alias("phrase"), density.alias("density"), position.alias("position"), coverage.alias("coverage"), keyword.alias("keyword"))


def diversified(scored: DataFrame, by: str, each: int, n: int) -> DataFrame:
    """The n best rows with at most `each` of one `by`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= each).drop("place").orderBy(F.desc("score"), "doc_id").limit(n)


def round_robin(scored: DataFrame, by: str, n: int) -> DataFrame:
    """n rows: the best of each `by`, then the second best, and so on; within a round by score."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("round", place).orderBy("round", F.desc("score"), "doc_id").limit(n)


def fuzzy(names: DataFrame, query: str, least: float = 0.6) -> DataFrame:
    """(name, score): 1 - edit distance over the longer length, upper-cased."""
    up = F.upper("name")
    score = 1 - F.levenshtein(up, F.lit(query.upper())) / F.greatest(F.length("name"), F.lit(len(query)))
    return names.select("name", score.alias("score")).where(F.col("score") >= least)


def containing(names: DataFrame, query: str) -> DataFrame:
    """(name, score): names that contain the query; its share of the name's length."""
    return names.where(F.contains(F.upper("name"), F.lit(query.upper()))).select("name", (F.lit(float(len(query))) / F.length("name")).alias("score"))


def token_matches(names: DataFrame, query: str) -> DataFrame:
    """(name, score): a point for each query word among the name's, half for one of three letters or more that contains or is contained; over the words."""
    terms = query.upper().split()
    parts = F.split(F.upper("name"), r"[\s_^#]+")
    def point(t: str) -> Column:
        near = F.exists(parts, lambda p: (F.length(p) >= 3) & (F.contains(p, F.lit(t)) | F.contains(F.lit(t), p))) if len(t) >= 3 else F.lit(False)
        return F.when(F.array_contains(parts, t), 1.0).when(near, 0.5).otherwise(0.0)

    return names.select("name", (sum((point(t) for t in terms), F.lit(0.0)) / len(terms)).alias("score")).where("score > 0")


def cascade(names: DataFrame, query: str) -> DataFrame:
    """(name, stage, score): the first stage that finds a name wins: exact 1.0, fuzzy x 0.95, contains x 0.85, words x 0.8.

    An exact hit leaves no other stage.
    """
    exact = names.where(F.upper("name") == query.upper().strip()).select("name", F.lit(1.0).alias("score"))
    stages = [("exact", exact, 1.0), ("fuzzy", fuzzy(names, query), 0.95), ("contains", containing(names, query), 0.85), ("token", token_matches(names, query), 0.8)]
    union = None
    for k, (stage, rows, boost) in enumerate(stages):
        own = rows.select("name", F.lit(k).alias("nr"), F.lit(stage).alias("stage"), (F.col("score") * boost).alias("score"))
        union = own if union is None else union.unionAll(own)
    hit = exact.agg(F.count("*").alias("hits"))
    first = union.groupBy("name").agg(F.min_by(F.struct("nr", "stage", "score"), "nr").alias("m")).select("name", "m.*")
    return first.join(F.broadcast(hit)).where("hits = 0 OR nr = 0").select("name", "stage", "score")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, other, similarity): documents with the same word set and their class, the smallest id (similarity 1); and pairs of
    classes, other < doc_id, whose word sets have a Jaccard similarity of threshold or more.

    So copies are never paired with each other, and all links follow from both. Exact, by prefix filtering: two such
    sets share a word among the first few of each, in any one order of all words, so classes meet only on those; rare words
    come first. With l more words long sets share l more. Of the pairs that meet, only those are kept that share so many, whose
    words around a shared one can be enough, and whose sketches differ in no more bits than the sets may in words; each of these
    is verified on the whole sets. Sets are stored once and shuffled only to be verified, by blocks: tasks find the first words where a set is. Texts without words are left out.
    """
    sets = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_sort(F.array_distinct(text.tokens(F.col("text")))).alias("w")).where(F.size("w") > 0)
    keyed = stored(sets.withColumn("key", F.unhex(F.sha2(F.array_join("w", " "), 256))), codec="zstd")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    classes = stored(keyed.groupBy("key").agg(first, F.count("*").alias("copies")).select("key", F.col("first.doc_id").alias("id"), F.col("first.row").alias("row"), "copies"))
    copies = spread_join(keyed.select("doc_id", "key"), classes.select("key", "id", "copies"), "key", "copies", F.col("doc_id")).where("doc_id <> id")
    member = copies.select("doc_id", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    hashed = keyed.select("row", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    bits = [f"b{j}" for j in range(SKETCH)]
    begun = stored(hashed.mapInArrow(_first_words(_levels(hashed), threshold), f"row long, n int, least int, terms array<long>, {', '.join(f'{c} long' for c in bits)}"), codec="zstd")
    prefix = stored(begun.join(classes.select("row", "id").hint("merge"), "row").select("row", "id", "n", "least", F.posexplode("terms").alias("place", "term"), *bits))
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    both = F.col("a.n") + F.col("b.n")
    least = F.least("a.least", "b.least")
    before = F.when(least > 1, F.least("a.place", "b.place")).otherwise(0)  # of a pair that must share one word only, the first one tells
    left = before + F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= both * (threshold / (1 + threshold)) - 1e-6
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in bits]) <= both * ((1 - threshold) / (1 + threshold)) + 1e-6
    met = a.join(b, (F.col("a.term") == F.col("b.term")) & (F.col("b.id") < F.col("a.id")) & sized & left & apart)
    shared = met.groupBy(F.col("a.row").alias("x"), F.col("b.row").alias("y")).agg(F.count("*").alias("k"), F.min(least).alias("least"))
    pairs = shared.where("k >= least").select("x", "y").persist()
    placed, by = _placed(pairs, prefix.where("place = 0").select("row", "id", "n"))
    to = [f"to_{c}" for c in by]
    needed = placed.select(F.col("x").alias("row"), *[F.col(c).alias(k) for c, k in zip(by, to, strict=True)])
    needed = needed.unionAll(placed.select("y", *by)).distinct()
    met_sets = hashed.join(needed.hint("merge"), "row").select(*to, "row", "h")
    kind = docs.schema["doc_id"].dataType.simpleString()
    similar = met_sets.groupBy(*to).cogroup(placed.groupBy(*by)).applyInArrow(_verified(threshold), f"doc_id {kind}, other {kind}, similarity double")
    return similar.unionAll(member)


def _placed(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """pairs with their sets' ids and blocks, and the names of the latter. Sets like each other are in a few blocks, so that a set is sent to a block, not to a pair.

    A set goes by the smallest row that it or its smallest partner is paired with; where these sets are too many for one task they are cut by hash.
    """
    both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    first = stored(both.groupBy(F.col("x").alias("row")).agg(F.least(F.min("x"), F.min("y")).alias("first")))
    lead = first.join(first.select(F.col("row").alias("first"), F.col("first").alias("lead")).hint("merge"), "first").select("row", "lead")
    lead = stored(lead.join(sets.hint("merge"), "row"))
    parts = lead.groupBy("lead").agg(F.ceil(F.greatest(F.sum("n") / MET[1], F.count("*") / MET[0])).alias("parts"))
    blocks = stored(lead.join(parts.hint("merge"), "lead").select("row", "id", "lead", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")))
    end = lambda c: blocks.select(F.col("row").alias(c), F.col("id").alias(f"{c}_id"), F.col("lead").alias(f"{c}_lead"), F.col("part").alias(f"{c}_part")).hint("merge")
    return pairs.join(end("x"), "x").join(end("y"), "y").persist(), ["x_lead", "x_part", "y_lead", "y_part"]


def _verified(threshold: float) -> Callable:
    """Of two blocks' sets and their pairs: the pairs that are alike enough. Words are compared by their 64-bit hashes."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        sets, pairs = sets.combine_chunks(), pairs.combine_chunks()
        rows, lists = sets.column("row").to_numpy(), sets.column("h").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(lists.offsets.to_numpy())
        _, word, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        nr = np.cumsum(times > 1) - 1  # a word of one set is shared by no pair
        of, again = np.repeat(np.arange(len(n)), n), times[word] > 1
        of, word = of[again], nr[word[again]]
        order = np.argsort(word, kind="stable")
        of, word = of[order], word[order]
        shared = np.zeros((len(n), len(n)), np.float32)
        for start in range(0, int(nr[-1]) + 1, 4096):
            lo, hi = np.searchsorted(word, (start, start + 4096))
            held = np.zeros((len(n), 4096), np.float32)
            held[of[lo:hi], word[lo:hi] - start] = 1
            shared += held @ held.T
        order = np.argsort(rows)
        x, y = (order[np.searchsorted(rows, pairs.column(c).to_numpy(), sorter=order)] for c in "xy")
        both = shared[x, y].astype(float)
        similarity = both / (n[x] + n[y] - both)
        kept = pa.array(similarity >= threshold)
        return pa.table({"doc_id": pairs.column("x_id"), "other": pairs.column("y_id"), "similarity": pa.array(similarity)}).filter(kept)

    return run


def _levels(hashed: DataFrame) -> np.ndarray:
    """LEVELS bytes: by a word's last bits, how many rows have it, on a scale of logarithms; of words that share them, the most frequent one counts."""
    df = hashed.select(F.explode("h").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    level = F.least(F.lit(255), F.round(8 * F.log2(F.max("df")))).cast("int").alias("level")
    found = df.groupBy(F.col("term").bitwiseAND(LEVELS - 1).cast("int").alias("at")).agg(level).toArrow()  # LEVELS rows at most
    levels = np.zeros(LEVELS, np.uint8)
    levels[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return levels


def _first_words(levels: np.ndarray, threshold: float) -> Callable:
    """For rows (row, h): row, the number of words, how many of its first ones a set like it shares at least, these by level, then hash, and the sketch.

    Each word flips one bit of its set's sketch, so two sketches never differ in more bits than the sets in words.
    """
    width = 64 * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows, lists = batch.column(0).slice(start, 1024), batch.column(1).slice(start, 1024)
                n = np.diff(lists.offsets.to_numpy())
                h, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                odd = (np.bincount(of * width + (h & (width - 1)), minlength=len(n) * width) & 1).astype(np.uint8)
                sketch = np.packbits(odd, bitorder="little").view("<i8").reshape(-1, SKETCH)
                order = np.lexsort((h, levels[h & (LEVELS - 1)], of))
                same = np.maximum(np.ceil(n * threshold - 1e-9).astype(int), 1)
                least = np.minimum(1 + n // LONG, same)
                most = n - same + least
                ends = np.cumsum(most)
                kept = np.arange(ends[-1]) + np.repeat(np.cumsum(n) - n - (ends - most), most)
                terms = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(h[order[kept]]))
                yield pa.RecordBatch.from_arrays([rows, pa.array(n, pa.int32()), pa.array(least, pa.int32()), terms, *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH)]], names=["row", "n", "least", "terms", *[f"b{j}" for j in range(SKETCH)]])

    return run
