"""SimHash near-dedup: exact comparison of fingerprints, tile against tile.

Fingerprints within radius r agree on at least one of r + 1 blocks of their bits, so only those that share a
block's value can link. Those are sorted by population count and compared tile by tile with numpy exclusive-or
and bit counts; tile pairs whose population counts differ by more than r are skipped. A tile pair returns a
spanning forest of its links, never all pairs. A block value that many fingerprints share is cut once more by the
bits outside the block, by the same pigeonhole; what is still more than a task should hold is cut into tiles that
are compared as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import forget, fresh, lower_ascii, read, row_key, spread_join, stored, text_of, words
from sparquill.llm.components import components
from sparquill.llm.votes import hex64, simhash

RADIUS = 2
TILE = 256
PACK = 1024  # rows of small groups that are compared at once
FINER = 8192  # rows of one block value that are compared with each other; larger ones are cut by further bits
GROUP = 32768  # rows of one group that a task holds; larger groups are compared by tile rows
HEAVY_TILE = 4096
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(docs: DataFrame, shingle: int = 3, *keep: str) -> DataFrame:
    """doc_id, the columns to keep and the long fingerprint of each row of docs: all 3-word shingles vote."""
    key, = fresh(docs, "row")
    w = F.col("w")
    n = F.size(w)
    parts = [F.slice(w, i + 1, n - (shingle - 1)) for i in range(shingle)]
    zipped = F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)])
    names = [f"w{i}" for i in range(shingle)]
    short = F.array(F.struct(*[F.get(w, F.lit(i)).alias(x) for i, x in enumerate(names)]))  # fewer words than a shingle has
    kind = f"array<struct<{','.join(f'{x}:string' for x in names)}>>"
    rows = docs.select("doc_id", *keep, row_key().alias(key), words(lower_ascii(text_of())).alias("w"))
    rows = rows.select("doc_id", *keep, key, F.inline_outer(F.when(n >= shingle, zipped.cast(kind)).when(n > 0, short.cast(kind))).alias(*names))
    hashed = F.when(F.col("w0").isNotNull(), F.xxhash64(F.concat_ws(" ", *names)))
    return simhash(rows.select("doc_id", *keep, key, hashed.alias("h")), ["doc_id", *keep, key]).drop(key)


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, in which each entry points to its set's smallest member, after joining the sets of i and j."""
    while True:
        a, b = root[i], root[j]
        if not (differ := a != b).any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _forest(prints: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within prints, or between prints and other."""
    def tiles(x: np.ndarray) -> list[tuple[int, int, int, int]]:
        count = np.bitwise_count(x)
        return [(s, min(s + TILE, len(x)), int(count[s]), int(count[min(s + TILE, len(x)) - 1])) for s in range(0, len(x), TILE)]

    ordered = [x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (prints, prints[:0] if other is None else other)]
    every = np.concatenate(ordered)
    root = np.arange(len(every))
    left, right, base = tiles(ordered[0]), tiles(ordered[1]), len(ordered[0])
    for k, (s, e, low, high) in enumerate(left):
        for s2, e2, low2, high2 in left[k:] if other is None else right:
            if low2 - high > radius or low - high2 > radius:
                continue
            near = np.bitwise_count(every[s:e, None] ^ ordered[other is not None][None, s2:e2]) <= radius
            i, j = np.nonzero(near)
            root = _unite(root, i + s, j + s2 + (0 if other is None else base))
    child = np.nonzero(root != np.arange(len(every)))[0]
    return every[child].view(np.int64), every[root[child]].view(np.int64)


def _linker(radius: int):
    def batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGES)

    def packs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole groups of up to PACK rows; a larger group is a run of its own."""
        starts = [*np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0].tolist(), len(keys)]
        begin = 0
        for s, e in zip(starts, starts[1:], strict=False):
            if e - begin > PACK and s > begin:
                yield begin, s
                begin = s
        yield begin, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for more in batches:
            keys = np.concatenate([keys, more.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, more.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) and (cut := int(np.searchsorted(keys, keys[-1]))):  # the last group may go on
                yield batch([_forest(prints[s:e], radius) for s, e in packs(keys[:cut])])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield batch([_forest(prints, radius)])

    return run


def _tile_linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, same in zip(*(rows.column(k) for k in range(3)), strict=True):
                x, y = (np.asarray(v.values, np.int64).view(np.uint64) for v in (a, b))
                found = _forest(x, radius, None if same.as_py() else y)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], schema=_EDGES)

    return run


def block_keys(fingerprint: Column, radius: int) -> Column:
    """The values of radius + 1 blocks of the 64 bits, each with its block's number in the top bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.lit(k << 58).bitwiseOR(F.shiftrightunsigned(fingerprint, s).bitwiseAND(F.lit((1 << (e - s)) - 1))) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _part_cuts(low: int, high: int, radius: int) -> list[list[tuple[int, int]]]:
    """The bits outside low to high, in radius + 1 parts of about the same number, each as ranges of bits."""
    rest = [k for k in range(64) if not low <= k < high]
    edges = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
    out = []
    for s, e in zip(edges, edges[1:], strict=False):
        own = rest[s:e]
        out.append([(x[0], x[-1] + 1) for x in ([k for k in own if k < low], [k for k in own if k >= high]) if x])
    return out


def finer_keys(g: Column, fingerprint: Column, radius: int) -> Column:
    """Of fingerprints that share the block value g, radius + 1 keys from the other bits: those within the radius share one of them."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    keys = None
    for block, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        masks = [sum(((1 << (e - s)) - 1) << s for s, e in part) for part in _part_cuts(low, high, radius)]
        own = F.array(*[F.xxhash64(F.lit(k), g, fingerprint.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks)])
        keys = F.when(F.shiftrightunsigned(g, 58) == block, own) if keys is None else keys.when(F.shiftrightunsigned(g, 58) == block, own)
    return keys


def _sized(keyed: DataFrame) -> DataFrame:
    """keyed (g, fingerprint) stored with the count of each g, but for those of one row; no frequent g makes a task lopsided."""
    keyed = stored(keyed)
    sizes = stored(keyed.groupBy("g").count().where("count > 1"))
    rows = stored(spread_join(keyed, sizes, "g", "count", "fingerprint", keyed.count()))
    forget(keyed)
    forget(sizes)
    return rows


def links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP, heavy_tile: int = HEAVY_TILE, finer: int = FINER) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that are within the radius of each other.

    Block values of more than `finer` fingerprints are cut once more, by the bits outside the block, so that comparisons
    don't grow with the square of the corpus; what more than `group` share even then is compared by tile rows.
    """
    if not 1 <= radius <= 15:
        raise ValueError("radius must be from 1 to 15")
    rows = _sized(prints.select(F.explode(block_keys(F.col("fingerprint"), radius)).alias("g"), "fingerprint"))

    def compared(few: DataFrame) -> DataFrame:
        return few.select("g", "fingerprint").repartition("g").sortWithinPartitions("g").mapInArrow(_linker(radius), "a long, b long")

    out = compared(rows.where(F.col("count") <= finer))
    large = rows.where(F.col("count") > finer)
    if large.isEmpty():
        return out
    cut = _sized(large.select(F.explode(finer_keys(F.col("g"), F.col("fingerprint"), radius)).alias("g"), "fingerprint"))
    out = out.unionAll(compared(cut.where(F.col("count") <= group)))
    rest = cut.where(F.col("count") > group)
    return out if rest.isEmpty() else out.unionAll(_by_tiles(rest, radius, heavy_tile))


def _by_tiles(rows: DataFrame, radius: int, size: int) -> DataFrame:
    """Edges within each g of rows (g, fingerprint, count), tile against tile; those of one g are keys of their own by population count."""
    ones = F.bit_count("fingerprint").alias("ones")
    parted = rows.select("g", ones, F.pmod(F.xxhash64("fingerprint"), F.ceil(F.col("count") / size)).alias("part"), "fingerprint")
    tiles = stored(parted.groupBy("g", "ones", "part").agg(F.collect_list("fingerprint").alias("f")))
    met = tiles.select("g", F.explode(F.sequence(F.col("ones") - radius, "ones")).alias("at"), "ones", "part", "f")
    x, y = tiles.alias("x"), met.alias("y")
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.ones") == F.col("y.at")) & (F.struct("x.ones", "x.part") <= F.struct("y.ones", "y.part")))
    pairs = pairs.select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), (F.struct("x.ones", "x.part") == F.struct("y.ones", "y.part")).alias("same"))
    return pairs.repartition(F.xxhash64("a", "b")).mapInArrow(_tile_linker(radius), "a long, b long")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, root, component_id and n, the number of its rows, of each distinct fingerprint of prints; root tells components apart."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stored(rooted.select("fingerprint", "low", "n", "root"))
    least = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")))
    out = spread_join(rooted.drop("low"), least, "root", "members", "fingerprint", rooted.count())
    return stored(out.select("fingerprint", "root", "component_id", "n"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """doc_id, long fingerprint and component_id of each row of docs (doc_id, text).

    Fingerprints at radius or fewer differing bits link, and component_id is the smallest doc_id that links
    reach, the row's own included (null only if all are null). A null text is the empty one; texts without
    words have fingerprint zero and link like any other. Repeated rows each get a row. No row is left out of
    any comparison. An empty table gives an empty result; other columns of docs are left out, whatever their names.
    """
    key = "row_nr"
    prints = stored(fingerprints(docs.select("doc_id", "text").withColumn(key, row_key()), shingle, key))
    return spread_join(prints, _rooted(prints, radius), "fingerprint", "n", key, prints.count()).select("doc_id", "fingerprint", "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) but for all but one of each component.

    The row with the component's smallest doc_id stays, a null one only where there is no other; of rows that
    share that id, one with the smallest text, and of rows that share both, any one. Components are told apart by
    their fingerprints and rows by id and digest of the text, so rows with null or repeated ids that are no near
    copies all stay. A null text is empty; an empty table gives an empty result. Texts are not stored again.
    """
    digest, nr = fresh(docs, "digest", "nr")
    sha = F.sha2(F.encode(text_of(), "UTF-8"), 256)
    prints = stored(fingerprints(docs.select("doc_id", "text", sha.alias(digest)), shingle, digest))
    salted = prints.withColumn("salt", F.xxhash64(digest, row_key()))
    rooted = spread_join(salted, _rooted(prints, radius), "fingerprint", "n", "salt", prints.count())
    rows = rooted.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", digest).agg(F.count("*").alias("copies"))
    first = stored(rows.groupBy("root").agg(F.count("*").alias("texts"), F.min(F.struct("doc_id", digest, "copies")).alias("m")).select("root", "texts", "m.*"))
    keep = first.where("texts = 1").select("doc_id", digest, "copies")
    same = lambda a, b: F.col(f"{a}.{digest}").eqNullSafe(F.col(f"{b}.{digest}")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    mine = docs.withColumn(digest, sha)
    if not (tied := first.where("texts > 1").select("root")).isEmpty():
        several = stored(rows.join(tied, "root")).alias("t")
        texts = mine.alias("d").join(several, same("d", "t")).select("t.root", "t.doc_id", F.col(f"t.{digest}").alias(digest), "t.copies", text_of("d.text").alias("least_text"))
        keep = keep.unionAll(texts.groupBy("root").agg(F.min(F.struct("least_text", "doc_id", digest, "copies")).alias("m")).select("m.doc_id", f"m.{digest}", "m.copies"))
    keep = stored(keep)
    out = mine.alias("d").join(keep.where("copies = 1").alias("k"), same("d", "k"), "left_semi").select(*docs.columns)
    if not (repeated := keep.where("copies > 1")).isEmpty():  # one of rows that are alike; columns may differ
        again = mine.alias("d").join(repeated.alias("k"), same("d", "k"), "left_semi").withColumn(nr, row_key())
        least = again.groupBy("doc_id", digest).agg(F.min_by(F.struct(*docs.columns), nr).alias("r"))
        out = out.unionAll(least.select(*[F.col(f"r.{c}").alias(c) for c in docs.columns]))
    return out


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumn("fingerprint", hex64(F.col("fingerprint")))
