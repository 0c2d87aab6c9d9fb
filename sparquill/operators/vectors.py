"""A stored vector index by coarse cells, searched in the nearest cells or exactly, and its fusion with lexical search.

Rows are packed by cell into blocks when the index is built, in folders by cell, so a search reads the folders of the
cells that it visits, shuffles queries only, and meets each block in one matrix product. A cell with most rows is as
many blocks as it needs; nothing is gathered by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text
from sparquill.operators.variants import okapi
from sparquill.sources.shared import forget, stored

SAMPLE = 16_384  # rows that the centres are fitted to
MOST_CELLS = 4_096
BLOCK = 2_048
PLACES = 6  # of a score; ties go by id
TUNING = 256  # rows asked to choose the number of probes

# The constant of rank fusion, the least lexical score, how many results of each list are fused, and of
# symbols and structures how many count, at what share of their score.
RRF, LEAST, FUSED = 60, 0.1, 20
SYMBOLS, STRUCTURES, SHARE = 10, 5, 0.5

NO_ID = -(2**63)
FOUND = "query string, id long, score double, place int"


@dataclass(frozen=True)
class VectorIndex:
    """blocks: (cell, part, parts, rows of id and v); centres: one row of length one for each cell; reach: the greatest angle of a cell's rows to its centre."""

    blocks: DataFrame
    centres: np.ndarray
    reach: np.ndarray


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero rows stay), and which of them are zero."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0), norm[:, 0] == 0


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _centres(rows: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over a sample; a centre that loses all its rows goes to the row that fits worst."""
    rng = np.random.default_rng(42)
    held = rows[rng.choice(len(rows), cells, replace=False)]
    for _ in range(rounds):
        likeness = rows @ held.T
        own = likeness.argmax(1)
        sums = np.zeros_like(held)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = rows[np.argsort(likeness.max(1), kind="stable")[: len(empty)]]
        held, zero = _units(sums)
        held[zero] = rows[0]
    return held


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, block: int = BLOCK) -> VectorIndex:
    """An index of every row with a key (long) and a vector without nulls; repeated keys stay rows of their own, zero vectors are like nothing (score 0).

    Centres are fitted to SAMPLE rows, those of the smallest hash of the key; their number is the root of the rows', MOST_CELLS at most.
    Vectors of different lengths are an error.
    """
    known = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = vectors.where(known).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    facts = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("width")).first()
    if facts.n and facts.least != facts.width:
        raise ValueError(f"vectors have {facts.least} to {facts.width} numbers")
    if not facts.n:
        return VectorIndex(rows.groupBy(F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(1).alias("parts")).agg(F.collect_list(F.struct("id", "v")).alias("rows")), np.zeros((0, 0)), np.zeros(0))
    width = facts.width
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    fit, zero = _units(_matrix(sample, width))
    fit = fit[~zero] if (~zero).any() else fit
    centres = _centres(fit, min(cells or max(1, round(facts.n**0.5)), MOST_CELLS, len(fit)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, zero = _units(_matrix(batch.column(1), width))
            likeness = m @ centres.T
            angle = np.where(zero, np.pi, np.arccos(np.clip(likeness.max(1), -1, 1)))  # a zero vector may be met from anywhere
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(likeness.argmax(1).astype("int32")), pa.array(angle)], names=["id", "v", "cell", "angle"])

    placed = stored(rows.mapInArrow(assigned, f"id long, v {kind}, cell int, angle double"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.max("angle").alias("reach"))
    reach = np.full(len(centres), -1.0)
    for r in sizes.collect():  # MOST_CELLS at most
        reach[r.cell] = r.reach
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int").alias("part")
    packed = placed.join(F.broadcast(sizes), "cell").groupBy("cell", part, "parts").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    blocks = stored(packed, "cell")
    forget(placed)
    return VectorIndex(blocks, centres, reach)


def _visits(index: VectorIndex, asked: DataFrame, chosen: Callable) -> DataFrame:
    """asked with a row for each cell to visit: `chosen` gives, for likeness to centres, which rows are zero, cells from the nearest on and the least score that helps, the places to visit."""
    centres, kind = index.centres, asked.schema["v"].dataType.simpleString()
    full = index.reach >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                m, zero = _units(_matrix(own.column("v"), centres.shape[1]))
                likeness = np.where(full, m @ centres.T, -np.inf)
                order = np.argsort(-likeness, axis=1, kind="stable")[:, : full.sum()]
                row, place = np.nonzero(chosen(likeness, zero, order, own.column("bound").to_numpy(zero_copy_only=False)))
                columns = [own.column(c).take(pa.array(row)) for c in ("query", "own", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(order[row, place].astype("int32")), pa.array(place.astype("int32"))], names=["query", "own", "v", "cell", "place"])

    return asked.select("query", "own", "v", "bound").mapInArrow(run, f"query string, own long, v {kind}, cell int, place int")


def _met(index: VectorIndex, visits: DataFrame, n: int) -> DataFrame:
    """(query, id, score, place of the cell): the n best rows of each block that a query visits."""
    width = index.centres.shape[1]
    visits = stored(visits)
    counts = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("packs"))
    cells = [r.cell for r in counts.collect()]  # MOST_CELLS at most
    parts = index.blocks.groupBy("cell").agg(F.max("parts").alias("parts"))
    pack = F.pmod(F.xxhash64("query"), F.col("packs")).cast("int").alias("pack")
    queries = visits.join(F.broadcast(counts), "cell").groupBy("cell", pack).agg(F.collect_list(F.struct("query", "own", "place", "v")).alias("queries"))
    # Each pack goes to each block of its cell, by the block's own key: a cell of many blocks is many keys.
    dealt = queries.join(F.broadcast(parts), "cell").select("cell", "queries", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = index.blocks.where(F.col("cell").isin(cells)).join(dealt, ["cell", "part"]).select("rows", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, queries in zip(batch.column("rows"), batch.column("queries"), strict=True):
                rows, queries = rows.values, queries.values
                ids, own, place = rows.field("id").to_numpy(), queries.field("own").to_numpy(), queries.field("place").to_numpy()
                score = np.round(_units(_matrix(queries.field("v"), width))[0] @ _units(_matrix(rows.field("v"), width))[0].T, PLACES) + 0.0
                score[own[:, None] == ids[None, :]] = -np.inf
                by_id = np.argsort(ids, kind="stable")
                best = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :n]]
                values = np.take_along_axis(score, best, 1)
                q, k = np.nonzero(np.isfinite(values))
                yield pa.RecordBatch.from_arrays([queries.field("query").take(pa.array(q)), pa.array(ids[best[q, k]]), pa.array(values[q, k]), pa.array(place[q])], names=["query", "id", "score", "place"])

    return pairs.mapInArrow(run, FOUND)


def _best(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _asked(asked: DataFrame) -> DataFrame:
    own = F.col("own").cast("long") if "own" in asked.columns else F.lit(None).cast("long")
    kept = asked.where(F.col("query").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return kept.select(F.col("query").cast("string").alias("query"), F.coalesce(own, F.lit(NO_ID)).alias("own"), "v", F.lit(-1.0).alias("bound"))


def _nearest_cells(probes: int) -> Callable:
    return lambda likeness, zero, order, bound: np.broadcast_to(np.arange(order.shape[1]) < probes, order.shape)


def nearest(index: VectorIndex, asked: DataFrame, n: int, probes: int) -> DataFrame:
    """(query, rank, id, score, place): for each asked (query, v and, if any, own) the n rows of the largest cosine in its `probes` nearest cells.

    A row whose id is `own` is left out; `place` is the cell's in the query's order. Names of queries are unique; those without a name or vector have no result.
    """
    if not len(index.centres):
        return _best(asked.sparkSession.createDataFrame([], FOUND), n).select("query", "rank", "id", "score", "place")
    visits = _visits(index, _asked(asked), _nearest_cells(probes))
    return _best(_met(index, visits, n), n).select("query", "rank", "id", "score", "place")


def nearest_exact(index: VectorIndex, asked: DataFrame, n: int, probes: int = 4) -> DataFrame:
    """As nearest(), of all rows: other cells are visited where a row could still be as good as the n-th found so far.

    No row of a cell is nearer to a query than the angle to the centre less the cell's reach.
    """
    if not len(index.centres):
        return nearest(index, asked, n, probes)
    rows = _asked(asked)
    first = stored(_met(index, _visits(index, rows, _nearest_cells(probes)), n))
    bound = _best(first, n).where(F.col("rank") == n).select("query", F.col("score").alias("least"))
    reach = index.reach

    def others(likeness, zero, order, bound):
        angle = np.arccos(np.clip(np.take_along_axis(likeness, order, 1), -1, 1)) - reach[order]
        angle[zero] = 0
        helps = np.cos(np.maximum(angle, 0)) >= bound[:, None] - 2 * 10.0**-PLACES
        return helps & (np.arange(order.shape[1]) >= probes)

    rest = rows.drop("bound").join(bound, "query", "left").withColumn("bound", F.coalesce("least", F.lit(-1.0)))
    found = first.unionByName(_met(index, _visits(index, rest, others), n))
    return _best(found, n).select("query", "rank", "id", "score", "place")


def recall_by_probes(index: VectorIndex, n: int) -> DataFrame:
    """(probes, recall): share of the n exact neighbours that the nearest cells hold, for TUNING rows of the index, those of the smallest hash."""
    rows = index.blocks.select(F.inline("rows")).orderBy(F.xxhash64("id"), "id").limit(TUNING)
    asked = stored(rows.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("own"), "v"))
    counts = nearest_exact(index, asked, n).groupBy((F.col("place") + 1).alias("probes")).agg(F.count("*").alias("k"))
    run = Window.orderBy("probes")  # a row for each cell at most
    return counts.select("probes", (F.sum("k").over(run) / F.sum("k").over(Window.partitionBy())).alias("recall"))


def probes_for(index: VectorIndex, n: int, target: float = 0.95) -> int:
    """The least number of cells whose recall by recall_by_probes() is the target."""
    found = recall_by_probes(index, n).where(F.col("recall") >= target - 1e-12).agg(F.min("probes")).first()
    return found[0] or 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query, rank, score) of all queries that were found, by score, so that ties count."""
    both = exact.select("query", "rank", F.col("score").alias("best")).join(found.select("query", "rank", "score"), ["query", "rank"], "left")
    worst = exact.groupBy("query").agg(F.min("score").alias("worst"))
    return both.join(worst, "query").agg(F.avg(F.coalesce(F.col("score") >= F.col("worst"), F.lit(False)).cast("int"))).first()[0]


def lexical(entries: DataFrame, asked: DataFrame, first: int) -> DataFrame:
    """(query, id, score, rank): the `first` entries (id, text) of each asked (query, text) by BM25, of scores over LEAST."""
    terms = asked.select("query", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").cast("double").alias("weight"))
    docs = entries.select(F.col("id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = okapi(docs, terms).select("query", F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    return _best(scored.where(F.col("score") > LEAST), first)


def hybrid(asked: DataFrame, procedures: DataFrame, index: VectorIndex, symbols: DataFrame, structures: DataFrame, n: int = 10, probes: int | None = None) -> DataFrame:
    """(query, rank, kind, id, file, name, score): lexical and vector search of procedures fused, then symbols and structures.

    asked has query, text and v; procedures, symbols and structures have id, text, file and name. Of procedures the FUSED best by BM25 and
    the FUSED nearest of the index (exactly, or in `probes` cells) are fused by reciprocal ranks, and n stay; symbols and
    structures follow by half their score. An entry of a file and name that an earlier one has is left out. Queries without a
    vector are lexical, those without a text vector searches only.
    """
    near = nearest_exact(index, asked, FUSED) if probes is None else nearest(index, asked, FUSED, probes)
    lists = lexical(procedures, asked, FUSED).select("query", "id", "rank").unionAll(near.select("query", "id", "rank"))
    fused = _best(lists.groupBy("query", "id").agg(F.round(F.sum(1 / (F.col("rank") + RRF)), 9).alias("score")), n)
    kinds = [("procedure", procedures, fused, 1.0), ("symbol", symbols, lexical(symbols, asked, SYMBOLS), SHARE), ("structure", structures, lexical(structures, asked, STRUCTURES), SHARE)]
    out = None
    for nr, (kind, entries, found, share) in enumerate(kinds):
        own = entries.select("id", "file", "name").join(found, "id")
        own = own.select("query", F.lit(nr).alias("nr"), F.lit(kind).alias("kind"), "id", "file", "name", (F.col("score") * share).alias("score"), F.col("rank").alias("place"))
        out = own if out is None else out.unionAll(own)
    same = Window.partitionBy("query", "file", "name").orderBy("nr", "place", "id")
    order = Window.partitionBy("query").orderBy("nr", "place", "id")
    kept = out.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return kept.withColumn("rank", F.row_number().over(order)).select("query", "rank", "kind", "id", "file", "name", "score")
