"""Learning operators: latent semantic indexing, nearest vectors, MLlib's tree ensembles and the rules in a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators import search
from sparquill.sources.shared import stored


#: A document with less than one part in so many of all terms is added term by term.
FEW = 12


def latent_index(docs: DataFrame, k: int = 20, min_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(term vectors, document vectors) of a truncated SVD over TF-IDF of the terms that min_share of all documents have.

    By the share, the number of terms is bounded by a document's different terms over it, whatever the corpus. Tasks
    sum their documents' products of term weights (numpy; documents of few terms touch only the products of these), Spark
    adds the tasks' sums row by row, from the diagonal on, and only that matrix of terms by terms is decomposed. Documents without such terms have the zero vector.
    """
    counts, df = search.term_table(docs)
    n_docs = docs.count()
    kept = sorted((-r.df, r.term) for r in df.where(F.col("df") >= min_share * n_docs).collect())  # frequent terms first: their products lie close together
    vocab = [(t, math.log(n_docs / -df)) for df, t in kept]
    n = len(vocab)
    spark = docs.sparkSession
    dim = spark.createDataFrame([(t, i, idf) for i, (t, idf) in enumerate(vocab)], "term string, nr int, idf double")
    weights = stored(counts.join(F.broadcast(dim), "term").select("doc_id", "nr", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w")))
    listed = F.array_sort(F.collect_list(F.struct("nr", "w")))
    vectors = weights.groupBy("doc_id").agg(listed.alias("x")).select("doc_id", F.col("x.nr").alias("nr"), F.col("x.w").alias("w"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        flat = total.reshape(-1)
        for batch in batches:
            nr, w = batch.column(1), batch.column(2)
            sizes = np.diff(nr.offsets.to_numpy())
            row, nr, w = np.repeat(np.arange(len(sizes)), sizes), nr.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()
            few = sizes * FEW <= n
            few[row[1:][(row[1:] == row[:-1]) & (nr[1:] == nr[:-1])]] = False  # a repeated document's term comes twice
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(few):
                i, v = nr[ends[k] - sizes[k] : ends[k]], w[ends[k] - sizes[k] : ends[k]]
                flat[(i[:, None] * n + i).ravel()] += (v[:, None] * v).ravel()
            many = np.flatnonzero(~few)
            for at in range(0, len(many), 512):
                own = many[at : at + 512]
                lo, hi = np.searchsorted(row, (own[0], own[-1] + 1))
                held = ~few[row[lo:hi]]
                dense = np.zeros((len(own), n))
                np.add.at(dense, (np.searchsorted(own, row[lo:hi][held]), nr[lo:hi][held]), w[lo:hi][held])
                total += dense.T @ dense
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x[i:].tobytes() for i, x in enumerate(total)], pa.binary())], names=["nr", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nr": [rows["nr"].iloc[0]], "sums": [sum(np.frombuffer(x) for x in rows["sums"]).tobytes()]})

    found = vectors.mapInArrow(products, "nr int, sums binary").groupBy("nr").applyInPandas(added, "nr int, sums binary").collect() if n else []
    gram = np.zeros((n, n))
    for r in found:
        gram[r.nr, r.nr :] = np.frombuffer(r.sums)
    values, columns = np.linalg.eigh(gram, UPLO="U")
    best = columns[:, np.argsort(-values)[:k]]
    best = best * np.where(best[np.abs(best).argmax(0), np.arange(best.shape[1])] < 0, -1.0, 1.0)  # the sign of a singular vector is free
    term_rows = spark.createDataFrame([(t, best[i].tolist()) for i, (t, _) in enumerate(vocab)], "term string, vector array<double>")
    place = spark.createDataFrame([(i, *best[i].tolist()) for i in range(n)], f"nr int, {', '.join(f'v{j} double' for j in range(best.shape[1]))}") if n else None
    if place is None:
        return term_rows, docs.select("doc_id", F.array().cast("array<double>").alias("vector"))
    sums = weights.join(F.broadcast(place), "nr").groupBy("doc_id").agg(*[F.sum(F.col("w") * F.col(f"v{j}")).alias(f"s{j}") for j in range(best.shape[1])])
    rows = docs.select("doc_id").join(sums, "doc_id", "left")
    return term_rows, rows.select("doc_id", F.array(*[F.coalesce(f"s{j}", F.lit(0.0)) for j in range(best.shape[1])]).alias("vector"))


def similar(vectors: DataFrame, column: str, to: list[float], n: int) -> DataFrame:
    """The n rows with the largest cosine to a vector."""
    norm = float(np.linalg.norm(to)) or 1.0
    dot = F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in to]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(column, F.when(own > 0, dot / (own * norm)).otherwise(0.0).alias("score")).orderBy(F.desc("score"), column).limit(n)


def similar_terms(terms: DataFrame, asked: str, n: int) -> DataFrame:
    """(term, score): the n terms whose vectors are most like that of a term, but for itself; none if it has no vector."""
    row = terms.where(F.col("term") == asked).first()
    return similar(terms.where(F.col("term") != asked), "term", row.vector if row else [0.0], n if row else 0)


def nearest_vectors(vectors: DataFrame, key: str, vector: str, queries: Column, n: int, block: int = 2048) -> DataFrame:
    """(query, key, score): for each row that `queries` selects the n other rows of the largest cosine, rounded to six places; ties by key.

    Exact. Rows are packed to blocks of about `block`, queries to blocks of a few times as many; each block of queries meets
    each block of rows in one matrix product. A task has some of the pairs and keeps each query's n best of these, so that of a
    further product only scores are looked at that are no worse; the best of the tasks' are the result.
    """
    rows = stored(vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull()))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()

    def packed(df: DataFrame, name: str, parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(f"{name}_part")
        return df.groupBy(part).agg(F.collect_list(F.struct("id", "v")).alias(name))

    packs = max(1, -(-counts.asked // (4 * block)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunk = F.pmod("rows_part", F.lit(max(1, -(-4 * cores // packs)))).alias("chunk")
    pairs = packed(rows, "rows", max(1, -(-counts.n // block))).crossJoin(packed(rows.where("asked"), "queries", packs)).select("rows", "queries", "queries_part", chunk)  # blocks, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for part, pair in zip(batch.column("queries_part").to_pylist(), zip(*(batch.column(c) for c in ("rows", "queries")), strict=True), strict=True):
                if part not in best:
                    best[part] = _Best(*_matrix(pair[1]), n)
                best[part].meet(*_matrix(pair[0]))
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.rows()], names=["query", "id", "score"])

    found = pairs.repartition(4 * cores, "queries_part", "chunk").mapInArrow(run, "query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("query", F.col("id").alias(key), "score")


class _Best:
    """The n best rows so far of each query: by score, rounded to six places, then id."""

    def __init__(self, asked: np.ndarray, vectors: np.ndarray, n: int):
        self.asked, self.vectors, self.n = asked, vectors, n
        self.ids, self.scores = np.zeros((len(asked), n), np.int64), np.full((len(asked), n), -np.inf)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(self.asked), 512):
            own = slice(start, start + 512)
            asked, scores, best = self.asked[own], self.scores[own], self.ids[own]
            score = self.vectors[own] @ rows.T
            least = scores[:, -1]
            if np.isinf(least).any() and len(ids) > self.n:  # nothing to compare with yet
                score[asked[:, None] == ids[None, :]] = -np.inf
                least = np.maximum(least, np.partition(score, -self.n, axis=1)[:, -self.n])
            q, r = np.nonzero(score >= least[:, None] - 1e-6)
            value, near = np.round(score[q, r], 6), ids[r]
            last = scores[q, -1]
            kept = (near != asked[q]) & np.isfinite(value) & ((value > last) | ((value == last) & (near < best[q, -1])))
            if not kept.any():
                continue
            q, value, near = q[kept], value[kept], near[kept]
            some = np.unique(q)
            of = np.concatenate([np.repeat(some, self.n), q])
            value, near = np.concatenate([scores[some].ravel(), value]), np.concatenate([best[some].ravel(), near])
            order = np.lexsort((near, -value, of))
            first = np.searchsorted(of[order], some)
            top = order[first[:, None] + np.arange(self.n)]
            scores[some], best[some] = value[top], near[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = np.isfinite(self.scores)
        return np.repeat(self.asked, self.n)[real.ravel()], self.ids[real], self.scores[real]


def _matrix(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors of length one, of a list of structs."""
    held = rows.values
    v = held.field("v")
    m = v.flatten().to_numpy().reshape(len(held), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return held.field("id").to_numpy(), m / np.where(norm > 0, norm, 1.0)


def forest(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 6, weight: str | None = None):
    """A random forest for one label; for several labels fit one each."""
    prepared = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    options = {"weightCol": weight} if weight else {}
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=10, seed=42, **options).fit(prepared)


def probabilities(model, rows: DataFrame, features: list[str], key: str) -> DataFrame:
    prepared = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return model.transform(prepared).select(key, vector_to_array("probability")[1].alias("p"))


def importances(model, features: list[str], n: int) -> list[tuple[str, float]]:
    found = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return found[:n]


def tree(rows: DataFrame, features: list[str], label: str, depth: int = 4) -> DecisionTreeClassificationModel:
    prepared = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return DecisionTreeClassifier(labelCol=label, maxDepth=depth, minInstancesPerNode=10).fit(prepared)


def tree_rules(model: DecisionTreeClassificationModel, features: list[str]) -> list[tuple[list[str], float]]:
    """(conditions, predicted class) of each leaf, read from the model's text."""
    out, path = [], []
    for line in model.toDebugString.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip()) - 2) // 1
        text = line.strip()
        path = [(d, c) for d, c in path if d < depth]
        if text.startswith(("If", "Else")):
            condition = text[text.index("(") + 1 : text.rindex(")")]
            for k in reversed(range(len(features))):
                condition = condition.replace(f"feature {k} ", f"{features[k]} ")
            path.append((depth, condition))
        elif text.startswith("Predict"):
            out.append(([c for _, c in path], float(text.split(":")[1])))
    return out
