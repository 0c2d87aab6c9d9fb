"""Language-model scoring with a log-bilinear neural model.

Spark counts all training tokens. Every token from a count on, which grows with the square root of the corpus, is
a unit of the model with vectors and a bias of its own; the other words, seen or not, share units by their
endings, and within such a unit a word has its add-one share. The score of a unit after two others is bilinear in
its own vector and the sum of the context's: one vector for the unit before, one for the cluster of the unit two
before. Each shard of the training texts trains the vectors in numpy by noise-contrastive estimation, one step
for every few thousand tokens, and Spark averages the shards' models, in rounds that together take each text
once. Sums over all units come from two matrix products for all contexts at once, so token probabilities are
normalised exactly: over all known tokens, and one share for all unknown ones with the same ending.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import lower_ascii, read, row_key, stored, text_of, words

END = ""  # the end of a text; no word is empty
HOT = 100_000  # tokens besides those with units whose counts every task holds; all others get theirs by a join
TAILS = 1024  # units by ending
HEAD = 8  # tokens with a unit of their own: those with sqrt(all tokens) / HEAD occurrences or more, and at least 2
FAR = 64  # clusters of the unit two before
DIMENSIONS, NOISE, BATCH = 32, 64, 1024
RATE, BIAS_RATE, FIRST_SEEN = 0.1, 0.01, 1.0  # steps of vectors and biases, over the root of the squared steps before
ROUNDS = ((0, 1), (1, 3), (3, 8))  # eighths of the texts, by hash
SHARD_TOKENS, MOST_SHARDS = 2_000_000, 1024  # a shard trains on about so many tokens, more where there would be too many shards
LEAST_TOKENS = 4_000_000  # a smaller corpus is taken several times
BLOCK = 512  # units whose vectors are averaged together
SLICE_BYTES = 1 << 20


def held_out(doc_id: str = "doc_id", parts: int = 7) -> Column:
    """Documents that nothing is learnt from: crc32 of the id's text leaves 2. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 2, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over whole texts, their ends included."""
    tokens = F.explode(F.concat(words(lower_ascii(text_of())), F.array(F.lit(END))))
    return docs.select(tokens.alias("token")).groupBy("token").agg(F.count("*").alias("c"))


def ending(token: Column) -> Column:
    """As in tasks: crc32 of the last three bytes of the word."""
    return F.crc32(F.substring(F.encode(token, "UTF-8"), -3, 3)) % TAILS


@dataclass
class Vocabulary:
    """Tokens with their places; unit and log count of each place; counts, and log10 of the add-one counts, of all units."""

    tokens: dict[bytes, int]
    units: np.ndarray
    log_counts: np.ndarray
    frequency: np.ndarray
    within: np.ndarray  # 0 for units of one token
    heads: int


def vocabulary(counts: DataFrame, hot: int = HOT) -> tuple[Vocabulary, int, int]:
    """The vocabulary, the number of training tokens and of distinct ones.

    Places 0 to heads - 1 are the tokens with units of their own, the end first. Other tokens whose counts tasks
    hold are those above a count that at most `hot` reach.
    """
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole.n or 0, whole.v
    least = max(2, math.ceil(math.sqrt(total) / HEAD))
    own = (F.col("c") >= least) | (F.col("token") == END)
    step = F.floor(F.log2("c") * 8)
    rest, room = None, hot
    for r in sorted(counts.where(~own).groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if r["count"] > room:
            break
        rest, room = r.step, room - r["count"]
    kept = counts.where(own | (step >= (1 << 40 if rest is None else rest)))
    rows = sorted(kept.select("token", "c", own.alias("own")).collect(), key=lambda r: (not r.own, r.token != END, -r.c, r.token))
    if not rows or rows[0].token != END:
        rows.insert(0, counts.sparkSession.createDataFrame([(END, 0, True)], "token string, c long, own boolean").first())
    heads = sum(r.own for r in rows)
    tails = {r.k: r for r in counts.where(~own).groupBy(ending(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (np.array([tails[k][x] if k in tails else 0 for k in range(TAILS)], float) for x in ("n", "v"))
    names = [r.token.encode() for r in rows]
    units = np.array([k if r.own else heads + zlib.crc32(t[-3:]) % TAILS for k, (r, t) in enumerate(zip(rows, names, strict=True))], np.int32)
    frequency = np.r_[[float(r.c) for r in rows[:heads]], n]
    within = np.r_[np.zeros(heads), np.log10(n + v + 1)]
    return Vocabulary({t: k for k, t in enumerate(names)}, units, np.log10(np.array([r.c for r in rows], float) + 1), frequency, within, heads), total, distinct


@dataclass
class Model:
    """A row of near and out, and a bias, for each unit; a row of far for each cluster; the cluster of each unit;
    the natural log of the sum over all units for each unit before and cluster two before (none while training).
    *_seen: squared steps of each row so far.
    """

    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    cluster: np.ndarray
    sums: np.ndarray | None
    near_seen: np.ndarray
    far_seen: np.ndarray
    out_seen: np.ndarray

    @staticmethod
    def fresh(frequency: np.ndarray, seed: int = 7) -> Model:
        rng, u = np.random.default_rng(seed), len(frequency)
        random = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
        small = lambda n: np.full(n, FIRST_SEEN, np.float32)
        bias = np.log((frequency + 1) / (frequency + 1).sum()).astype(np.float32)
        return Model(random(u), np.zeros((FAR, DIMENSIONS), np.float32), random(u), bias, np.zeros(u, np.int32), None, small(u), small(FAR), small(u))

    def log10(self, two: np.ndarray, one: np.ndarray, true: np.ndarray) -> np.ndarray:
        """Log10 probabilities of units after units."""
        far = self.cluster[two]
        score = np.einsum("nd,nd->n", self.near[one] + self.far[far], self.out[true]) + self.bias[true]
        return (score - self.sums[one, far]).astype(float) / math.log(10)


def read_units(vocab: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Of all tokens in a row: place (-1: none) and unit; where each text begins; each text's tokens without a place."""
    place, begins, missing, extra = [], [], [], []
    get = vocab.tokens.get
    for text in texts:
        own = text.lower().split()
        begins.append(len(place))
        at = [get(t, -1) for t in own]
        lost = [t for t, k in zip(own, at, strict=True) if k < 0] if -1 in at else []
        extra += [vocab.heads + zlib.crc32(t[-3:]) % TAILS for t in lost]
        missing.append(lost)
        place += at
        place.append(0)
    place = np.array(place, np.int32)
    units = vocab.units[place]
    units[place < 0] = extra
    return place, units, np.array(begins, np.int64), missing


def contexts(units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit two before and the one before each; before a text there are ends."""
    one = np.r_[0, units[:-1]]
    one[begins] = 0
    two = np.r_[0, one[:-1]]
    two[begins] = 0
    return two, one


def slices(batch: pa.RecordBatch, texts: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of a batch whose texts have about SLICE_BYTES in all."""
    raw = [t.encode() for t in batch.column(texts).to_pylist()]
    begin, size = 0, 0
    for k, t in enumerate(raw):
        size += len(t)
        if size >= SLICE_BYTES or k + 1 == len(raw):
            yield batch.slice(begin, k + 1 - begin), raw[begin : k + 1]
            begin, size = k + 1, 0


def _gathered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0]
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _moved(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """A step of each row, shortened by its squared steps so far."""
    seen[rows] += np.einsum("nd,nd->n", gradient, gradient) / gradient.shape[1]
    weights[rows] -= RATE * gradient / np.sqrt(seen[rows])[:, None]


class Trainer:
    """Noise-contrastive estimation: a unit must tell itself from NOISE drawn units by its score less the log of their expected number."""

    def __init__(self, model: Model, frequency: np.ndarray, seed: list[int], with_far: bool):
        self.m = replace(model, **{k: getattr(model, k).copy() for k in ("near", "far", "out", "bias", "near_seen", "far_seen", "out_seen")})
        self.rng, self.with_far = np.random.default_rng(seed), with_far
        share = (frequency + 1) ** 0.75
        share /= share.sum()
        self.edges, self.expected = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.near_met, self.out_met, self.far_met = np.zeros(len(share)), np.zeros(len(share)), np.zeros(FAR)

    def take(self, two: np.ndarray, one: np.ndarray, true: np.ndarray) -> None:
        order = self.rng.permutation(len(true))
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            self.step(self.m.cluster[two[k]], one[k], true[k])
        self.near_met += np.bincount(one, minlength=len(self.near_met))
        self.out_met += np.bincount(true, minlength=len(self.out_met))
        self.far_met += np.bincount(self.m.cluster[two], minlength=FAR)

    def step(self, far: np.ndarray, one: np.ndarray, true: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(m.bias) - 1)
        r = m.near[one] + m.far[far] if self.with_far else m.near[one]
        mine, others = m.out[true], m.out[noise]
        g = _sigmoid(np.einsum("nd,nd->n", r, mine) + m.bias[true] - self.expected[true]) - 1
        b = _sigmoid(r @ others.T + (m.bias[noise] - self.expected[noise]))
        back = g[:, None] * mine + b @ others
        rows, gradient = _gathered(np.r_[true, noise], np.c_[np.r_[g[:, None] * r, b.T @ r], np.r_[g, b.sum(0)]])
        _moved(m.out, m.out_seen, rows, gradient[:, :-1])
        m.bias[rows] -= BIAS_RATE * gradient[:, -1] / np.sqrt(m.out_seen[rows])
        _moved(m.near, m.near_seen, *_gathered(one, back))
        if self.with_far:
            _moved(m.far, m.far_seen, *_gathered(far, back))

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and float32 rows of each block: how often a row was met, and that times its weights and squared steps."""
        m = self.m
        for first, met, parts in ((0, self.near_met, (m.near, m.near_seen[:, None])), (1 << 30, self.out_met, (m.out, m.bias[:, None], m.out_seen[:, None])), (2 << 30, self.far_met, (m.far, m.far_seen[:, None]))):
            for at in range(0, len(met), BLOCK):
                n = (met[at : at + BLOCK] + 1e-3)[:, None]
                yield first + at // BLOCK, np.concatenate([n, *(n * p[at : at + BLOCK] for p in parts)], axis=1).astype(np.float32)


def _trained(docs: DataFrame, vocab: Vocabulary, model: Model, shards: int, passes: int, seed: int, with_far: bool) -> Model:
    """The mean of what the shards make of model, each row weighted by how often a shard has met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        trainer, kept = Trainer(model, vocab.frequency, [seed, shard], with_far), []
        for batch in batches:
            for _, texts in slices(batch, 0):
                _, units, begins, _ = read_units(vocab, texts)
                tokens = (*contexts(units, begins), units)
                trainer.take(*tokens)
                if passes > 1:  # the corpus is small
                    kept.append(tokens)
        for _ in range(passes - 1):
            for tokens in kept:
                trainer.take(*tokens)
        blocks = list(trainer.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([shard] * len(blocks), pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], names=["block", "shard", "rows"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(float) for x in rows.sort_values("shard")["rows"])
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "rows": [total.astype(np.float32).tobytes()]})

    parts = docs.coalesce(shards).mapInArrow(run, "block long, shard int, rows binary")
    found = parts.groupBy("block").applyInPandas(mean, "block long, rows binary").collect()  # the model, once
    blocks = {r.block: r.rows for r in found}

    def gathered(first: int, n: int, width: int) -> np.ndarray:
        rows = np.concatenate([np.frombuffer(blocks[first + at // BLOCK], np.float32) for at in range(0, n, BLOCK)]).reshape(n, width + 1)
        return rows[:, 1:] / rows[:, :1]

    u, d = len(vocab.frequency), DIMENSIONS
    near, out, far = gathered(0, u, d + 1), gathered(1 << 30, u, d + 2), gathered(2 << 30, FAR, d + 1)
    split = lambda x, *at: [np.ascontiguousarray(p) for p in np.split(x, at, axis=1)]
    (near, near_seen), (out, bias, out_seen), (far, far_seen) = split(near, d), split(out, d, d + 1), split(far, d)
    return replace(model, near=near, near_seen=near_seen[:, 0], out=out, bias=bias[:, 0], out_seen=out_seen[:, 0], far=far, far_seen=far_seen[:, 0])


def clusters(vectors: np.ndarray, weight: np.ndarray, k: int = FAR, steps: int = 10, seed: int = 7) -> np.ndarray:
    """The number of the nearest of k weighted means of the rows of vectors."""
    rng = np.random.default_rng(seed)
    centre = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False, p=weight / weight.sum())]
    for _ in range(steps):
        at = ((centre**2).sum(1) - 2 * vectors @ centre.T).argmin(1)
        mass = np.bincount(at, weight, len(centre))
        for c in np.nonzero(mass)[0]:
            centre[c] = np.average(vectors[at == c], axis=0, weights=weight[at == c])
    return at.astype(np.int32)


def _summed(spark: SparkSession, model: Model) -> Model:
    """model with its sums: sum over v of exp(near . out_v + bias_v) exp(far . out_v), for all contexts by matrix products."""
    units = len(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = model.far @ model.out.T
        top = far.max(1)
        far = np.exp(far - top[:, None]).T.copy()
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                near = model.near[some] @ model.out.T + model.bias
                high = near.max(1)
                sums = np.log(np.exp(near - high[:, None]) @ far) + high[:, None] + top
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([x.tobytes() for x in sums.astype(np.float32)], pa.binary())], names=["id", "sums"])

    found = spark.range(0, units, 1, max(1, min(256, units // 1024))).mapInArrow(run, "id long, sums binary").collect()
    rows = sorted(found, key=lambda r: r.id)
    return replace(model, sums=np.frombuffer(b"".join(r.sums for r in rows), np.float32).reshape(units, FAR))


def fitted(docs: DataFrame, vocab: Vocabulary, total: int) -> Model:
    """The model of the texts of docs, of `total` tokens in all. Each round trains on its share of the texts; far
    vectors join in once the first round's vectors of preceding units have been cut into clusters.
    """
    model = Model.fresh(vocab.frequency)
    texts = docs.select(F.pmod(F.xxhash64(row_key()), F.lit(8)).alias("eighth"), text_of().alias("text"))
    passes = max(1, -(-LEAST_TOKENS // max(total, 1)))
    for k, (low, high) in enumerate(ROUNDS if total else ()):
        share = texts.where((F.col("eighth") >= low) & (F.col("eighth") < high)).select("text")
        shards = min(MOST_SHARDS, max(1, total * (high - low) // 8 // SHARD_TOKENS))
        model = _trained(share, vocab, model, shards, min(passes, 64), k, k > 0)
        if k == 0:
            model = replace(model, cluster=clusters(model.near, np.sqrt(vocab.frequency + 1)))
    return _summed(docs.sparkSession, model)


def model_of(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, Vocabulary, Model, int, int]:
    """Stored token counts, vocabulary, model, number of tokens and of distinct ones of the texts of docs."""
    counts = stored(token_counts(docs))
    vocab, total, distinct = vocabulary(counts, hot)
    return counts, vocab, fitted(docs, vocab, total), total, distinct


def scorer(vocab: Vocabulary, model: Model) -> Callable[[list[bytes]], tuple]:
    """A function from texts to each one's number of tokens, of those with places, their log counts, the model's log10
    probability but for the counts of tokens without places, and these tokens.
    """

    def run(texts: list[bytes]) -> tuple:
        place, units, begins, missing = read_units(vocab, texts)
        known = place >= 0
        known[np.r_[begins[1:], len(place)] - 1] = vocab.log_counts[0] > 0  # the end is always at place 0
        logs = np.where(known, vocab.log_counts[place], 0.0)
        each = model.log10(*contexts(units, begins), units) - vocab.within[units] + np.where(units >= vocab.heads, logs, 0.0)
        return *(np.add.reduceat(x, begins) for x in (np.ones(len(place), np.int64), known.astype(np.int64), logs, each)), missing

    return run


def lm_scores(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: it has one token, its end. Counts, units and the model are learnt from all rows that
    are not held out; without any, no token is known. Repeated rows count and are scored as often. An empty table
    gives an empty result; other columns of docs are left out, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    counts, vocab, model, total, distinct = model_of(docs.where(~held_out()), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(vocab, model)
        for batch in batches:
            for part, texts in slices(batch, 3):
                *sums, missing = score(texts)
                own = [part.column(c) for c in ("row", "doc_id", "held_out")]
                rare = pa.array([[t.decode() for t in ts] for ts in missing], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, sums), rare], names=["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_logs", "model", "rare"])

    rows = docs.select(row_key().alias("row"), "doc_id", held_out().alias("held_out"), text_of().alias("text"))
    kind = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, hot_known long, hot_logs double, model double, rare array<string>"
    scored = stored(rows.mapInArrow(run, kind))
    # None of these tokens is frequent, so the join has no hot key.
    met = scored.select("row", F.explode("rare").alias("token")).join(counts, "token")
    rare = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known"))
    out = scored.drop("rare").join(rare, "row", "left").na.fill(0, ["rare_logs", "rare_known"])
    base = F.col("hot_logs") + F.col("rare_logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.col("rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("rare_logs")).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
