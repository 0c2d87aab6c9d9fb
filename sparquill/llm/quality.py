"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on texts labelled good, one on bad ones. A text is compressed whole
with each. The difference of the two sizes, over the larger one, is the main feature; how well the text
compresses at all and how long it is tell how to read it. A logistic regression on these and their products,
fitted on labelled texts that no dictionary has seen, turns them into a probability.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import read, stored, text_of

#: Labelled rows that the fit takes of each class at most, by hash of doc_id.
FIT_ROWS = 3000
LEAST_TEXTS, FOLDS = 8, 4
DICTIONARY_BYTES = 1 << 18
SAMPLE_BYTES = 4000
LEVEL = 3
ACCEPT = 0.7
RIDGE = 0.02


@dataclass
class Model:
    """What tasks need: two dictionaries (none: every score is the prior), the fitted weights, the share of good labels."""

    bad: bytes
    good: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.bad, model.good):
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(pair: list[zstandard.ZstdCompressor], texts: list[bytes]) -> np.ndarray:
    rows = []
    for text in texts:
        bad, good = (len(c.compress(text)) for c in pair)
        rows.append(((bad - good) / max(bad, good), np.log(min(bad, good) / max(len(text), 1)), np.log(len(text) + 1)))
    return np.array(rows).reshape(-1, 3)


def design(x: np.ndarray) -> np.ndarray:
    """The difference d, the ratio r and the length n with their products, and a bend where texts repeat themselves."""
    d, r, n = x.T
    bend = np.minimum(r + 2.5, 0)
    return np.stack([d, r, n, d * r, d * n, r * n, d * d, r * r, n * n, bend, bend * n], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression (the first is the intercept), by Newton steps that never raise the loss."""
    a = np.c_[np.ones(len(x)), x]
    penalty = np.r_[0.0, np.full(x.shape[1], RIDGE)]
    w = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ (v * v))

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w, before = w + size * step, now
        now = loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def fit(docs: DataFrame, marks: DataFrame, most: int = FIT_ROWS) -> Model:
    """A model of docs (doc_id, text) marked by marks (doc_id, quality), one row for each id.

    Of each class at most `most` marked ids that docs has a text for are chosen, by hash. Only their texts are
    fetched, one for each id (the smallest), by a broadcast of those few ids. The dictionaries are made of all of
    them; the calibration sees each text measured by dictionaries made without it. With too few texts of a class
    there is no model, which is warned of.
    """
    marks = marks.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    totals = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    none = Model(b"", b"", np.zeros(11), np.ones(11), np.zeros(12), prior)
    full = docs.select("doc_id", text_of().alias("text")).where("text <> ''")
    here = stored(marks.join(full.select("doc_id").distinct(), "doc_id", "left_semi"))
    chosen = [tuple(r) for q in (0, 1) for r in here.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    few = docs.sparkSession.createDataFrame(chosen, marks.schema)
    rows = full.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    texts = {q: [r.text.encode() for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)) if r.quality == q] for q in (0, 1)}
    found = _crossed(texts, prior) if min(map(len, texts.values())) >= LEAST_TEXTS else None
    if found is None:
        warnings.warn("too few labelled texts of both classes for a quality model: every score is the share of good labels", stacklevel=2)
        return none
    model, x, y = found
    share = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = logistic((x - model.centre) / model.scale, y, share / share.mean())
    return model


def _dictionaries(texts: dict[int, list[bytes]], prior: float) -> Model | None:
    """Dictionaries of the texts of either class; none if zstandard finds them too few to make one."""
    samples = {q: [t[k : k + SAMPLE_BYTES] for t in ts for k in range(0, len(t), SAMPLE_BYTES)] for q, ts in texts.items()}
    try:
        bad, good = (zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, texts[q])) // 2), samples[q]).as_bytes() for q in (0, 1))
    except zstandard.ZstdError:
        return None
    return Model(bad, good, np.zeros(11), np.ones(11), np.zeros(12), prior)


def _crossed(texts: dict[int, list[bytes]], prior: float) -> tuple[Model, np.ndarray, np.ndarray] | None:
    """Dictionaries from all texts, and for the calibration the measures of each fold's texts by dictionaries from the others."""
    x, y = [], []
    for f in range(FOLDS):
        others = _dictionaries({q: [t for k, t in enumerate(ts) if k % FOLDS != f] for q, ts in texts.items()}, prior)
        if others is None:
            return None
        own = {q: ts[f::FOLDS] for q, ts in texts.items()}
        x.append(features(compressors(others), own[0] + own[1]))
        y.append(np.r_[np.zeros(len(own[0])), np.ones(len(own[1]))])
    model = _dictionaries(texts, prior)
    return model and (model, design(np.concatenate(x)), np.concatenate(y))


def score(model: Model, text: Column) -> Column:
    """The probability that a text is good; for an empty one, or without a dictionary, the share of good labels."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = compressors(model) if model.bad else None
        for texts in batches:
            raw = [t.encode() for t in texts]
            out = np.full(len(raw), model.prior)
            full = np.array([bool(t) for t in raw])
            if pair and full.any():
                x = (design(features(pair, [t for t in raw if t])) - model.centre) / model.scale
                z = np.clip(model.weights[0] + x @ model.weights[1:], -35, 35)
                out[full] = 1 / (1 + np.exp(-z))
            yield pd.Series(out)

    return run(text)


def held_out(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """Rows that no fit learns from: crc32 of the id's text leaves 2. A null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    marks = labels.where("quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return fit(docs, marks)


def classify(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from accept on); columns of these names are replaced.

    Whole texts are scored; a null one is empty. Repeated rows each get a row; an empty table an empty result.
    """
    scored = docs.withColumns({"held_out": held_out(), "score": score(model, text_of())})
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that are predicted good, with docs' own columns; all rows where no model could be fitted."""
    if not model.bad:
        warnings.warn("too few labelled texts of both classes for a quality model: all rows are accepted", stacklevel=2)
        return docs
    return docs.where(score(model, text_of()) >= accept)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
