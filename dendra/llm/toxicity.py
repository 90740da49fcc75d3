"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Counts cover every training row and are summed in the cluster; the linear weights are fitted on a
bounded, hash-drawn sample of the training rows (`max_fit_rows`); every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, arrow_map, bound_batches, checkpoint, give_back_memory

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Count vectors are summed in blocks of so many buckets.
BLOCK = 1 << 14
#: Bytes of text that are turned into n-grams at once.
PIECE = 1 << 20
FOLDS = 5
#: Labels are broadcast up to so many rows (16 bytes each); a larger table is joined by shuffling.
BROADCAST_LABELS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[ord(c) for c in SPACES]] = True


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a whole text: bytes, A-Z in lower case, each run of spaces as one, one space around.

    Repeats are included up to PIECE bytes; a longer text is taken in overlapping pieces and gives each bucket once.
    """
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", dtype=np.uint8)
    blank = _SPACES[raw]
    raw = np.where(blank, np.uint8(32), raw)[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(raw) <= PIECE:
        return _grams(raw, len(raw))
    return np.unique(np.concatenate([np.unique(_grams(raw[a : a + PIECE + max(ORDERS) - 1], PIECE)) for a in range(0, len(raw), PIECE)]))


def _grams(raw: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first `starts` bytes."""
    raw, found = raw.astype(np.uint64), []
    rolled = np.zeros(len(raw), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            if n > len(raw):
                break
            rolled = rolled[: len(raw) - n + 1] * _BASE + raw[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                found.append(((rolled[:starts] * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int32)


def is_held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Model:
    """weights: of each bucket's presence, log-count ratio included; bias: of the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = ngram_buckets(text)
        found = np.unique(found[self.weights[found] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(dtype=np.float64), -50, 50))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, label, text) of labelled documents outside the held-out fold; a document with several labels counts as 1 if any is 1."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~is_held_out("doc_id"))
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    marked = checkpoint(marked)
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(marked, "id").select("id", "label", "text")


def count_presence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts, documents): in how many documents of label 0 and 1 each bucket occurs, over all rows.

    Each task emits its two count vectors in blocks; blocks are summed by key, so what one task holds is
    a block from each map task, and the driver gets 2 x BUCKETS sums whatever the input.
    """

    def counted(batches):
        counts, documents = np.zeros((2, BUCKETS), dtype=np.int32), np.zeros((2, 1), dtype=np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[label, np.unique(ngram_buckets(text.as_py()))] += 1
                documents[label] += 1
        if documents.any():
            held = [counts[:, b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(BUCKETS // BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(held)), -1], pa.int32()), pa.array([*held, documents.tobytes()], pa.binary())], ["block", "counts"])

    bound_batches(rows.sparkSession)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    parts = arrow_map(rows.select("label", "text").coalesce(tasks), counted, "block int, counts binary")

    def summed(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in tables:
            for row in batch.column("counts"):
                total = total + np.frombuffer(row.as_py(), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    counts, documents = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for block, values in parts.groupBy("block").applyInArrow(summed, "block int, counts binary").collect():
        sums = np.frombuffer(bytes(values), dtype=np.int64)
        if block < 0:
            documents = sums
        else:
            counts[:, block * BLOCK : (block + 1) * BLOCK] = sums.reshape(2, BLOCK)
    return counts, documents


def log_count_ratios(counts: np.ndarray, documents: np.ndarray, features: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ratios) of the `features` buckets whose log-count ratio stands out most from 0, in standard errors."""
    smooth = counts + alpha
    ratios = np.log(smooth[1] / (documents[1] + 2 * alpha)) - np.log(smooth[0] / (documents[0] + 2 * alpha))
    error = np.sqrt(1 / smooth[1] + 1 / smooth[0])
    stands = np.where(counts.sum(axis=0) > 1, np.abs(ratios) / error, 0)
    chosen = np.sort(np.argsort(-stands, kind="stable")[:features])
    return chosen[stands[chosen] > 0], ratios[chosen][stands[chosen] > 0]


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = 3e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over rows of present features, scaled by ratios; full-batch Adam from zero."""
    sizes = np.array([len(r) for r in rows])
    features = np.concatenate([*rows, np.empty(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weights = np.zeros(len(ratios) + 1)
    weights[-1] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        logits = np.bincount(owner, weights=(weights[:-1] * ratios)[features], minlength=len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels) / len(rows)
        slope = np.append(np.bincount(features, weights=error[owner], minlength=len(ratios)) * ratios + penalty * weights[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= rate * (1 - t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return weights[:-1] * ratios, float(weights[-1])


def train(rows: DataFrame, features: int = 2048, max_fit_rows: int = 20_000) -> Model:
    """Model from rows (id, label, text).

    Log-count ratios come from all rows. The linear weights are fitted on about `max_fit_rows` rows drawn
    by a hash of the id, reduced to the chosen features: the `features` n-grams that stand out most, which bounds what the driver
    holds; all others weigh 0; more than BUCKETS is an error. Without rows, or with rows of one label only, every text gets the smoothed share of label 1.
    """
    if not 0 < features <= BUCKETS:
        raise ValueError(f"features is {features}, of {BUCKETS} buckets")
    stored = "<u2" if features <= 1 << 16 else "<u4"
    counts, documents = count_presence(rows)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not documents.all():
        return Model(weights, float(np.log((documents[1] + 1) / (documents[0] + 2))))
    chosen, ratios = log_count_ratios(counts, documents, features)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    places = rows.sparkSession.sparkContext.broadcast(place)

    def reduced(batches):
        for batch in batches:
            texts = [places.value[ngram_buckets(t.as_py())] for t in batch.column(2)]
            kept = [np.unique(t[t >= 0]).astype(stored).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["id", "label", "found"])

    part = min(1.0, max_fit_rows / int(documents.sum()))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = arrow_map(drawn.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism), reduced, "id long, label int, found binary").collect()
    sample.sort(key=lambda r: (r.id, r.label, r.found))
    fitted, bias = fit_logistic([np.frombuffer(bytes(r.found), dtype=stored) for r in sample], np.array([r.label for r in sample], dtype=float), ratios)
    weights[chosen] = fitted
    return Model(weights, bias)


def scorer(spark, model: Model):
    """A column function text -> score that reads the model from a broadcast of 4 x BUCKETS bytes."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = pd.Series([sent.value.score(t) for t in texts], dtype="float64")
        give_back_memory()
        return found

    return score


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document.

    Only documents with a label and outside the held-out fold teach the model, by their text alone. A null
    text scores as an empty one; a very long text is scored as a whole, in pieces; a null doc_id is returned as null and counts as an empty id in the fold;
    repeated rows are scored each, equal texts equally, and a score of exactly 0.5 counts as toxic, so there are no ties; empty tables give an empty result or, without labels, a constant score.
    Other columns are not read, so their names can't clash.
    """
    model = train(training_rows(docs, labels, label), **options)
    score = scorer(docs.sparkSession, model)
    scored = docs.select("doc_id", is_held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs whose score is below the threshold (see score_documents); columns as they came, whatever their names.

    Null and empty texts are scored as empty ones and very long ones as a whole; a score equal to the threshold goes; rows with a null doc_id and repeated
    rows are judged like others; an empty table stays empty, and without labels the constant score decides.
    """
    score = scorer(docs.sparkSession, train(training_rows(docs, labels), **options))
    return docs.where(score(F.col("text").cast("string")) < threshold)
