"""Quality scores by naive Bayes support vectors.

A text's features are indicators of the words and word pairs it has, hashed into
FEATURES slots. Each is scaled by the log-count ratio of its slot, counted over
all labelled documents: how much likelier it is in a document of label 1 than in
one of label 0. A linear model with hinge loss is fitted to the scaled indicators
by dual coordinate descent, and its weights are drawn towards their mean size, so
that the scaled counts alone speak where the model has seen little. A logistic
curve over the margins of documents that the model was not fitted to gives
scores.

A word equal to the one before is read as a sign of repetition, so that texts that
repeat any word share features.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import rows_of, small, to_batches, written
from lintora.llm.tokens import Learned

FEATURES = 1 << 18
#: Bounds of the sample that the model is fitted to: labelled documents, and
#: their features, of which it takes as many documents as fit.
MAX_DOCS, MAX_FEATURES = 16_384, 16_000_000
#: One document in so many of the sample is kept for the logistic curve.
CURVE = 5
PENALTY, EPOCHS, TOLERANCE = 1.0, 20, 0.01
#: Share of the fitted weights; the rest is their mean size.
OWN = 0.25
THRESHOLD = 0.3

_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_AGAIN, _STEP = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - FEATURES.bit_length() + 1)


def held_out(id_col: str) -> Column:
    """Documents whose labels nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Features:
    """Slots of texts; words are hashed once for each worker."""

    def __init__(self):
        self.known = Learned(lambda w: [xxhash.xxh64_intdigest(t, 7) | 2 for t in _TOKENS.findall(w)], 200_000)

    def of(self, text: str | None) -> np.ndarray:
        known, parts = self.known, (text or "").encode().split()
        words = np.array([h for p in parts for h in (known[p] if len(p) < 64 else known.learn(p))], np.uint64)
        if not len(words):
            return np.empty(0, np.int32)
        again = words[1:] == words[:-1]
        words[1:][again] = _AGAIN
        pairs = words[:-1] * _STEP + words[1:]
        return np.unique((np.concatenate([words, pairs]) * _STEP >> _SHIFT).astype(np.int32))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, text, label of the documents that have one and are not held out.
    An id with both labels has 0; rows that share an id share its label."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return texts.join(small(known), "doc_id").select("doc_id", "text", "label")


def _described(rows: DataFrame) -> DataFrame:
    """doc_id, label, slots (little-endian signed 32-bit) of labelled documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        rows = ((d, label, features.of(text).astype("<i4").tobytes()) for d, text, label in rows_of(batches))
        yield from to_batches(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("slots", pa.binary())]))

    return written(rows.mapInArrow(run, "doc_id long, label int, slots binary"), "labelled-slots")


def log_count_ratios(described: DataFrame) -> np.ndarray:
    """Of every slot, over all labelled documents: log of its share of the
    indicators of label 1 over that of label 0, each count with one more."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for label, slots in rows_of(batches):
            counts[label, np.frombuffer(slots, "<i4")] += 1
        found = np.flatnonzero(counts.any(0))
        for at in range(0, len(found), 65_536):
            part = found[at : at + 65_536]
            yield pa.record_batch([pa.array(part), *[pa.array(counts[k, part]) for k in (0, 1)]], names=["slot", "n0", "n1"])

    sums = described.select("label", "slots").mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = sums.toArrow()  # no more than FEATURES rows
    counts = np.ones((2, FEATURES))
    for k in (0, 1):
        counts[k, table["slot"].to_numpy()] += table[f"n{k}"].to_numpy()
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(slots: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS, tolerance: float = TOLERANCE, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model that minimises half their squares
    plus the penalised hinge losses, by dual coordinate descent in random order.
    Losses of the rarer label weigh more, so that both weigh the same in sum."""
    signs = np.where(labels > 0, 1.0, -1.0)
    share = np.array([np.mean(labels == 0), np.mean(labels > 0)])
    most = penalty / (2 * np.maximum(share, 1e-9))[(labels > 0).astype(int)]
    values = [ratios[x] for x in slots]
    squares = np.array([v @ v + 1 for v in values])
    weights, bias, duals, rng = np.zeros(len(ratios)), 0.0, np.zeros(len(slots)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(slots)).tolist():
            x, v, sign = slots[i], values[i], signs[i]
            slope = sign * (weights[x] @ v + bias) - 1
            new = min(max(duals[i] - slope / squares[i], 0.0), most[i])
            step = (new - duals[i]) * sign
            if step:
                worst = max(worst, abs(slope) if 0 < new < most[i] else abs(step) * squares[i])
                weights[x] += step * v
                bias += step
                duals[i] = new
        if worst < tolerance:
            break
    return weights, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton's method, labels drawn
    in from 0 and 1 by their numbers (Platt); a is not negative."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    want = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, np.abs(margins).mean())
    x = np.stack([margins / scale, np.ones(len(margins))])
    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((np.logaddexp(0, z) - want * z).sum() + 1e-3 * at[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
        gradient = x @ (p - want) + [2e-3 * at[0], 0]
        hessian = (x * (p * (1 - p))) @ x.T + np.diag([2e-3, 1e-9])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return (at[0] / scale, at[1]) if at[0] >= 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


@dataclass
class Model:
    """weights are of the plain indicators: those of the scaled ones times ratios."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() + self.bias)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -500, 500))))


def fit(slots: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, own: float = OWN) -> Model:
    """The model of a sample. With one label only, every score is near it."""
    labels = np.asarray(labels)
    kept = np.arange(len(slots)) % CURVE == 0
    for part in (kept, ~kept):
        if len(set(labels[part].tolist())) < 2:  # too few to keep some apart
            kept = np.zeros(len(slots), bool)
    train = np.flatnonzero(~kept)
    if len(set(labels[train].tolist())) < 2:
        n1, n0 = int((labels > 0).sum()), int((labels <= 0).sum())
        return Model(np.zeros(len(ratios)), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    weights, bias = descend([slots[i] for i in train], labels[train], ratios)
    used = np.count_nonzero(weights)
    weights = ratios * (own * weights + (1 - own) * np.abs(weights).sum() / max(1, used))
    model = Model(weights, bias, 1.0, 0.0)
    told = np.flatnonzero(kept) if kept.any() else train
    model.slope, model.shift = curve(np.array([model.margin(slots[i]) for i in told]), labels[told])
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """Counts over all labelled documents that are not held out, and a model
    fitted to a sample of them in the order of a hash: no more than max_docs, and
    no more than have max_features features together. The fit is one task."""
    described = _described(labelled(docs, labels, id_col, text_col, label_col))
    ratios = log_count_ratios(described)
    n = described.count()
    if not n:
        return Model(np.zeros(FEATURES), 0.0, 0.0, 0.0)
    order = F.pmod(F.xxhash64("doc_id", "slots"), F.lit(1 << 30))
    drawn = described.withColumn("order", order).filter(F.col("order") < min(1.0, (1.2 * max_docs + 100) / n) * (1 << 30))
    known = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, labels, total = [], [], 0
        for label, data in rows_of(batches):
            total += len(data) // 4
            if slots and (total > max_features or len(slots) >= max_docs):
                break
            slots.append(np.frombuffer(data, "<i4"))
            labels.append(label)
        if slots:
            model = fit(slots, np.array(labels), known.value)
            yield pa.record_batch([pa.array([model.weights.astype("<f8").tobytes()]), *[pa.array([float(x)]) for x in (model.bias, model.slope, model.shift)]], names=["weights", "bias", "slope", "shift"])

    one = drawn.repartition(1).sortWithinPartitions("order", "doc_id", "slots").select("label", "slots")
    row = one.mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(bytes(row["weights"]), "<f8"), row["bias"], row["slope"], row["shift"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher where label 1 is likelier) and predicted (1
    if score >= threshold) of every row, by its whole text alone.

    Null, empty and blank texts have no features; their score is that of the
    bias. Repeated rows and null ids are kept; other columns are ignored; no rows
    give no rows. A model without any label scores 0.5."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), known.value
        rows = ((d, own.score(features.of(text))) for d, text in rows_of(batches))
        yield from to_batches(rows, pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]), size=8192)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
