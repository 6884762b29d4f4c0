"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are the presence of hashed n-grams of three sequences: its lower-cased bytes (three in a row), its
character classes with runs of letters, digits and white space collapsed (four in a row), and its words seen as equal
or not to the word before (runs of up to five, any four flags). Indicators are scaled by the class log-count ratios, and a linear
hinge-loss model with squared loss is fitted on them by dual coordinate descent, on a bounded sample of labelled rows.
A logistic curve fitted on the same sample's out-of-fold margins turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.shared import few_rows, in_arrow, text_or_empty

SAMPLE_DOCS, SAMPLE_BYTES = 6000, 32 << 20  #: bounds of the training sample, in labelled documents and in bytes of their texts
BYTE_SLOTS, CLASS_SLOTS, RUN_SLOTS = 1 << 16, 1 << 14, 32
SLOTS = BYTE_SLOTS + CLASS_SLOTS + RUN_SLOTS
THRESHOLD = 0.3
SMOOTH, COST, EPOCHS, BLEND = 1.0, 1.0, 30, 0.25


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[9, 10, 11, 12, 13]] = ord(" ")
    return out


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    return out


CLASS_OF, LOWER, COLLAPSED = _classes(), _lower(), np.isin(np.arange(256), list(b"aA0 "))


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int32)


class Features:
    """Feature ids of texts; holds one scratch mask, so use one per worker."""

    def __init__(self):
        self.seen = np.zeros(SLOTS, bool)

    def _repeats(self, text: bytes) -> np.ndarray:
        """Slots of the n-grams over the flags that tell a word equal to the word before."""
        words = text.split()
        same = np.fromiter((x == y for x, y in zip(words, words[1:])), np.uint8, max(0, len(words) - 1))
        out = np.zeros(RUN_SLOTS, bool)
        run = same
        for length in range(1, 6):
            if not run.any():
                break
            out[length] = True
            run = run[:-1] & same[length:]
        if len(same) >= 4:
            out[16 + ((same[:-3] << 3) | (same[1:-2] << 2) | (same[2:-1] << 1) | same[3:])] = True
        return out

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct feature ids of a whole text."""
        raw = np.frombuffer(text, np.uint8)
        seen = self.seen
        seen[:] = False
        if len(raw) >= 3:
            low = LOWER[raw].astype(np.uint32)
            seen[_slots((low[:-2] << 16) | (low[1:-1] << 8) | low[2:], 16)] = True
        kinds = CLASS_OF[raw]
        if len(kinds) > 1:
            kinds = kinds[np.concatenate(([True], (kinds[1:] != kinds[:-1]) | ~COLLAPSED[kinds[1:]]))]
        if len(kinds) >= 4:
            k = kinds.astype(np.uint32)
            seen[BYTE_SLOTS + _slots((k[:-3] << 24) | (k[1:-2] << 16) | (k[2:-1] << 8) | k[3:], 14)] = True
        seen[BYTE_SLOTS + CLASS_SLOTS :] = self._repeats(text)
        return np.flatnonzero(seen).astype(np.int32)


@dataclass
class NBSVM:
    weights: np.ndarray  # by slot, the ratio multiplied in
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() / np.sqrt(max(1, len(ids))))

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of each feature's share among the indicators of class 1 over its share among those of class 0."""
    shares = []
    for label in (1, 0):
        count = np.full(SLOTS, SMOOTH)
        for r, y in zip(rows, labels):
            if y == label:
                count[r] += 1
        shares.append(count / count.sum())
    return np.log(shares[0] / shares[1])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 0, squared: bool = True) -> np.ndarray:
    """Weights of the linear model with squared or plain hinge loss; labels are -1 or 1, cost is by row."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    shrink = 1 / (2 * cost) if squared else np.zeros(len(rows))
    most_alpha = np.full(len(rows), np.inf) if squared else cost  # a plain hinge bounds the dual variables
    square = np.maximum(np.array([v @ v for v in values]) + shrink, 1e-12)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            gradient = labels[i] * (w[rows[i]] @ values[i]) - 1 + shrink[i] * alpha[i]
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == most_alpha[i] else gradient
            most = max(most, abs(projected))
            if projected:
                after = min(max(alpha[i] - gradient / square[i], 0), most_alpha[i])
                w[rows[i]] += (after - alpha[i]) * labels[i] * values[i]
                alpha[i] = after
        if most < 1e-3:
            break
    return w


def _fit_weights(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    ratio = log_count_ratios(rows, y)
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    balance = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    w = dual_coordinate_descent(rows, values, np.where(y == 1, 1.0, -1.0), COST * balance, SLOTS)
    mean = np.abs(w).mean()  # pulls the weights towards naive Bayes
    return ((1 - BLEND) * mean + BLEND * w) * ratio


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margins.std() or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def train(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> NBSVM:
    """A model from feature ids and labels 0 or 1; with one class alone, its share for every text."""
    y = np.asarray(labels)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return NBSVM(np.zeros(SLOTS), 1.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        train_on = np.flatnonzero(fold != k)
        part = NBSVM(_fit_weights([rows[i] for i in train_on], y[train_on]), 1, 0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    slope, offset = _curve(margins, y)
    return NBSVM(_fit_weights(rows, y), slope, offset)


def held_out(column: str = "doc_id"):
    """Documents that training never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame) -> NBSVM:
    """A model of labels (doc_id, quality) from a bounded sample of labelled documents of df (doc_id, text).

    The sample is the first SAMPLE_DOCS labelled documents by a hash of the doc_id, of which those are taken that fit into SAMPLE_BYTES, whole.
    Of rows that repeat a doc_id the least text is used. Rows of one document with different labels count as label 0; other values than
    0 and 1 are left out.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = df.groupBy("doc_id").agg(F.max(F.octet_length(text_or_empty())).alias("size")).join(marked, "doc_id")
    first = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("doc_id", "quality", "size").collect()
    chosen, room = [], SAMPLE_BYTES
    for doc_id, quality, size in first:
        if size <= room:
            room -= size
            chosen.append((doc_id, quality))
    ids = F.broadcast(few_rows(df.sparkSession, chosen, "doc_id long, quality int"))  # SAMPLE_DOCS rows at most
    rows = df.join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min(text_or_empty()).alias("text"))
    sample = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            ids = [features.of(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())], names=["doc_id", "quality", "ids"])

    rows = in_arrow(sample, run, "doc_id long, quality int, ids binary").collect()
    rows = sorted((r["doc_id"], r["quality"], bytes(r["ids"])) for r in rows)
    return train([np.frombuffer(i, np.int32) for _, _, i in rows], np.array([q for _, q, _ in rows], int))


def with_scores(df: DataFrame, model: NBSVM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry and quality_score of every row of df (doc_id, text)."""
    out = [*dict.fromkeys(["doc_id", *carry])]
    narrow = df.select(*out) if "text" in out else df.select(*out, F.col("text").alias("_text"))  # a carried text is sent once
    at_text = out.index("text") if "text" in out else len(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            margins = np.array([model.margin(features.of(t.as_py() or b"")) for t in batch.column(at_text).cast(pa.binary())], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(model.score(margins), pa.float64())], names=[*out, "quality_score"])

    return in_arrow(narrow, run, T.StructType([*narrow.schema.fields[: len(out)], T.StructField("quality_score", T.DoubleType())]))


def score(df: DataFrame, labels: DataFrame | None = None, model: NBSVM | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD) of every row of df (doc_id, text).

    Without a model one is fitted on labels (doc_id, quality). Null and empty texts get the score of a text without
    n-grams; without usable labels every score is 0.5. Texts are read whole, however long. Repeated rows stay repeated; a null
    doc_id is scored and never trained on; an empty df gives an empty result; other columns are ignored.
    """
    model = model or fit(df, labels)
    scored = with_scores(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    score = F.col("quality_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
