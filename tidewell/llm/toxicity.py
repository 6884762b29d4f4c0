"""Toxicity: class-conditional Kneser-Ney models of words read letter by letter.

A word's likelihood under a class is the product of its letters' (and its end's), each given the word's letters before it.
An interpolated Kneser-Ney model has for every class the number of documents in which a word's beginning was seen, discounted by
the count (a single sighting wholly), and hands the discounted mass to counts that both classes share: in how many documents of the
whole corpus the beginning was seen, labelled or not. Rare and unseen expressions therefore differ between the classes by
next to nothing, and inflected forms of a known stem differ as the stem does.

A document's toxic and ordinary log-likelihoods are compared word by word; the differences are normalised by the
number of words: their mean, what exceeds SMALL per word, and what exceeds LARGE per square root of the words. A logistic curve over these
three, fitted on out-of-fold differences, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.shared import in_arrow, text_or_empty, written

SAMPLE_DOCS = 10_000  #: bound of each class's training sample, in labelled documents
SAMPLE_BYTES = {1: 16 << 20, 0: 48 << 20}  #: and in bytes of their texts
THRESHOLD = 0.3
LONGEST_WORD = 10  #: letters of a word that are read
FOLDS = 3
SMALL, LARGE = 1.0, 3.0
KNOWN_WORDS = 300_000  #: differences that a task keeps at hand
NO_LETTERS = r"\P{L}+"
COUNTS = [f"{c}{k}" for c in ("t", "o") for k in range(FOLDS)]


def held_out(column: str = "doc_id") -> Column:
    """Documents whose labels and texts training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_words(df: DataFrame, *keys: str) -> DataFrame:
    """keys and word of every distinct word (its first LONGEST_WORD letters and an end mark) of each row of df (keys, text)."""
    words = F.transform(F.split(F.lower("text"), NO_LETTERS), lambda w: F.substring(w, 1, LONGEST_WORD))
    word = F.explode(F.array_remove(F.array_distinct(words), "")).alias("word")
    return df.select(*keys, word).select(*keys, F.concat("word", F.lit("$")).alias("word"))


def spaced_words(text: Column) -> Column:
    """The text's lower-cased words with a space between."""
    return F.regexp_replace(F.lower(text), NO_LETTERS, " ")


def beginnings(words: DataFrame, *counts: str) -> DataFrame:
    """id, parent and the summed counts of every beginning, the empty one too, of the words in words (word, counts).

    An id is the 64-bit hash of a beginning, its parent the id of the one without the last letter.
    """
    size = F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("size")
    each = words.select("word", *counts, size)
    part = lambda k: F.xxhash64(F.expr(f"substring(word, 1, {k})"))
    parent = F.when(F.col("size") > 0, part("size - 1"))
    return each.select(part("size").alias("id"), parent.alias("parent"), *counts).groupBy("id").agg(F.first("parent").alias("parent"), *(F.sum(c).alias(c) for c in counts))


@dataclass
class Differences:
    """Log of toxic over ordinary likelihood: of each known beginning's last letter, and of a letter unknown behind it."""

    ids: np.ndarray  # sorted
    step: np.ndarray
    beyond: np.ndarray

    def of(self, words: list[str]) -> np.ndarray:
        """The difference of each word, which ends with its end mark."""
        sums = np.zeros(len(words))
        if not len(self.ids):
            return sums
        raw = [w.encode() for w in words]
        ends = [[i for i in range(1, len(r)) if r[i] & 0xC0 != 0x80] + [len(r)] for r in raw]
        before = np.full(len(words), np.searchsorted(self.ids, _id(b"")))
        open_rows = np.arange(len(words))
        for k in range(LONGEST_WORD + 1):
            open_rows = open_rows[[k < len(ends[i]) for i in open_rows.tolist()]] if len(open_rows) else open_rows
            if not len(open_rows):
                break
            ids = np.array([_id(raw[i][: ends[i][k]]) for i in open_rows.tolist()], np.int64)
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            known = self.ids[at] == ids
            sums[open_rows[~known]] += self.beyond[before[open_rows[~known]]]
            sums[open_rows[known]] += self.step[at[known]]
            before[open_rows[known]] = at[known]
            open_rows = open_rows[known]
        return sums


def _id(text: bytes) -> int:
    """Spark's xxhash64 of a string."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >> 63 else value


def discounts(of_counts: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of beginnings with counts 1 to 4; a single count goes wholly."""
    n1, n2, n3, n4 = (max(1, n) for n in of_counts)
    y = n1 / (n1 + 2 * n2)
    return np.array([0, 1, np.clip(2 - 3 * y * n3 / n2, 1, 2), np.clip(3 - 4 * y * n4 / n3, 1, 3)])


def differences(ids: np.ndarray, parents: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> Differences:
    """From the counts of each beginning (ids sorted, the empty one among them, parents before their children known).

    Beginnings with single counts may be left out: their counts are discounted wholly.
    """
    if not len(ids):
        return Differences(ids, np.zeros(0), np.zeros(0))
    up = np.minimum(np.searchsorted(ids, parents), len(ids) - 1)
    child = ids[up] == parents
    back = np.where(child, shared / np.maximum(shared[up], 1), 1.0)
    logs, rests = [], []
    for count, cut in ((toxic, cuts[0]), (ordinary, cuts[1])):
        left = np.maximum(count - cut[np.minimum(count, 3)], 0.0)
        kept = np.bincount(up[child], left[child], len(ids))
        rest = np.where(count > 0, 1 - kept / np.maximum(count, 1), 1.0)  # the mass that goes to the shared counts
        own = np.where(count[up] > 0, left / np.maximum(count[up], 1), 0.0)
        logs.append(np.log(np.maximum(own + rest[up] * back, 1e-300)))
        rests.append(np.log(np.maximum(rest, 1e-300)))
    return Differences(ids, np.where(child, logs[0] - logs[1], 0.0), rests[0] - rests[1])


class Reader:
    """Features of texts, given as their words, under one model; keeps the differences of words that it has seen."""

    def __init__(self, model: Differences):
        self.model, self.known = model, {}

    def of(self, text: str) -> tuple[float, float, float]:
        words = text.split()
        if not words:
            return 0.0, 0.0, 0.0
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        fresh = list(set(words).difference(self.known))
        self.known.update(zip(fresh, self.model.of([w[:LONGEST_WORD] + "$" for w in fresh]).tolist()))
        d = np.fromiter(map(self.known.get, words), float, len(words))
        n = len(words)
        return float(d.mean()), float(np.log1p(20 * np.maximum(d - SMALL, 0).sum() / n)), float(np.log1p(np.maximum(d - LARGE, 0).sum() / np.sqrt(n)))


@dataclass
class Toxicity:
    model: Differences
    centre: np.ndarray
    weights: np.ndarray  # of the features, then the offset

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features - self.centre) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _curve(features: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and weights of a logistic curve over the features, by Newton steps with a small ridge."""
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    x = np.c_[(features - centre) / scale, np.ones(len(features))]
    ridge = 1e-2 * np.eye(x.shape[1])
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return centre, np.r_[b[:-1] / scale, b[-1]]


def sample_ids(df: DataFrame, labels: DataFrame) -> list[tuple[int, int, int]]:
    """doc_id, toxic and fold of the training sample.

    Each class has its first SAMPLE_DOCS labelled documents by a hash of the doc_id that fit into SAMPLE_BYTES, whole; the size of a doc_id
    that repeats is its largest row's. A document with several labels is toxic if one says so.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = df.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).join(marked, "doc_id")
    sizes = sizes.withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity")))
    out = []
    for toxic, room in SAMPLE_BYTES.items():
        first = sizes.filter(F.col("toxic") == toxic).orderBy("draw", "doc_id").limit(SAMPLE_DOCS).select("doc_id", "size").collect()
        for place, (doc_id, size) in enumerate(first):
            if size <= room:
                room -= size
                out.append((doc_id, toxic, place % FOLDS))
    return out


def fit(df: DataFrame, labels: DataFrame) -> Toxicity:
    """A model of labels (doc_id, toxic) from a bounded sample of labelled rows of df (doc_id, text); see sample_ids.

    Held-out documents take no part. Of rows that repeat a doc_id the least text is used. The shared counts are those of all
    documents that aren't held out. With one class alone every score is its share, without usable labels a half.
    """
    spark = df.sparkSession
    chosen = sample_ids(df, labels)
    y = np.array([t for _, t, _ in chosen], int)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        nothing = Differences(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return Toxicity(nothing, np.zeros(3), np.array([0, 0, 0, np.log(share / (1 - share))]))
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int, fold int"))  # 2 * SAMPLE_DOCS rows at most
    rows = df.filter(F.col("text").isNotNull()).join(ids, "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    rows = written(rows, "toxicity-sample")
    own = document_words(rows, "toxic", "fold").groupBy("word").agg(*(F.count_if((F.col("toxic") == c) & (F.col("fold") == k)).alias(name) for name, (c, k) in zip(COUNTS, [(c, k) for c in (1, 0) for k in range(FOLDS)])))
    total = lambda c: sum((F.col(f"{c}{k}") for k in range(FOLDS)), F.lit(0))
    own = written(beginnings(own, *COUNTS).withColumns({"t": total("t"), "o": total("o")}), "toxicity-counts")
    of = own.agg(*(F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in ("t", "o") for n in (1, 2, 3, 4))).first()
    cuts = tuple(discounts([of[f"{c}{n}"] for n in (1, 2, 3, 4)]) for c in ("t", "o"))
    corpus = document_words(df.filter(~held_out())).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    corpus = beginnings(corpus, "n").select("id", "n")
    # as many rows as the sample has beginnings in two documents of a class: bounded by its bytes
    table = own.filter("t > 1 or o > 1").join(corpus, "id").select("id", F.coalesce("parent", F.lit(0)).alias("parent"), "n", *COUNTS).toArrow()
    column = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(column["id"], kind="stable")
    column = {c: v[order] for c, v in column.items()}

    def without(fold: int | None) -> Differences:
        toxic, ordinary = (sum(column[f"{c}{k}"] for k in range(FOLDS) if k != fold) for c in ("t", "o"))
        return differences(column["id"], column["parent"], toxic, ordinary, np.maximum(column["n"], 1), cuts)

    folds = [without(k) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(m) for m in folds]
        for batch in batches:
            found = [readers[k].of(t) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            a, b, c = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.float64()) for v in (a, b, c))], names=["toxic", "a", "b", "c"])

    seen = in_arrow(rows.select("toxic", "fold", spaced_words(F.col("text")).alias("text")), run, "toxic int, a double, b double, c double").toArrow()  # a row for each of the sample's
    features = np.stack([seen.column(c).to_numpy() for c in "abc"], axis=1)
    marks = seen.column("toxic").to_numpy()
    order = np.lexsort((*features.T, marks))  # the curve doesn't depend on the order of rows
    centre, weights = _curve(features[order], marks[order])
    return Toxicity(without(None), centre, weights)


def with_scores(df: DataFrame, model: Toxicity, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in carry and toxicity_score of every row of df (doc_id, text)."""
    out = [*dict.fromkeys(["doc_id", *carry])]
    narrow = df.select(*out, spaced_words(text_or_empty()).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.model)
        for batch in batches:
            features = np.array([reader.of(t.as_py()) for t in batch.column(len(out))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(model.score(features), pa.float64())], names=[*out, "toxicity_score"])

    return in_arrow(narrow, run, T.StructType([*narrow.schema.fields[: len(out)], T.StructField("toxicity_score", T.DoubleType())]))


def score(df: DataFrame, labels: DataFrame | None = None, model: Toxicity | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= THRESHOLD) of every row of df (doc_id, text).

    Without a model one is fitted on labels (doc_id, toxic). Null and empty texts get the score of a text without words; without
    usable labels every score is 0.5. Texts are read whole, however long. Repeated rows stay repeated; a null doc_id is scored and never
    trained on; an empty df gives an empty result; other columns are ignored.
    """
    model = model or fit(df, labels)
    scored = with_scores(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    score = F.col("toxicity_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
