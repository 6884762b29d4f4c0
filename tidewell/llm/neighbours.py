"""Approximate nearest neighbours from randomly rotated one-bit codes.

Rows are split over coarse lists by their nearest centroid; the centroids are fitted on a bounded sample. In a
list, the residual of a vector to the centroid is normalised, padded with zeros to the code length, rotated by a random
orthogonal matrix and reduced to its signs, kept as packed bits with two correction scalars: the residual's length and
its inner product with its own code. A query's rotated residual is quantised to four bit planes, so that inner products
with codes are popcounts. The codes give an estimate of each squared distance and, with the correction scalars, an error
bound. Vectors whose lower bound lies within the k-th smallest upper bound are reranked by exact distance in doubles.

A query visits a list unless the triangle inequality shows that no vector of it can be nearer than its k-th nearest
vector of a bounded sample, so lists cost no recall; on vectors without clusters that prunes little, and `share` may
then bound the lists visited at some loss of recall.

Queries meet vectors list by list, in blocks of both, so a task holds one block of each however full a list is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.shipping import ship
from tidewell.llm.shared import written

SAMPLE_ROWS = 20_000  #: bound of the sample that the centroids are fitted on
BOUND_ROWS = 2_000  #: rows of that sample that bound a query's k-th distance
MOST_LISTS = 4096
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
CODE_BITS = 256  #: least code length; longer vectors have one bit for each component
PLANES = 4
SPREAD = 2.5  #: standard deviations of the estimate that the error bound covers


@dataclass
class Coarse:
    """Centroids and the rotation (components by code bits)."""

    centroids: np.ndarray
    rotation: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)[None, :], 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)
        for at in range(0, len(x), 2048):
            out[at : at + 2048] = self.distances(x[at : at + 2048]).argmin(1)
        return out


def fit_coarse(sample: np.ndarray, rows: int, seed: int = 0) -> Coarse:
    """k-means on the sample; the number of lists grows as the square root of the rows, at most MOST_LISTS."""
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(MOST_LISTS, len(sample) // 8, round(rows**0.5 / 2))))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(8):
        own = Coarse(centroids, None).nearest(sample)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=lists)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled][:, None]
    d = sample.shape[1]
    bits = -(-max(CODE_BITS, d) // 64) * 64
    return Coarse(centroids, np.linalg.qr(rng.standard_normal((bits, bits)))[0][:d])


def kth_bound(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of the distance to the k-th nearest other vector, from distinct vectors of a sample."""
    out = np.full(len(queries), np.inf)
    for i, query in enumerate(queries):
        gap = sample - query
        far = (gap * gap).sum(1)
        far = far[far > 0]
        if len(far) >= k:
            out[i] = np.sqrt(np.partition(far, k - 1)[k - 1]) * (1 + 1e-12)
    return out


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans, a multiple of 64, as rows of 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)


@dataclass
class Codes:
    """One-bit codes of a block of vectors about one centroid, with their correction scalars."""

    words: np.ndarray
    ones: np.ndarray
    length: np.ndarray
    fit: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> Codes:
        residual = vectors - centroid
        length = np.sqrt((residual * residual).sum(1))
        unit = (residual / np.where(length > 0, length, 1)[:, None]) @ rotation
        signs = unit > 0
        fit = np.abs(unit).sum(1) / np.sqrt(rotation.shape[1])
        return cls(pack(signs), signs.sum(1), length, np.where(fit > 0, fit, 1.0))

    def estimates(self, queries: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances (queries, vectors) and their error bounds."""
        bits = rotation.shape[1]
        residual = queries - centroid
        size = np.sqrt((residual * residual).sum(1))
        unit = (residual / np.where(size > 0, size, 1)[:, None]) @ rotation
        low = unit.min(1)
        step = np.maximum((unit.max(1) - low) / (2**PLANES - 1), 1e-30)
        levels = np.rint((unit - low[:, None]) / step[:, None]).astype(np.uint8)
        total = np.zeros((len(queries), len(self.words)), np.int32)
        for plane in range(PLANES):
            masks = pack((levels >> plane) & 1 == 1)
            for w in range(self.words.shape[1]):
                total += np.bitwise_count(masks[:, w, None] & self.words[None, :, w]).astype(np.int32) << plane
        # <signs as +-1, quantised query>: twice the sum over the one bits less the sum over all
        over_ones = low[:, None] * self.ones[None, :] + step[:, None] * total
        over_all = low * bits + step * levels.sum(1, dtype=np.int64)
        inner = (2 * over_ones - over_all[:, None]) / (np.sqrt(bits) * self.fit)[None, :]
        spread = np.sqrt(np.maximum(0, 1 - self.fit**2) / (bits - 1))
        error = SPREAD * np.hypot(spread[None, :], step[:, None] / np.sqrt(12)) / self.fit[None, :]
        scale = 2 * size[:, None] * self.length[None, :]
        return (self.length**2)[None, :] + (size**2)[:, None] - scale * inner, scale * error


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, coarse: Coarse, at: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its k nearest vectors of a block of list `at`, by the bounds."""
    codes = Codes.of(vectors, coarse.centroids[at], coarse.rotation)
    out = []
    lanes = max(1, 500_000 // len(ids))
    for start in range(0, len(queries), lanes):
        part = queries[start : start + lanes]
        middle, error = codes.estimates(part, coarse.centroids[at], coarse.rotation)
        upper = bounds[start : start + lanes] ** 2
        if len(ids) > k:
            upper = np.minimum(upper, np.partition(middle + error, k - 1, axis=1)[:, k - 1])
        near = middle - error <= upper[:, None]
        for i, query in enumerate(part):
            rows = np.flatnonzero(near[i])
            gap = vectors[rows] - query
            exact = np.sqrt((gap * gap).sum(1))
            order = np.lexsort((ids[rows], exact))[:k]
            out.append((ids[rows][order], exact[order]))
    return out


def usable_vectors(df: DataFrame) -> DataFrame:
    """vec_id and the vector in doubles; rows that are null, zero or hold null or non-finite components are left out."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def nearest_neighbours(df: DataFrame, k: int = 10, every: int = 100, share: float = 1.0, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row whose vec_id is divisible by `every`.

    df needs vec_id and embedding (array of numbers, one length for all); a vector of another length than most of the
    sample takes no part, like one that is null, zero or holds a null or non-finite component. Candidates are all
    other rows; score is the Euclidean distance on the original vectors, ties go to the smaller vec_id. Equal vectors
    are coded once and stand for their k + 1 smallest vec_ids, which no query can exceed. A repeated vec_id counts
    once per distinct vector. An empty df gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    rows = usable_vectors(df)
    class_of = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = written(rows.distinct().withColumn("place", class_of).filter(F.col("place") <= k + 1), "vectors")
    distinct = members.filter("place = 1").select(F.col("vec_id").alias("rep"), "vector")
    drawn = distinct.orderBy(F.xxhash64("rep", F.lit(seed))).limit(SAMPLE_ROWS).select("vector").toArrow().column(0)
    sample = [v.values.to_numpy() for v in drawn]
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out_schema)
    width = int(np.bincount([len(v) for v in sample]).argmax())
    sample = np.array([v for v in sample if len(v) == width])
    coarse = fit_coarse(sample, distinct.count(), seed)
    lists = len(coarse.centroids)
    most = max(1, int(np.ceil(share * lists)))
    distinct = distinct.filter(F.size("vector") == width)

    @F.pandas_udf("list int, radius double")
    def own_list(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, width))
        own = coarse.nearest(x)
        gap = x - coarse.centroids[own]
        return pd.DataFrame({"list": own, "radius": np.sqrt((gap * gap).sum(1))})

    listed = written(distinct.withColumn("own", own_list("vector")).select("rep", "vector", "own.*"), "listed")
    # one row for each list, at most MOST_LISTS
    fill = {r["list"]: r for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()}
    radius = np.array([fill[i]["radius"] if i in fill else -np.inf for i in range(lists)])
    few = sample[:BOUND_ROWS]

    @F.pandas_udf("bound double, lists array<int>")
    def visited(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, width))
        bound = kth_bound(x, few, k)
        least = np.sqrt(coarse.distances(x)) - radius[None, :] - 1e-6
        order = np.argsort(coarse.distances(x), axis=1, kind="stable")[:, :most]
        return pd.DataFrame({"bound": bound, "lists": [[int(i) for i in o if row[i] <= b] for o, row, b in zip(order, least, bound)]})

    asking = written(
        rows.filter(F.col("vec_id") % every == 0).filter(F.size("vector") == width).groupBy("vector").agg(F.min("vec_id").alias("query")), "queries"
    )
    probes = asking.withColumn("v", visited("vector")).select("query", "vector", "v.bound", F.explode("v.lists").alias("list"))
    probes = written(probes, "probes")
    load = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    v_blocks = F.element_at(F.array(*(F.lit(-(-fill[i]["n"] // VECTOR_BLOCK) if i in fill else 1) for i in range(lists))), F.col("list") + 1)
    q_blocks = F.element_at(F.array(*(F.lit(-(-load.get(i, 0) // QUERY_BLOCK) or 1) for i in range(lists))), F.col("list") + 1)
    left = listed.withColumn("vb", F.pmod(F.xxhash64("rep"), v_blocks).cast("int")).select("list", "vb", F.explode(F.sequence(F.lit(0), q_blocks - 1)).alias("qb"), "rep", "vector")
    right = probes.withColumn("qb", F.pmod(F.xxhash64("query"), q_blocks).cast("int")).select("list", F.explode(F.sequence(F.lit(0), v_blocks - 1)).alias("vb"), "qb", "query", "bound", "vector")

    def meet(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, q = np.stack(vectors["vector"].to_numpy()), np.stack(queries["vector"].to_numpy())
        found = search_block(x, vectors["rep"].to_numpy(), q, queries["bound"].to_numpy(), coarse, key[0], k + 1)
        return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), [len(f[0]) for f in found]), "rep": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    met = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInPandas(meet, "query long, rep long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    near = written(met.withColumn("place", best).filter(F.col("place") <= k + 1).drop("place"), "near")
    # back from distinct vectors to rows
    first = members.filter("place = 1").select(F.col("vec_id").alias("rep"), "vector")
    of_rep = members.join(first, "vector").select("rep", "vec_id")
    asked = rows.filter(F.col("vec_id") % every == 0).distinct().join(asking, "vector").select("query", F.col("vec_id").alias("query_id"))
    pairs = asked.join(near, "query").join(of_rep, "rep").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
