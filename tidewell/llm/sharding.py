"""Sharding by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of (doc_id, checksum, size). A Feistel network over the smallest even
number of bits that holds the row count, with cycle walking back into the range, permutes the numbers. The
permuted number p gives shard p mod n and slot p div n, so both are computable from a row number and the
inverse gives the row number of any (shard, slot) without a lookup. Shard sizes differ by one row at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.shipping import ship
from tidewell.llm.shared import text_or_empty, written

ROUNDS = 6
PRIME = 2**31 - 1


class RowShuffle:
    """A permutation of range(n), n below 2**60, that the seed decides."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        words = [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "little") for i in range(3 * ROUNDS)]
        self.keys = [(words[3 * i] % (PRIME - 1) + 1, words[3 * i + 1] % PRIME, words[3 * i + 2] % PRIME) for i in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
        a, b, c = key
        t = (x * a + b) % PRIME
        return (((t * t) % PRIME + (t ^ c)) * 40503 >> 7) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._round(left, key), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, dtype=np.int64))
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = step(out[outside])
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Permuted numbers of row numbers in range(n)."""
        return self._walk(rows, self._once)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        """Row numbers of permuted numbers in range(n)."""
        return self._walk(places, self._back)

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number in a slot of a shard."""
        place = slot * shards + shard
        if not (0 <= shard < shards and 0 <= place < self.n):
            raise IndexError(f"shard {shard} has no slot {slot}")
        return int(self.inverse(np.array([place]))[0])


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_number, gapless from 0 in the given order, and the number of rows.

    A range shuffle sorts the rows; only one count per partition goes to the driver. Rows that are equal in the
    order columns take any order among each other; the position in the scan splits them over partitions.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "row-numbers")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((int(p), total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part long, _start long")
    numbered = ordered.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part")
    return numbered.withColumn("row_number", F.col("_start") + place).drop("_part", "_start", "_at"), total


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot and grown_shard of every row of df (doc_id, text).

    The law is `rows`: shard sizes differ by one row at most, so grown_shard is null. size counts the UTF-8 bytes
    of the text and one more; a null text has no bytes and the checksum of the empty text. Repeated rows each get
    a slot; a null doc_id sorts first. Texts of any length are read whole for their size and checksum. An empty df gives an empty
    result. Other columns are ignored.
    """
    text = text_or_empty()
    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = row_numbers(narrow, ["doc_id", "text_crc32", "size"])
    shuffle = RowShuffle(total, seed)
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(shuffle.forward(rows.to_numpy()))

    placed = numbered.withColumn("_place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
