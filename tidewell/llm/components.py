"""Connected components of an edge table by alternating star operations.

Least neighbours are summed by task first and written, so that their join with the edges is one of two tables: a node with very many
edges, as the least of a large component is, can then be dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; edges come as (larger, smaller)."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
    own = least.select("a", F.col("m").alias("b"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(own)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Rounds of the two star operations run until the edges no longer change; each round is written to the shared
    folder, and only a count and a checksum come to the driver. Edges in any direction, repeated edges and loops
    are allowed; rows with a null end are left out. No edges: an empty result.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
