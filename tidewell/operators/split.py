"""Reproducible split of subjects."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.numbering import hash_rank
from tidewell.sources.tables import read_metadata

TRAIN, VALID = "0.64D", "0.80D"


def order_key(subject: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(subject).cast("string")))


def split_subjects(subjects: DataFrame, seed: int, subject: str = "subject_id") -> DataFrame:
    """subject, place and split (train, valid, test: 64, 16 and 20 of 100) in the order of a seeded hash.

    Null subjects go.
    """
    if seed < 0:
        raise ValueError("the seed is 0 or more")
    distinct = subjects.select(subject).filter(F.col(subject).isNotNull()).distinct()
    ranked = hash_rank(distinct, order_key(subject, seed), subject)
    part = F.when(F.col("place") < F.expr(f"floor({TRAIN} * n)"), "train").when(F.col("place") < F.expr(f"floor({VALID} * n)"), "valid").otherwise("test")
    return ranked.select(subject, "place", part.alias("split"))


def check_seed_file(spark: SparkSession, path: str, seed: int) -> bool:
    """check_seed() on stored metadata; missing metadata or a missing seed is warned about."""
    fine = check_seed(read_metadata(spark, path), seed)
    if not fine:
        warnings.warn(f"{path} names no split seed; the split can't be checked", stacklevel=2)
    return fine


def check_seed(stored: dict | None, seed: int) -> bool:
    """True if stored run metadata has the seed; False, for the caller to warn, if it has none; raises if it differs."""
    if not stored or stored.get("split_seed") is None:
        return False
    if int(stored["split_seed"]) != int(seed):
        raise ValueError(f"the split was made with seed {stored['split_seed']}, not {seed}")
    return True
