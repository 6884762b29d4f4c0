"""Job 2: features of free-text notes as long event rows, split by subject and standardised.

    python -m jobs.note_features DOCUMENTS CONVERSATIONS OUT [--config jobs/note_features.json]

Notes are documents, whose subject is their source, and turns of conversations, whose subject is the conversation. A note that a
subject repeats in the same language counts once, under its least identifier. Each note gives a row for each variable: whether its text holds
one of a feature's keywords, and its words, numbers and characters. Subjects are split 64/16/20 by a seeded hash, statistics come
from the training part, and the rows are written to OUT/notes, by split and kind, with the statistics beside them. Running it again
replaces the same tables with the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import expressions as X
from tidewell.operators import normalise, split
from tidewell.operators.joins import small
from tidewell.sources.stages import write_stage

log = logging.getLogger("tidewell.jobs.note_features")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "note_features.json")


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def notes(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """kind, note_id, part, subject_id, lang and text of both sources; null texts go."""
    own = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("note_id"), F.lit(0).cast("long").alias("part"), F.concat(F.lit("s:"), "source").alias("subject_id"), "lang", "text")
    turns = conversations.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("note_id"), F.col("turn").cast("long").alias("part"), F.concat(F.lit("c:"), F.col("conv_id").cast("string")).alias("subject_id"), "text")
    return own.unionByName(turns, allowMissingColumns=True).filter("text IS NOT NULL AND subject_id IS NOT NULL")


def measures(text: Column, keywords: dict[str, list[str]]) -> dict[str, Column]:
    """Value of each variable of a text."""
    flags = {name: X.binary(X.contains_any(text, words).cast("double")) for name, words in sorted(keywords.items())}
    return {
        **flags,
        "words": F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("double"),
        "numbers": F.regexp_count(text, F.lit("[0-9]+")).cast("double"),
        "characters": F.char_length(text).cast("double"),
    }


def features(found: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """kind, note_id, part, subject_id, lang, variable and value; one row for each distinct note and variable.

    Only digests and measures are shuffled, no texts.
    """
    by_name = measures(F.col("text"), keywords)
    measured = found.select("kind", "note_id", "part", "subject_id", "lang", F.sha2("text", 256).alias("digest"), *(c.alias(f"_{n}") for n, c in by_name.items()))
    # the measures follow from the text, so any row of a group has them
    distinct = measured.groupBy("kind", "subject_id", "lang", "digest").agg(F.min(F.struct("note_id", "part")).alias("note"), *(F.max(f"_{n}").alias(f"_{n}") for n in by_name))
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("variable"), F.col(f"_{n}").alias("value")) for n in by_name)))
    return distinct.select("kind", F.col("note.note_id").alias("note_id"), F.col("note.part").alias("part"), "subject_id", "lang", rows)


def run(spark: SparkSession, documents: str, conversations: str, out: str, config: dict | None = None) -> DataFrame:
    """Write the notes' features below out and return them as read back.

    Columns are note_id, part, subject_id, lang, variable, value, score, split and kind; lang is null for conversations. Null texts and
    notes without a subject are left out, empty texts are notes. Without notes the result is empty. An interrupted run leaves nothing that the
    next one does not replace.
    """
    config = config or read_config()
    found = notes(spark.read.parquet(documents), spark.read.parquet(conversations))
    counts = {"documents": F.col("kind") == "document", "conversations": F.col("kind") == "conversation", "no_value": F.col("value").isNull()}
    write_stage(features(found, config["keywords"]), f"{out}/features", counts, none_of=("no_value",))
    rows = spark.read.parquet(f"{out}/features")
    parts = split.split_subjects(rows.select("subject_id"), config["seed"])
    write_stage(parts.select("subject_id", "split"), f"{out}/split")
    parts = spark.read.parquet(f"{out}/split")
    placed = rows.join(small(parts), "subject_id")
    write_stage(normalise.fit_stats(placed.filter("split = 'train'"), rows.select("variable")), f"{out}/stats")
    stats = spark.read.parquet(f"{out}/stats")
    scored = normalise.with_stats(placed, stats, "variable").withColumn("score", F.round(X.zscore(F.col("value"), F.col("mean"), F.col("std")), config["digits"]))
    final = scored.select("note_id", "part", "subject_id", "lang", "variable", "value", "score", "split", "kind")
    wrote = write_stage(final, f"{out}/notes", {"train": F.col("split") == "train", "valid": F.col("split") == "valid", "test": F.col("split") == "test"}, partition=("split", "kind"))
    log.info("read %s and %s, wrote %s", documents, conversations, wrote)
    return spark.read.schema(final.schema).parquet(f"{out}/notes")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Features of free-text notes as long event rows.")
    parser.add_argument("documents")
    parser.add_argument("conversations")
    parser.add_argument("out")
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("note_features").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.documents, args.conversations, args.out, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
