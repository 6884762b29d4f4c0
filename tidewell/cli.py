"""Command line: `python -m tidewell.cli build | train | infer`."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.denoiser import AttentionDenoiser, Batch, make_batch
from tidewell.operators.forecast import DiffusionForecaster, schedule
from tidewell.operators.metrics import VALID_LEVELS
from tidewell.operators.numbering import shuffled_batches
from tidewell.operators.split import check_seed_file
from tidewell.plans import hospital
from tidewell.sources.tables import Config, find_artifact, read_items, read_metadata, write_artifact, write_metadata

log = logging.getLogger("tidewell")
MODEL = "model.bin"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidewell")
    out.add_argument("--config", help="settings, JSON or YAML")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="raw hospital tables to samples")
    build.add_argument("folder")
    build.add_argument("--items", required=True, help="feature and itemid, a CSV file")
    train = commands.add_parser("train", help="train the denoiser and score the test samples")
    train.add_argument("--model-folder", default="save/model")
    infer = commands.add_parser("infer", help="draws, predictions and metrics of the test samples")
    infer.add_argument("--checkpoint", required=True)
    infer.add_argument("--output-dir")
    infer.add_argument("--n-examples", type=int, default=3)
    infer.add_argument("--data-seed", type=int)
    for command in (build, train, infer):
        command.add_argument("--out", required=True, help="folder of the stages' tables")
        command.add_argument("--seed", type=int)
    for command in (train, infer):
        command.add_argument("--nsample", type=int, default=100)
    return out


def denoiser(config: Config, variables: int) -> AttentionDenoiser:
    """The model of the configured size."""
    d = config.diffusion
    return AttentionDenoiser(variables, d.channels, d.heads, d.layers, d.steps, config.seed, schedule(d.steps, d.beta_start, d.beta_end))


def epoch_batches(rows: DataFrame, seed: int, epoch: int, size: int) -> Iterator[Batch]:
    """The samples of an epoch in seeded batches, streamed to the driver."""
    order = shuffled_batches(rows.select("stay_id").distinct(), "stay_id", seed, epoch, size).select("stay_id", "batch", "slot")
    ordered = rows.join(order, "stay_id").orderBy("batch", "slot", "pos")
    held: list = []
    for row in ordered.toLocalIterator():
        if held and row["batch"] != held[0]["batch"]:
            yield _batch(held)
            held = []
        held.append(row)
    if held:
        yield _batch(held)


def _batch(rows: list) -> Batch:
    frame = pd.DataFrame([r.asDict() for r in rows])
    return make_batch([part for _, part in frame.groupby("slot")])


def run(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """One command; folders may be remote, since all is read and written through Spark.

    infer takes the settings and the data's seed that are stored with the model, unless others are named.
    """
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    path, content, stored = None, b"", {}
    if args.command == "infer":
        path, content = find_artifact(spark, args.checkpoint, MODEL)
        stored = read_metadata(spark, f"{path.rsplit('/', 1)[0]}/run.json") or {}
    config = Config.read(spark, args.config) if args.config else Config.from_dict(stored.get("config", {}))
    if args.seed is not None:
        config = replace(config, seed=args.seed)
    meta = f"{args.out}/run.json"
    if args.command == "build":
        tables = hospital.build(spark, args.folder, read_items(spark, args.items), args.out, config.seed, x_size=config.x_size)
        log.info("%d samples", tables["split"].count())
        write_metadata(spark, meta, config.metadata(split_seed=config.seed, stages=hospital.stage_counts(spark, args.out)))
        return
    data_seed = getattr(args, "data_seed", None)
    if data_seed is None:
        data_seed = stored.get("split_seed", config.seed)
    check_seed_file(spark, meta, data_seed)
    tables = hospital.stored(spark, args.out)
    model = denoiser(config, tables["variables"].count())
    d = config.diffusion
    forecaster = DiffusionForecaster(model, config.seed, beta=schedule(d.steps, d.beta_start, d.beta_end))
    if args.command == "train":
        train, t = hospital.model_rows(tables, "train"), config.train
        have_valid = not hospital.model_rows(tables, "valid").filter("is_target = 1").isEmpty()
        valid = (lambda: hospital.evaluate(tables, forecaster, 5, VALID_LEVELS, "valid").first()["crps"]) if have_valid else None
        losses = model.fit(lambda epoch: epoch_batches(train, config.seed, epoch, t.batch_size), valid, t.epochs, t.rate, patience=t.patience, seed=config.seed)
        log.info("last loss %f", losses[-1] if losses else float("nan"))
        write_artifact(spark, f"{args.model_folder}/{MODEL}", model.to_bytes())
        write_metadata(spark, f"{args.model_folder}/run.json", config.metadata(split_seed=data_seed, losses=losses))
        hospital.report(tables, forecaster, f"{args.model_folder}/test", args.nsample)
    else:
        model.from_bytes(content)
        hospital.report(tables, forecaster, args.output_dir or f"{path.rsplit('/', 1)[0]}/infer", args.nsample, args.n_examples)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    run()
