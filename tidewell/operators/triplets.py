"""Fixed-size masked triplets from samples of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

X_SIZE, Y_PER_TARGET, PAD_MINUTE = 60, 10, -1


def last_rows(rows: DataFrame, keys: list[str], order: list, keep: int) -> DataFrame:
    """The last `keep` rows of each key."""
    back = [F.col(c).desc() for c in order]
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))).filter(F.col("_place") <= keep).drop("_place")


def recent_rows(rows: DataFrame, sample: str, targets: list, interventions: list, size: int = X_SIZE, variable: str = "vind") -> DataFrame:
    """The last three rows of each target and the last of each intervention, of these the last `size` of a sample."""
    known = rows.filter(F.col(variable).isin([*targets, *interventions]))
    back = F.row_number().over(Window.partitionBy(sample, variable).orderBy(*(F.col(c).desc() for c in ("minute", variable, "pos"))))
    most = F.when(F.col(variable).isin(targets), 3).otherwise(1)
    kept = known.withColumn("_back", back).filter(F.col("_back") <= most).drop("_back")
    return last_rows(kept, [sample], ["pos"], size)


def padded(values, size: int, fill: float):
    """An array of doubles filled up to `size`."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(size) - F.size(values))))


def pad_tokens(variable, minute, mask, last_variable: int):
    """Variable and minute of padded places, where the mask is 0."""
    return F.when(mask == 1, variable).otherwise(F.lit(last_variable)), F.when(mask == 1, minute).otherwise(F.lit(PAD_MINUTE))


def _take_turns(counts, left, room, steps: int):
    """How many events each target gets while targets are filled evenly.

    counts and left are arrays with the chosen and the unused events of each target, in the targets' order. The first target that has no
    more chosen events than the next open one gets the next event; a target without unused events closes. Ends when `room` events are taken or all
    targets are closed.
    """
    add = lambda values, at, by: F.transform(values, lambda x, i: F.when(i == at, x + by).otherwise(x))
    start = F.struct(
        counts.alias("counts"), left.alias("left"), F.transform(counts, lambda x, i: i).alias("open"), F.transform(counts, lambda x: F.lit(0).cast("long")).alias("taken"), room.cast("long").alias("room")
    )

    def turn(s, _):
        count = lambda p: F.get(s["counts"], F.get(s["open"], p))
        fitting = lambda p: (p == F.size(s["open"]) - 1) | (count(p) <= count(p + 1))
        place = F.get(F.filter(F.sequence(F.lit(0), F.size(s["open"]) - 1), fitting), F.lit(0))
        at = F.get(s["open"], place)
        has = F.get(s["left"], at) > 0
        one = F.when(has, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        after = F.struct(
            add(s["counts"], at, one).alias("counts"), add(s["left"], at, -one).alias("left"),
            F.when(has, s["open"]).otherwise(F.filter(s["open"], lambda x: x != at)).alias("open"), add(s["taken"], at, one).alias("taken"), (s["room"] - one).alias("room"),
        )
        return F.when((s["room"] <= 0) | (F.size(s["open"]) == 0), s).otherwise(after)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, turn, lambda s: s["taken"])


def balanced(rows: DataFrame, sample: str, targets: list[int], interventions: list[int], size: int = X_SIZE, seed: int = 0) -> DataFrame:
    """`size` rows (sample, pos, vind, minute, value) of every sample, with slot from 0; all rows of a sample that has no more.

    The last three of each target and the last of each intervention come first, of these the last `size`. Then targets are filled evenly,
    each with its earliest unused events, see _take_turns; the rest follows in the order of a seeded hash. Chosen rows are numbered by
    minute and variable, those of a sample without a choice by pos. pos is unique in a sample and a sample is a bounded window; its
    rows are shuffled once, and stay in the JVM.
    """
    whole = Window.partitionBy(sample)
    target, given = F.col("vind").isin(targets), F.col("vind").isin(interventions) & ~F.col("vind").isin(targets)
    marked = rows.withColumn("_n", F.count(F.lit(1)).over(whole))
    back = F.row_number().over(Window.partitionBy(sample, "vind").orderBy(F.desc("pos")))
    marked = marked.withColumn("_back", back)
    marked = marked.withColumn("_recent", (target & (F.col("_back") <= 3)) | (given & (F.col("_back") <= 1)))
    marked = marked.withColumn("_late", F.row_number().over(Window.partitionBy(sample, "_recent").orderBy(F.desc("pos"))))
    marked = marked.withColumn("_kept", F.col("_recent") & (F.col("_late") <= size))
    marked = marked.withColumn("_place", F.row_number().over(Window.partitionBy(sample, "vind", "_kept").orderBy("pos")))
    if targets:
        tally = lambda kept: F.array(*(F.count_if((F.col("vind") == v) & (F.col("_kept") == kept)).over(whole) for v in targets))
        room = F.lit(size) - F.count_if("_kept").over(whole)
        first = F.row_number().over(whole.orderBy("pos")) == 1
        marked = marked.withColumns({"_counts": tally(True), "_left": tally(False), "_room": room, "_first": first})
        turns = F.when(F.col("_first"), _take_turns(F.col("_counts"), F.col("_left"), F.col("_room"), size + len(targets)))  # once for a sample
        marked = marked.withColumn("_turns", F.max(turns).over(whole))
        own = F.get("_turns", F.array_position(F.array(*map(F.lit, targets)), F.col("vind")).cast("int") - 1)
        fill = F.coalesce(~F.col("_kept") & (F.col("_place") <= own), F.lit(False))
    else:
        fill = F.lit(False)
    marked = marked.withColumn("_chosen", F.col("_kept") | fill)
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(sample).cast("string"), F.col("pos").cast("string")))
    drawn = F.row_number().over(Window.partitionBy(sample, "_chosen").orderBy(draw, "pos"))
    marked = marked.withColumns({"_drawn": drawn, "_free": F.lit(size) - F.count_if("_chosen").over(whole)})
    chosen = marked.filter(F.col("_chosen") | (F.col("_drawn") <= F.col("_free")))
    many = F.col("_n") > size
    slot = F.row_number().over(whole.orderBy(F.when(many, F.col("minute")), F.when(many, F.col("vind")), "pos")) - 1
    return chosen.withColumn("slot", slot.cast("int")).select(*rows.columns, "slot")


def fixed_arrays(rows: DataFrame, sample: str, size: int, prefix: str, last_variable: int, order: tuple[str, ...] = ("minute", "vind")) -> DataFrame:
    """One row for each sample: prefix_vind, _minute, _value and _mask, each `size` long, of its rows (vind, minute, value).

    Events come in the given order; padded places have the mask 0, the value 0 and the tokens of padding.
    """
    event = F.struct(*order, *[F.col(c).alias(f"_{c}") for c in ("vind", "minute", "value")])
    grouped = rows.groupBy(sample).agg(F.sort_array(F.collect_list(event)).alias("_s"))
    mask = padded(F.transform("_s", lambda x: F.lit(1.0)), size, 0.0)
    held = lambda c: F.transform("_s", lambda x: x[f"_{c}"].cast("double"))
    filled = {c: padded(held(c), size, 0.0) for c in ("vind", "minute", "value")}
    wide = grouped.select(sample, mask.alias("mask"), *[v.alias(c) for c, v in filled.items()])
    token = lambda i: lambda x, k: pad_tokens(x, x, F.get("mask", k), last_variable)[i]
    return wide.select(
        sample, F.transform("vind", token(0)).alias(f"{prefix}_vind"), F.transform("minute", token(1)).alias(f"{prefix}_minute"),
        F.col("value").alias(f"{prefix}_value"), F.col("mask").alias(f"{prefix}_mask"),
    )


def target_arrays(rows: DataFrame, sample: str, targets: int, last_variable: int) -> DataFrame:
    """The target part of each sample, padded to Y_PER_TARGET places for each of the targets."""
    return fixed_arrays(rows, sample, Y_PER_TARGET * targets, "y", last_variable)
