"""Streaming forms of the minute table and of the first history and target window of a stay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewell.functions.shipping import ship
from tidewell.operators.windows import HISTORY, STEP, TARGET


def distinct_events(events: DataFrame, keys: list[str], late: str, at: str = "ts") -> DataFrame:
    """The first of the events that are equal in keys and clock minute, whatever order they come in.

    Equal events lie within a minute, so `late`, the time that an event may come behind the latest one, must be a minute or more for all
    repeats to be found. Keys are kept no longer than that.
    """
    timed = events.withWatermark(at, late).withColumn("minute_start", F.date_trunc("minute", F.col(at)))
    return timed.dropDuplicatesWithinWatermark([*keys, "minute_start"])


def minute_means(events: DataFrame, late: str = "10 minutes", stay: str = "stay_id", variable: str = "variable", value: str = "value", at: str = "ts", source: str | None = None) -> DataFrame:
    """Mean of the distinct present values of each stay, clock minute and variable; minutes close when the watermark passes them.

    Values that a source repeats within a minute count once, equal ones of two sources twice. Rows without a stay or a variable go, and so do
    those that come later than the watermark allows; without such rows the result is that of the batch, in any order of arrival.
    A minute whose values are all missing has the mean null.
    """
    keyed = events.filter(F.col(stay).isNotNull() & F.col(variable).isNotNull())
    distinct = distinct_events(keyed, [stay, variable, value, *([source] if source else [])], late, at)
    grouped = distinct.groupBy(F.window(at, "1 minute").alias("w"), stay, variable)
    return grouped.agg(F.avg(F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value))).alias(value)).select(F.col("w.start").alias("minute_start"), stay, variable, value)


def target_windows(events: DataFrame, targets: list[str], late: str = "10 minutes", width: str = "10 minutes", stay: str = "stay_id", variable: str = "variable", at: str = "ts") -> DataFrame:
    """Target parts that hold a target variable twice or more, as their windows close."""
    timed = events.withWatermark(at, late).filter(F.col(variable).isin(list(targets)))
    counted = timed.groupBy(F.window(at, width).alias("w"), stay, variable).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1").select(stay, variable, F.col("w.start").alias("target_start"), "n")


class FirstWindow(StatefulProcessor):
    """A stay's buckets of STEP minutes as keyed state, from which its first window is told once it can't change any more.

    A bucket holds, for each target, the minutes that have a value, as bits. A bucket is complete when the watermark has passed its end;
    complete buckets are judged in order, and kept only as long as they can be a window's history.
    """

    def __init__(self, stay: str, targets: list[str], repeats: int = 2):
        self.stay, self.targets, self.repeats = stay, list(targets), repeats

    def init(self, handle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket long", ", ".join(["rows long", *(f"bits{i} long" for i in range(len(self.targets)))]))
        self.about = handle.getValueState("about", "start long, last long, judged long, found long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, last, judged, found, done = self.about.get() if self.about.exists() else (0, -1, -1, -1, False)
        touched: dict[int, list[int]] = {}
        for part in rows:
            for minute, variable, begun in zip(part["minute"].tolist(), part["variable"].tolist(), part["start_ms"].tolist()):
                start, last = int(begun), max(last, int(minute))
                bucket, at = divmod(int(minute), STEP)
                if done or found >= 0 or minute < 0 or bucket <= judged - HISTORY // STEP:
                    continue
                held = touched.get(bucket)
                if held is None:
                    held = touched[bucket] = list(self.buckets.getValue((bucket,))) if self.buckets.containsKey((bucket,)) else [0] * (1 + len(self.targets))
                held[0] += 1
                if variable in self.targets:
                    held[1 + self.targets.index(variable)] |= 1 << at
        for bucket, held in touched.items():
            self.buckets.updateValue((bucket,), tuple(held))
            self.handle.registerTimer(start + (bucket + 1) * STEP * 60_000)
        yield from self._judge(key, (start, last, judged, found, done), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists():
            yield from self._judge(key, self.about.get(), timerValues.getCurrentWatermarkInMs())

    def _judge(self, key, about, watermark: int) -> Iterator[pd.DataFrame]:
        start, last, judged, found, done = about
        if not done and found < 0:
            reach = HISTORY // STEP
            complete = (watermark - start) // (STEP * 60_000) - 1  # the last bucket that has ended
            held = {b[0]: v for b, v in self.buckets.iterator()}
            for bucket in sorted(b for b in held if judged < b <= complete):
                often = any(bin(bits).count("1") >= self.repeats for bits in held[bucket][1:])
                if often and bucket >= reach and any(bucket - i in held for i in range(1, reach + 1)):
                    found = bucket - reach
                    break
            judged = max(judged, complete)
            for bucket in held:
                if found >= 0 or bucket <= judged - reach:
                    self.buckets.removeKey((bucket,))
        if not done and found >= 0 and found * STEP + HISTORY + TARGET < last:
            done = True
            yield pd.DataFrame({self.stay: [key[0]], "k": [found]})
        self.about.update((start, last, judged, found, done))

    def close(self) -> None:
        pass


def first_windows(events: DataFrame, targets: list[str], late: str = "10 minutes", stay: str = "stay_id", variable: str = "variable", at: str = "ts", start: str = "intime", repeats: int = 2) -> DataFrame:
    """stay and k of each stay's first window, as operators.windows.first_windows finds it, once and as soon as it is certain.

    events has the stay, its start, the time of each event and its variable. A window is certain when the watermark has passed its end and
    the stay has an event after it. Repeated rows change nothing; rows that come later than `late` behind the latest event are not seen, as
    Spark drops them; those before the stay's start and those without a stay, start, time or variable go. State is kept for the last
    buckets of a stay only. Needs the RocksDB state store.
    """
    ship(events.sparkSession)
    known = events.filter(F.col(stay).isNotNull() & F.col(start).isNotNull() & F.col(variable).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    rows = known.select(F.col(stay).cast("long").alias(stay), at, F.col(variable).alias("variable"), ms(F.col(start)).alias("start_ms"), _minute(F.col(start), F.col(at)).alias("minute"))
    return rows.groupBy(stay).transformWithStateInPandas(FirstWindow(stay, targets, repeats), f"{stay} long, k long", "Append", "EventTime")


def _minute(start: Column, at: Column) -> Column:
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60_000_000)).cast("long")
