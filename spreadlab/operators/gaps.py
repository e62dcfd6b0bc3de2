"""Gaps between bars, calendars and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(a: Column) -> Column:
    return F.unix_seconds(a.cast("timestamp"))


def find_gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """(symbol, gap_start, gap_end, n_missing) between consecutive bars more than a step apart."""
    step = F.make_dt_interval(secs=F.lit(seconds))
    w = Window.partitionBy("symbol").orderBy("open_time")
    prev = bars.select("symbol", "open_time", F.lag("open_time").over(w).alias("prev"))
    apart = F.floor((_seconds(F.col("open_time")) - _seconds(F.col("prev"))) / seconds)
    return prev.where(apart > 1).select("symbol", (F.col("prev") + step).alias("gap_start"), (F.col("open_time") - step).alias("gap_end"), (apart - 1).cast("long").alias("n_missing"))


def union_calendar(bars: DataFrame) -> DataFrame:
    return bars.select("open_time").distinct()


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """Runs of calendar slots that a symbol lacks between its first and last bar; slots that follow each other in
    the calendar are one run, whatever days lie between them."""
    slots = union_calendar(bars).select("open_time", F.row_number().over(Window.orderBy("open_time")).alias("slot"))
    ends = bars.groupBy("symbol").agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi"))
    due = slots.join(ends, (F.col("open_time") >= F.col("lo")) & (F.col("open_time") <= F.col("hi"))).select("symbol", "open_time", "slot")
    lacking = due.join(bars.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")
    run = F.col("slot") - F.row_number().over(Window.partitionBy("symbol").orderBy("slot"))
    return lacking.withColumn("run", run).groupBy("symbol", "run").agg(F.min("open_time").alias("gap_start"), F.max("open_time").alias("gap_end"), F.count(F.lit(1)).alias("n_missing")).drop("run")


def event_counts(events: DataFrame, time: str = "funding_time") -> DataFrame:
    """Events of each symbol, with the first and the last."""
    return events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_event"), F.max(time).alias("last_event"))


def coverage(bars: DataFrame, seconds: int) -> DataFrame:
    """First and last bar, bars, and how many a gapless clock would have."""
    got = bars.groupBy("symbol").agg(F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"), F.count(F.lit(1)).alias("n_bars"))
    expected = ((_seconds(F.col("last_bar")) - _seconds(F.col("first_bar"))) / seconds + 1).cast("long")
    return got.withColumn("expected", expected).withColumn("missing", F.col("expected") - F.col("n_bars"))
