"""The long price panel, pairs of symbols on shared bars, and funding on bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import floor_to

PAIR = ("leg_y", "leg_x")


def by_pair(*more: str) -> Window:
    return Window.partitionBy(*PAIR, *more).orderBy("open_time")


def long_panel(bars: DataFrame, symbols: list[str] | None = None, end: Column | None = None, field: str = "close") -> DataFrame:
    """(symbol, open_time, field) before ``end``; field is close or open."""
    if field not in ("close", "open"):
        raise ValueError(f"field must be close or open, not {field}")
    out = bars.select("symbol", "open_time", F.col(field).cast("double").alias(field))
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    return out if end is None else out.where(F.col("open_time") < end)


def pivot_panel(panel: DataFrame, symbols: list[str] | None = None, field: str = "close") -> DataFrame:
    """A column per symbol, of all that occur by default."""
    return panel.groupBy("open_time").pivot("symbol", symbols).agg(F.first(field))


def slice_half_open(df: DataFrame, start: Column, end: Column, time: str = "open_time") -> DataFrame:
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def train_test_split(df: DataFrame, train_end: Column, time: str = "open_time") -> DataFrame:
    """Adds ``part``; the day ``train_end`` still belongs to train."""
    cutoff = F.date_add(train_end, 1).cast("timestamp_ntz")
    return df.withColumn("part", F.when(F.col(time) < cutoff, "train").otherwise("test"))


def pair_candidates(bars: DataFrame) -> DataFrame:
    """Unordered pairs of symbols, a < b. The symbol table is small, whatever the number of bars."""
    s = bars.select("symbol").distinct()
    return s.select(F.col("symbol").alias("leg_y")).join(F.broadcast(s.select(F.col("symbol").alias("leg_x"))), F.col("leg_y") < F.col("leg_x"))


def pair_align(bars: DataFrame, fields: tuple[str, ...] = ("close",), wanted: list[tuple[str, str]] | None = None) -> DataFrame:
    """Bars that both legs have. The panel is shuffled once, by time; a bar's symbols, which are few, then meet in pairs a < b inside
    their row. With ``wanted`` only these pairs, either way round, are made."""
    rows = bars.dropna(subset=["open_time", "symbol", *fields])
    if wanted is not None:
        rows = rows.where(F.col("symbol").isin(sorted({s for p in wanted for s in p})))
    side = F.array_sort(F.collect_list(F.struct("symbol", *fields)))
    at = rows.groupBy("open_time").agg(side.alias("_s"))
    later = F.transform("_s", lambda y, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda x: F.struct(y.alias("y"), x.alias("x"))))
    pair = at.select("open_time", F.explode(F.flatten(later)).alias("_p")).where("_p.y.symbol < _p.x.symbol")
    out = pair.select("open_time", *[F.col(f"_p.{leg}.{f}").alias(n) for leg in ("y", "x") for f, n in (("symbol", f"leg_{leg}"), *((f, f"{f}_{leg}") for f in fields))])
    if wanted is not None:
        some = F.array(*[F.struct(F.lit(min(p)).alias("leg_y"), F.lit(max(p)).alias("leg_x")) for p in wanted])
        out = out.where(F.array_contains(some, F.struct("leg_y", "leg_x")))
    return out


def both_ways(frame: DataFrame) -> DataFrame:
    """Each row of pairs, and again with its legs the other way round."""
    other = lambda c: {"_y": c[:-1] + "x", "_x": c[:-1] + "y"}.get(c[-2:], c)
    return frame.unionByName(frame.select(*[F.col(other(c)).alias(c) for c in frame.columns]))


def on_bars(panel: DataFrame, bars: DataFrame, field: str = "close") -> DataFrame:
    """The panel's symbols on exactly the given bars (open_time): null where a symbol has none, never filled. Symbols are few, so
    that their product with the bars is as large as a panel without gaps."""
    wanted = bars.select("open_time").distinct().crossJoin(F.broadcast(panel.select("symbol").distinct()))
    return wanted.join(panel.select("symbol", "open_time", field), ["symbol", "open_time"], "left")


def log_prices(panel: DataFrame) -> DataFrame:
    """Adds log_close; null where the price is not positive."""
    return panel.withColumn("log_close", F.when(F.col("close") > 0, F.ln("close")))


def bar_returns(panel: DataFrame, k: int = 1) -> DataFrame:
    """Adds ret, the change over k rows of the symbol; the first rows and zero prices give 0."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    return panel.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1, F.lit(0.0)))


def normalized_close(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("open_time")
    return panel.withColumn("normalized", F.try_divide(F.col("close"), F.first("close").over(w)))


def funding_per_bar(funding: DataFrame, seconds: int) -> DataFrame:
    """Rates summed in the bar they fall in."""
    return funding.groupBy("symbol", floor_to(F.col("funding_time"), seconds).alias("open_time")).agg(F.sum("funding_rate").alias("rate"))


def funding_join(panel: DataFrame, rates: DataFrame) -> DataFrame:
    return panel.join(rates, ["symbol", "open_time"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def funding_rolling_mean(funding: DataFrame, events: int = 90) -> DataFrame:
    """Mean rate in basis points over the last ``events`` events of the symbol; null before there are as many."""
    w = Window.partitionBy("symbol").orderBy("funding_time").rowsBetween(-(events - 1), 0)
    return funding.withColumn("mean_bps", F.when(F.count("funding_rate").over(w) >= events, F.avg("funding_rate").over(w) * 1e4))
