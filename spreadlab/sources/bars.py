"""Bars and funding events from trades or orders, and cleaning of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_to(ts: Column, seconds: int) -> Column:
    """The bar that a moment falls in, as timestamp without zone; a moment on the boundary starts a bar."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def bars(rows: DataFrame, symbol: str, ts: str, value: str, tie: str, seconds: int) -> DataFrame:
    """OHLC bars of a value per symbol; opens and closes are ordered by (ts, tie). One shuffle, with
    partial aggregation; no forward fill: a bar without rows does not exist."""
    order = F.struct(ts, tie)
    return rows.groupBy(F.col(symbol).alias("symbol"), floor_to(F.col(ts), seconds).alias("open_time")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        F.sum(value).alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    )


def hourly(events: DataFrame, seconds: int = 3600) -> DataFrame:
    return bars(events, "event_type", "ts", "value", "event_id", seconds)


def daily(orders: DataFrame) -> DataFrame:
    return bars(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", 86400)


def prices(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Price-like series: all symbols share a slow index, the running sum of hourly mean values.

    The index is ordered over one row per bar of the calendar, which grows with time, not with trades."""
    index = events.groupBy(floor_to(F.col("ts"), seconds).alias("open_time")).agg(((F.avg("value") - 50) / 1000).alias("step"))
    index = index.select("open_time", F.sum("step").over(Window.orderBy("open_time")).alias("m"))
    level = lambda c: 100 * F.exp(F.col("m") + (F.col(c) - 50) / 5000)
    return hourly(events, seconds).join(index, "open_time").select("symbol", "open_time", level("open").alias("open"), level("close").alias("close"))


def funding_events(events: DataFrame) -> DataFrame:
    """An irregular event clock of rates: every event is one."""
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").alias("funding_time"), ((F.col("value") - 50) / 1e6).alias("funding_rate"))


def drop_forming(df: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Only bars that closed before ``now``."""
    return df.where(F.col("open_time") + F.make_dt_interval(secs=F.lit(seconds)) <= now)


def clean_daily(df: DataFrame, start: Column, today: Column) -> DataFrame:
    """Rows with all of open, high, low and close, from ``start`` and before ``today``."""
    return df.dropna(subset=["open", "high", "low", "close"]).where((F.col("open_time") >= start) & (F.col("open_time") < today))


def parse_klines(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Positional JSON arrays of a candle to exact decimals: [open time ms, open, high, low, close, volume,
    close time ms, quote volume, trades, ...]; empty strings are null."""
    at = F.from_json(F.col(column), "array<string>")
    number = lambda i: F.nullif(F.get(at, F.lit(i)), F.lit("")).try_cast("decimal(38,18)")
    return raw.select(
        "symbol", F.timestamp_millis(F.get(at, F.lit(0)).try_cast("bigint")).cast("timestamp_ntz").alias("open_time"),
        *[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], number(7).alias("quote_volume"), F.get(at, F.lit(8)).try_cast("bigint").alias("n_trades"),
    )


def parse_premium(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Candles of a premium index: time and prices of :func:`parse_klines`, which have no volume."""
    return parse_klines(raw, column).select("symbol", "open_time", "open", "high", "low", "close")


def parse_catalogue(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON objects of an exchange's symbols."""
    got = F.from_json(F.col(column), "symbol string, baseAsset string, quoteAsset string, status string, onboardDate bigint")
    return raw.select(
        got["symbol"].alias("symbol"), got["baseAsset"].alias("base_asset"), got["quoteAsset"].alias("quote_asset"), got["status"].alias("status"),
        F.timestamp_millis(got["onboardDate"]).cast("timestamp_ntz").alias("onboard_date"),
    )


def parse_funding(raw: DataFrame, column: str = "raw") -> DataFrame:
    """JSON objects of a funding event; an empty mark price is null."""
    got = F.from_json(F.col(column), "symbol string, fundingTime bigint, fundingRate string, markPrice string")
    number = lambda c: F.nullif(got[c], F.lit("")).try_cast("decimal(38,18)")
    return raw.select(got["symbol"].alias("symbol"), F.timestamp_millis(got["fundingTime"]).cast("timestamp_ntz").alias("funding_time"), number("fundingRate").alias("funding_rate"), number("markPrice").alias("mark_price"))
