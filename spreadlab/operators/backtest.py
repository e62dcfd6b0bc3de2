"""Backtests whose profit and loss adds up exactly: net = gross - fee - slip + funding - borrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Study
from .panel import PAIR, by_pair
from .signals import held_weights, turnover

PARTS = ("gross", "fee", "slip", "funding", "borrow", "net")


def with_funding(pairs: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds rate_y and rate_x, 0 where nothing fell due."""
    for leg in ("y", "x"):
        side = rates.select(F.col("symbol").alias(f"leg_{leg}"), "open_time", F.col("rate").alias(f"rate_{leg}"))
        pairs = pairs.join(side, [f"leg_{leg}", "open_time"], "left").withColumn(f"rate_{leg}", F.coalesce(f"rate_{leg}", F.lit(0.0)))
    return pairs


def backtest(frame: DataFrame, study: Study, next_open: bool | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds weights, turnover and the parts of the profit. frame: close_y, close_x, rate_y, rate_x, desired, beta, and
    open_y, open_x where fills are at the next open."""
    next_open = study.next_open if next_open is None else next_open
    if next_open and not {"open_y", "open_x"} <= set(frame.columns):
        raise ValueError("fills at the next open need open_y and open_x")
    w = by_pair(*more)
    rows = turnover(held_weights(frame, more), more)

    def change(now: str, then: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(now), then) - 1, F.lit(0.0))

    legs = []
    for leg in ("y", "x"):
        last = F.lag(f"close_{leg}").over(w)
        if next_open:
            legs.append(F.lag(f"w_{leg}", 1, 0.0).over(w) * change(f"open_{leg}", last) + F.col(f"w_{leg}") * change(f"close_{leg}", F.col(f"open_{leg}")))
        else:
            legs.append(F.col(f"w_{leg}") * change(f"close_{leg}", last))
    short = F.greatest(-F.col("w_y"), F.lit(0.0)) + F.greatest(-F.col("w_x"), F.lit(0.0))
    rows = rows.withColumns({
        "gross": legs[0] + legs[1], "fee": F.col("turnover") * study.fee_bps / 1e4, "slip": F.col("turnover") * study.slip_bps / 1e4,
        "funding": -(F.col("w_y") * F.col("rate_y") + F.col("w_x") * F.col("rate_x")), "borrow": short * study.borrow_per_bar,
    })
    return rows.withColumn("net", F.col("gross") - F.col("fee") - F.col("slip") + F.col("funding") - F.col("borrow"))


def totals(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    """Sums of the parts and whether they add up."""
    out = frame.groupBy(*by).agg(*[F.sum(p).alias(p) for p in PARTS])
    off = F.col("net") - (F.col("gross") - F.col("fee") - F.col("slip") + F.col("funding") - F.col("borrow"))
    return out.withColumn("reconciled", F.abs(off) < 1e-9)


def portfolio_curve(frame: DataFrame, n_pairs: DataFrame | int, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal capital in each pair: sums over pairs divided by the number of pairs of the book, whether they have the bar or not."""
    if isinstance(n_pairs, int):
        frame = frame.withColumn("_n", F.lit(n_pairs))
    else:
        frame = frame.join(F.broadcast(n_pairs.withColumnRenamed("n_pairs", "_n")), [*by]) if by else frame.crossJoin(F.broadcast(n_pairs.withColumnRenamed("n_pairs", "_n")))
    return frame.groupBy(*by, "open_time").agg(*[(F.sum(p) / F.first("_n")).alias(p) for p in PARTS])


def book_size(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return frame.select(*by, *PAIR).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))


def benchmark_frame(panel: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Buy and hold of each symbol as a result frame: net = gross, no costs. With ``bars`` on exactly these, before returns are
    taken, so that the first has return 0."""
    from .panel import bar_returns, on_bars

    zero = F.lit(0.0)
    rows = bar_returns(panel if bars is None else on_bars(panel, bars))
    return rows.select("symbol", "open_time", F.col("ret").alias("gross"), zero.alias("fee"), zero.alias("slip"), zero.alias("funding"), zero.alias("borrow"), F.col("ret").alias("net"))


def oos_frame(series: DataFrame) -> DataFrame:
    """A stitched out-of-sample series as a result frame: its costs are inside net, so the other parts are null."""
    return series.select("open_time", *[(F.col("net") if p == "net" else F.lit(None).cast("double")).alias(p) for p in PARTS])


def on_driving_bars(signals: DataFrame, closes: DataFrame, rates: DataFrame, opens: bool = False) -> DataFrame:
    """The signals' bars with both legs' closes (and opens): null where a leg has none; rates are 0 there. The signals drive, no bar is added or lost."""
    fields = ("close", "open") if opens else ("close",)
    out = signals
    for leg in ("y", "x"):
        side = closes.select(F.col("symbol").alias(f"leg_{leg}"), "open_time", *[F.col(f).alias(f"{f}_{leg}") for f in fields])
        out = out.join(side, [f"leg_{leg}", "open_time"], "left")
    return with_funding(out, rates)
