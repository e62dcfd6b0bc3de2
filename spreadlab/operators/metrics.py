"""Risk and trade metrics of result frames, grouped by ``by``. Undefined ratios are null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PAIR


def _in_time(by: tuple[str, ...]) -> Window:
    return Window.partitionBy(*by).orderBy("open_time")


def equity_curve(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    return frame.withColumn("equity", F.sum("net").over(_in_time(by).rowsBetween(Window.unboundedPreceding, 0)))


def drawdown_curve(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    """Adds equity and drawdown; the first peak is the first equity, not 0."""
    rows = equity_curve(frame, by)
    return rows.withColumn("drawdown", F.col("equity") - F.max("equity").over(_in_time(by).rowsBetween(Window.unboundedPreceding, 0)))


def sharpe(net: str, bars_per_year: int) -> Column:
    return F.try_divide(F.avg(net), F.nullif(F.stddev_samp(net), F.lit(0.0))) * F.sqrt(F.lit(float(bars_per_year)))


def sortino(net: str, bars_per_year: int) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least(F.col(net), F.lit(0.0)), 2)))
    return F.try_divide(F.avg(net), F.nullif(down, F.lit(0.0))) * F.sqrt(F.lit(float(bars_per_year)))


def _active() -> Column:
    return F.col("w_y") != 0


def with_episodes(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    """Adds active, was_active, opens and the running number of the trade."""
    w = _in_time(by)
    rows = frame.withColumn("active", _active()).withColumn("was_active", F.coalesce(F.lag("active").over(w), F.lit(False)))
    rows = rows.withColumn("opens", (F.col("active") & ~F.col("was_active")).cast("long"))
    return rows.withColumn("episode", F.sum("opens").over(w))


def round_trips(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    return with_episodes(frame, by).groupBy(*by).agg(F.sum("opens").alias("trades"))


def trade_pnls(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    """(by, episode, pnl): a trade's bars and the first flat bar after it, which bears the cost of the exit."""
    return with_episodes(frame, by).where("active or was_active").groupBy(*by, "episode").agg(F.sum("net").alias("pnl"))


def hit_rate(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    return trade_pnls(frame, by).groupBy(*by).agg(F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"))


def avg_holding(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    rows = with_episodes(frame, by)
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("active").cast("long")).cast("double"), F.sum("opens")).alias("avg_holding"))


def ann_turnover(frame: DataFrame, bars_per_year: int, by: tuple[str, ...] = PAIR) -> DataFrame:
    return frame.groupBy(*by).agg((F.sum("turnover") / F.count(F.lit(1)) * bars_per_year).alias("ann_turnover"))


def ann_sharpe(frame: DataFrame, bars_per_year: int, by: tuple[str, ...] = PAIR) -> DataFrame:
    return frame.groupBy(*by).agg(sharpe("net", bars_per_year).alias("ann_sharpe"))


def ann_sortino(frame: DataFrame, bars_per_year: int, by: tuple[str, ...] = PAIR) -> DataFrame:
    return frame.groupBy(*by).agg(sortino("net", bars_per_year).alias("ann_sortino"))


def max_drawdown(frame: DataFrame, by: tuple[str, ...] = PAIR) -> DataFrame:
    return drawdown_curve(frame, by).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def summarize(frame: DataFrame, bars_per_year: int, by: tuple[str, ...] = PAIR, weights: bool = True) -> DataFrame:
    """net, gross, costs, funding, sharpe, max_drawdown, bars, and with weights trades and the share of bars in the market."""
    rows = drawdown_curve(with_episodes(frame, by) if weights else frame, by)
    more = [F.sum("opens").alias("trades"), F.avg(F.col("active").cast("double")).alias("pct_in_market")] if weights else []
    return rows.groupBy(*by).agg(
        F.sum("net").alias("net"), F.sum("gross").alias("gross"), F.sum(F.col("fee") + F.col("slip") + F.col("borrow")).alias("costs"), F.sum("funding").alias("funding"),
        sharpe("net", bars_per_year).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("bars"), *more,
    )


def series_summary(frame: DataFrame, bars_per_year: int, by: tuple[str, ...]) -> DataFrame:
    """Headline figures and Sortino ratio of series without weights."""
    return summarize(frame, bars_per_year, by, weights=False).join(ann_sortino(frame, bars_per_year, by), [*by])


def full_summary(frame: DataFrame, bars_per_year: int, by: tuple[str, ...] = PAIR) -> DataFrame:
    out = summarize(frame, bars_per_year, by).join(ann_sortino(frame, bars_per_year, by), [*by])
    for more in (hit_rate(frame, by), avg_holding(frame, by), ann_turnover(frame, bars_per_year, by)):
        out = out.join(more, [*by], "left")
    return out


def portfolio_extras(frame: DataFrame, bars_per_year: int) -> DataFrame:
    """One row over all pairs: trades, pooled hit rate, mean hold over trades, turnover a year averaged over pairs, and
    the share of bars with any pair in the market."""
    rows = with_episodes(frame)
    pooled = trade_pnls(frame).agg(F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"))
    counts = rows.agg(F.sum("opens").alias("trades"), F.try_divide(F.sum(F.col("active").cast("long")).cast("double"), F.sum("opens")).alias("avg_holding"))
    per = ann_turnover(frame, bars_per_year).agg(F.avg("ann_turnover").alias("ann_turnover"))
    any_active = rows.groupBy("open_time").agg(F.bool_or("active").alias("a")).agg(F.avg(F.col("a").cast("double")).alias("exposure"))
    return counts.crossJoin(pooled).crossJoin(per).crossJoin(any_active)  # four single rows
