"""Stresses of a strategy: costs, parameters, market regimes and the book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import PARTS
from .metrics import sharpe
from .panel import PAIR
from .stats import average_rank


def cost_stress(frame: DataFrame, multipliers: tuple[float, ...], bars_per_year: int, n_pairs: DataFrame, start: Column | None = None) -> DataFrame:
    """Portfolio net and Sharpe with fee and slip times each multiplier, of the bars from ``start`` on. They are linear in it, so no backtest runs again."""
    frame = frame if start is None else frame.where(F.col("open_time") >= start)
    port = frame.groupBy("open_time").agg(*[F.sum(p).alias(p) for p in PARTS]).crossJoin(F.broadcast(n_pairs))
    each = port.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    net = (F.col("gross") - F.col("multiplier") * (F.col("fee") + F.col("slip")) + F.col("funding") - F.col("borrow")) / F.col("n_pairs")
    return each.withColumn("net", net).groupBy("multiplier").agg(F.sum("net").alias("net"), sharpe("net", bars_per_year).alias("sharpe"))


def leave_one_out(frame: DataFrame) -> DataFrame:
    """(dropped pair, net): the portfolio of the other pairs at equal capital. A pair's total is enough, for nets add up."""
    per = frame.groupBy(*PAIR).agg(F.sum("net").alias("own"))
    whole = per.agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("n"))
    return per.crossJoin(whole).select(*PAIR, F.try_divide(F.col("total") - F.col("own"), F.col("n") - 1).alias("net"))


def leave_one_out_stats(frame: DataFrame, bars_per_year: int, start: Column | None = None) -> DataFrame:
    """(dropped pair, net, sharpe, bars) of the other pairs' portfolio from ``start`` on. A bar's sum less the pair's own part is the rest's, and a bar
    that only the dropped pair has is none of theirs; so a book of n pairs costs n rows a bar, not n * n."""
    pairs = frame.select(*PAIR).distinct()
    size = pairs.agg(F.count(F.lit(1)).alias("n"))
    rows = frame if start is None else frame.where(F.col("open_time") >= start)
    bars = rows.groupBy("open_time").agg(F.sum("net").alias("total"), F.count(F.lit(1)).alias("present"))
    own = rows.select(*PAIR, "open_time", F.col("net").alias("own"))
    each = bars.crossJoin(F.broadcast(pairs.crossJoin(size))).join(own, [*PAIR, "open_time"], "left")
    each = each.where(F.col("present") > F.when(F.col("own").isNull(), 0).otherwise(1))
    net = F.try_divide(F.col("total") - F.coalesce("own", F.lit(0.0)), F.col("n") - 1)
    return each.withColumn("net", net).groupBy(*PAIR).agg(F.sum("net").alias("net"), sharpe("net", bars_per_year).alias("sharpe"), F.count(F.lit(1)).alias("bars"))


def regime_slices(curve: DataFrame, factor: DataFrame, window: int, bars_per_year: int) -> DataFrame:
    """net, Sharpe and bars of a portfolio in each regime of a factor's close: up or down over ``window`` bars, and trailing
    deviation above its median or not. The factor is put on the portfolio's bars first, so the first bars have no label.

    A portfolio has a row per bar of the calendar."""
    w = Window.orderBy("open_time")
    rows = curve.select("open_time", "net").join(factor.select("open_time", F.col("close").alias("f")), "open_time", "left")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("trend", F.try_divide(F.col("f"), F.lag("f", window).over(w)) - 1).withColumn("r", F.try_divide(F.col("f"), F.lag("f").over(w)) - 1)
    frame = w.rowsBetween(-(window - 1), 0)
    rows = rows.withColumn("vol", F.when(F.count("r").over(frame) >= window, F.stddev_samp("r").over(frame)))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.median("vol").alias("mid"))))
    label = lambda c, a, b: F.when(c, a).when(~c, b)
    regimes = F.array(label(F.col("trend") > 0, "up", "down"), label(F.col("vol") > F.col("mid"), "high_vol", "low_vol"))
    each = rows.select("net", F.explode(regimes).alias("regime")).where("regime is not null")
    return each.groupBy("regime").agg(F.sum("net").alias("net"), sharpe("net", bars_per_year).alias("sharpe"), F.count(F.lit(1)).alias("bars"))


def grid_robustness(train: DataFrame, test: DataFrame, params: tuple[str, ...]) -> DataFrame:
    """One row: Spearman correlation of train and test Sharpe over parameter sets, the test range and the share above 0."""
    rounded = lambda df, name: df.select(*params, F.round("sharpe", 9).alias(name))  # noqa: E731  # sets that trade alike are ties
    both = rounded(train, "a").join(rounded(test, "b"), [*params])
    ranked = average_rank(average_rank(both.dropna(subset=["a", "b"]), "a", "ra"), "b", "rb")  # one row per set
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.min("b").alias("least"), F.max("b").alias("most"), F.avg((F.col("b") > 0).cast("double")).alias("share_positive"), F.count(F.lit(1)).alias("sets"))
