"""Statistics of pairs: hedge ratios, half-lives, correlations and rolling measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PAIR, by_pair


def full(value: Column, measured: str, window: int, over: Window) -> Column:
    """value where the frame of ``window`` rows is full of ``measured``, else null."""
    return F.when(F.count(measured).over(over) >= window, value)


def log_legs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"ly": F.ln("close_y"), "lx": F.ln("close_x")})


def ols_hedge(pairs: DataFrame) -> DataFrame:
    """alpha and beta of log y on log x, per pair."""
    return log_legs(pairs).groupBy(*PAIR).agg(F.regr_intercept("ly", "lx").alias("alpha"), F.regr_slope("ly", "lx").alias("beta"), F.count(F.lit(1)).alias("n_bars"))


def static_spread(pairs: DataFrame) -> DataFrame:
    """Adds the residual of the pair's own regression. Hedge ratios are one row per pair."""
    fit = ols_hedge(pairs).drop("n_bars")
    return log_legs(pairs).join(fit, [*PAIR]).withColumn("spread", F.col("ly") - (F.col("alpha") + F.col("beta") * F.col("lx")))


def half_life(spreads: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Bars until half of a deviation is gone, by an AR(1) fit; null unless 0 < phi < 1."""
    lagged = spreads.withColumn("lag_s", F.lag("spread").over(by_pair(*more))).withColumn("ds", F.col("spread") - F.col("lag_s"))
    fit = lagged.groupBy(*PAIR, *more).agg((1 + F.regr_slope("ds", "lag_s")).alias("phi"))
    return fit.select(*PAIR, *more, F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.ln(F.lit(2.0)) / F.ln("phi")).alias("half_life_bars"))


def ret_corr(pairs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of log returns on the shared bars; of the changes of ly and lx, where pairs has these."""
    w = by_pair(*more)
    d = (pairs if {"ly", "lx"} <= set(pairs.columns) else log_legs(pairs)).withColumns({"dy": F.col("ly") - F.lag("ly").over(w), "dx": F.col("lx") - F.lag("lx").over(w)})
    return d.groupBy(*PAIR, *more).agg(F.corr("dy", "dx").alias("ret_corr"))


def rolling_zscore(spreads: DataFrame, window: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds z over the last ``window`` bars, the current one included; null until the window is full or where it is flat."""
    w = by_pair(*more).rowsBetween(-(window - 1), 0)
    z = F.try_divide(F.col("spread") - F.avg("spread").over(w), F.nullif(F.stddev_samp("spread").over(w), F.lit(0.0)))
    return spreads.withColumn("z", full(z, "spread", window, w))


def rolling_beta(pairs: DataFrame, window: int) -> DataFrame:
    w = by_pair().rowsBetween(-(window - 1), 0)
    beta = F.try_divide(F.covar_samp("ly", "lx").over(w), F.nullif(F.var_samp("lx").over(w), F.lit(0.0)))
    return log_legs(pairs).withColumn("rolling_beta", full(beta, "lx", window, w))


def trailing_vol(panel: DataFrame, window: int) -> DataFrame:
    """Adds vol, the deviation of the last ``window`` returns."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    r = panel.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    frame = w.rowsBetween(-(window - 1), 0)
    return r.withColumn("vol", full(F.stddev_samp("r").over(frame), "r", window, frame)).drop("r")


def spread_bands(spreads: DataFrame, k: float = 2.0) -> DataFrame:
    """Mean and mean +- k deviations of each pair's whole spread."""
    got = spreads.groupBy(*PAIR).agg(F.avg("spread").alias("mid"), F.stddev_samp("spread").alias("sd"))
    return got.select(*PAIR, "mid", (F.col("mid") - k * F.col("sd")).alias("low"), (F.col("mid") + k * F.col("sd")).alias("high"))


def average_rank(df: DataFrame, column: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ranks with ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(column)
    ties = Window.partitionBy(*by, column)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def spearman(df: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    ranked = average_rank(average_rank(df.dropna(subset=[a, b]), a, "_ra", by), b, "_rb", by)
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))
