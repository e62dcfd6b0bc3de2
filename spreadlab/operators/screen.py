"""Screening of pairs for cointegration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Study
from ..functions.adf import RollingEngleGranger, engle_granger_p
from .panel import PAIR


def _tested(keys: tuple[str, ...], logs: bool, least: int):
    columns = [*keys, "n_bars", "p_forward", "p_reverse"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < least:
            return pd.DataFrame(columns=columns)
        g = g.sort_values("open_time")
        y, x = g["close_y"].to_numpy(float), g["close_x"].to_numpy(float)
        if logs:
            y, x = np.log(y), np.log(x)
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), len(g), engle_granger_p(y, x), engle_granger_p(x, y)]], columns=columns)

    return run


def _bars(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """What tests and statistics of pairs read, dealt by pair once: plans that start here share the exchange."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select(*keys, "open_time", "close_y", "close_x").repartition(n, *keys)


def engle_granger(pairs: DataFrame, min_overlap: int, keys: tuple[str, ...] = (), logs: bool = True) -> DataFrame:
    """p values in both directions of each pair (and of each of ``keys``) with enough shared bars, on log prices or prices.

    A task gets one pair's bars: bounded by the bars of a symbol, not by the number of trades."""
    keys = (*PAIR, *keys)
    types = dict(pairs.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", n_bars long, p_forward double, p_reverse double"
    return _bars(pairs, [*keys]).groupBy(*keys).applyInPandas(_tested(keys, logs, min_overlap), ddl)


def _moments(pairs: DataFrame, keys: list[str], logs: bool) -> DataFrame:
    """Per pair, in one pass: both directions' regressions, the correlation of changes, and the covariances of changes and
    last levels, from which any spread's own regression follows."""
    w = Window.partitionBy(*keys).orderBy("open_time")
    legs = _bars(pairs, keys).withColumns({"ly": F.ln("close_y") if logs else F.col("close_y"), "lx": F.ln("close_x") if logs else F.col("close_x")})
    rows = legs.withColumns({"py": F.lag("ly").over(w), "px": F.lag("lx").over(w)}).withColumns({"dy": F.col("ly") - F.col("py"), "dx": F.col("lx") - F.col("px")})
    fits = {"beta": F.regr_slope("ly", "lx"), "beta_turned": F.regr_slope("lx", "ly"), "alpha": F.regr_intercept("ly", "lx"), "alpha_turned": F.regr_intercept("lx", "ly"), "ret_corr": F.corr("dy", "dx")}
    covariances = {f"{a}_{b}": F.covar_pop(a, b) for a, b in (("dy", "py"), ("dy", "px"), ("dx", "py"), ("dx", "px"), ("py", "py"), ("py", "px"), ("px", "px"))}
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in (fits | covariances).items()])


def pair_screen(pairs: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair (and of each of ``more``) with enough bars: the better direction regresses, the worse p value decides. Passers first, then by p.

    The tests and the moments read the same exchange of the pairs' bars; half-lives come from the moments, for the spread's
    covariances are sums of the legs'."""
    keys = [*PAIR, *more]
    p = engle_granger(pairs, study.min_overlap, more, study.use_log_prices)
    out = p.join(_moments(pairs, keys, study.use_log_prices), keys).withColumn("turned", F.col("p_reverse") < F.col("p_forward"))
    pick = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a))
    out = out.withColumns({"b": pick("beta", "beta_turned"), "own": pick("dy_py", "dx_px"), "to": pick("dy_px", "dx_py"), "fro": pick("dx_py", "dy_px"), "other": pick("dx_px", "dy_py"), "v_own": pick("py_py", "px_px"), "v_other": pick("px_px", "py_py")})
    b = F.col("b")
    slope = F.try_divide(F.col("own") - b * (F.col("to") + F.col("fro")) + b * b * F.col("other"), F.col("v_own") - 2 * b * F.col("py_px") + b * b * F.col("v_other"))
    out = out.withColumn("phi", 1 + slope).withColumn("half_life_bars", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.ln(F.lit(2.0)) / F.ln("phi")))
    lo, hi = study.half_life
    worse = F.greatest("p_forward", "p_reverse")
    passed = (worse < study.adf_alpha) & F.col("half_life_bars").isNotNull() & F.col("half_life_bars").between(lo, hi)
    out = out.select(
        pick("leg_y", "leg_x").alias("leg_y"), pick("leg_x", "leg_y").alias("leg_x"), *more, "n_bars", F.least("p_forward", "p_reverse").alias("eg_p"), worse.alias("eg_p_max"),
        pick("alpha", "alpha_turned").alias("alpha"), b.alias("beta"), "half_life_bars", "ret_corr", F.coalesce(passed, F.lit(False)).alias("passed"),
    )
    # Ranked over one row per pair.
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*more).orderBy(F.col("passed").desc(), "eg_p_max", *PAIR)))


def screen_counts(screened: DataFrame, alpha: float) -> DataFrame:
    """One row: pairs tested, passed, and how many would pass the test by chance."""
    n = F.count(F.lit(1))
    return screened.agg(n.alias("tested"), F.count_if("passed").alias("passed"), (n * alpha).alias("expected_by_chance"))


def fold_books(pairs: DataFrame, folds: DataFrame, study: Study) -> DataFrame:
    """(fold, leg_y, leg_x, place, eg_p_max): the best pairs that pass the screen on each fold's training bars, in the direction
    it chose, ``max_pairs`` at most."""
    inside = (F.col("open_time") >= F.col("train_start")) & (F.col("open_time") < F.col("test_start"))
    trained = pairs.join(folds.select("fold", "train_start", "test_start"), inside)
    good = pair_screen(trained, study, ("fold",)).where(F.col("passed") & (F.col("rank") <= study.max_pairs))
    return good.select("fold", *PAIR, F.col("rank").alias("place"), "eg_p_max")


def rolling_eg(pairs: DataFrame, window: int, step: int) -> DataFrame:
    """(leg_y, leg_x, window_end, eg_p_max) of strided windows of ``window`` bars of each pair, on log prices. Bars are not copied:
    all windows of a pair are tested from sums over its bars, which one task has."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("open_time")
        found = RollingEngleGranger(np.log(g["close_y"].to_numpy(float)), np.log(g["close_x"].to_numpy(float)), window, step).p_values() if len(g) >= window else []
        ends = g["open_time"].iloc[[e for e, _, _ in found]]
        return pd.DataFrame({**{k: g[k].iloc[0] for k in PAIR}, "window_end": ends.to_numpy(), "eg_p_max": [max(a, b) for _, a, b in found]}, columns=[*PAIR, "window_end", "eg_p_max"])

    types = dict(pairs.dtypes)
    return _bars(pairs, [*PAIR]).groupBy(*PAIR).applyInPandas(run, f"leg_y {types['leg_y']}, leg_x {types['leg_x']}, window_end {types['open_time']}, eg_p_max double")


def rolling_eg_summary(windows: DataFrame, alpha: float = 0.05) -> DataFrame:
    return windows.groupBy(*PAIR).agg(F.min("eg_p_max").alias("least_p"), F.median("eg_p_max").alias("median_p"), F.avg((F.col("eg_p_max") < alpha).cast("double")).alias("share_passing"))
