"""Validation: parameter grids, a static split and walk-forward folds. Parameter sets and folds are
columns, so that a whole grid over all folds is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Grid, Study
from ..shared import stored
from . import grid
from .backtest import backtest, book_size, portfolio_curve
from .grid import PARAMS
from .metrics import sharpe
from .panel import PAIR, both_ways
from .screen import fold_books
from .signals import fresh_entries


def param_grid(spark: SparkSession, sets: Grid) -> DataFrame:
    return spark.createDataFrame(sets.product(), "delta double, window int, entry double, exit double, stop double")


def make_folds(calendar: DataFrame, train_bars: int, test_bars: int) -> DataFrame:
    """(fold, train_start, test_start, test_end) over the bars of a calendar: each fold starts test_bars
    later; the last may be short. test_end is one step after the last bar of a test. The calendar has a row per bar time."""
    w = Window.orderBy("open_time")
    rows = calendar.select("open_time", (F.row_number().over(w) - 1).alias("n"), (F.lead("open_time").over(w) - F.col("open_time")).alias("gap"))
    step = rows.where("n = 0").select(F.col("gap").alias("step"))
    last = rows.agg(F.max("n").alias("last"))
    starts = rows.where((F.col("n") % test_bars == 0)).select((F.col("n") / test_bars).cast("long").alias("fold"), F.col("open_time").alias("train_start"), F.col("n").alias("start"))
    at = rows.select(F.col("n").alias("m"), F.col("open_time").alias("when"))
    folds = starts.crossJoin(last).where(F.col("start") + train_bars <= F.col("last"))
    folds = folds.join(at.withColumnRenamed("when", "test_start"), F.col("m") == F.col("start") + train_bars).drop("m")
    folds = folds.join(at.withColumnRenamed("when", "test_last"), F.col("m") == F.least(F.col("start") + train_bars + test_bars - 1, F.col("last"))).drop("m")
    return folds.crossJoin(step).select("fold", "train_start", "test_start", (F.col("test_last") + F.col("step")).alias("test_end"))


def fold_assignment(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars in each fold, train or test. Folds are few (one per test_bars of the calendar) and are broadcast."""
    inside = (F.col("open_time") >= F.col("train_start")) & (F.col("open_time") < F.col("test_end"))
    return bars.join(F.broadcast(folds), inside).withColumn("part", F.when(F.col("open_time") < F.col("test_start"), "train").otherwise("test"))


def run_params(market: DataFrame, study: Study, more: tuple[str, ...] = (), names: tuple[str, ...] = ("net",)) -> DataFrame:
    """Backtests of every parameter set, as arrays by set: the parts in ``names``. market: pair, open_time, prices and rates."""
    return grid.grid_parts(grid.grid_signals(market, study, more), study, more, names)


def grid_search(results: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """net, sharpe, trades and eligibility of each parameter set's portfolio, ranked within ``more``. results: arrays by set."""
    out = grid.grid_portfolios(results, study, more)
    # Sets that trade alike differ in the last bits of their sums only: they are ties, which the parameters decide.
    w = Window.partitionBy(*more).orderBy(F.round("sharpe", 9).desc_nulls_last(), *PARAMS)
    return out.withColumn("place", F.row_number().over(w))


def grid_best(searched: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The eligible set with the best Sharpe ratio; no row where none is eligible."""
    w = Window.partitionBy(*more).orderBy("place")
    return searched.where("eligible and sharpe is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def static_split(market: DataFrame, study: Study, cutoff: Column) -> DataFrame:
    """The best set on bars before ``cutoff``, run once over the whole span: its portfolio with the part of each bar.
    No rows where no set is eligible."""
    chosen = static_results(market, study, cutoff)[2]
    return with_part(portfolio_curve(chosen, book_size(chosen)), cutoff)


def with_part(curve: DataFrame, cutoff: Column) -> DataFrame:
    return curve.withColumn("part", F.when(F.col("open_time") < cutoff, "train").otherwise("test"))


def static_results(market: DataFrame, study: Study, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(the grid on the bars before ``cutoff``, its best set, the results of that set over the whole span, the results of all sets as arrays)."""
    results = stored(run_params(market, study), "results")
    searched = stored(grid_search(results.where(F.col("open_time") < cutoff), study), "grid")
    best = grid_best(searched)
    return searched, best, grid.set_results(results, best, study), results


def fold_counts(folds: DataFrame) -> DataFrame:
    """One row: folds, traded, in cash for want of pairs, in cash for want of an eligible set."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return folds.agg(F.count(F.lit(1)).alias("folds"), is_("traded").alias("traded"), is_("cash_no_pairs").alias("cash_no_pairs"), is_("cash_no_config").alias("cash_no_config"))


def stitched(curve: DataFrame) -> DataFrame:
    """The folds' test bars as one series; a bar in two folds is an error."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("open_time")) > 1
    return curve.withColumn("net", F.when(twice, F.raise_error(F.lit("a test bar is in two folds")).cast("double")).otherwise(F.col("net")))


def walkforward(pairs: DataFrame, market: DataFrame, calendar: DataFrame, study: Study) -> tuple[DataFrame, DataFrame]:
    """(folds with status, stitched test portfolio). Each fold screens its training bars, picks its book and parameters there and
    trades the test bars with fresh entries; the filter starts anew on each fold's bars. Status: traded, cash_no_pairs or cash_no_config.

    Folds, books, market and signals are stored once each; signals exist for the books' pairs only."""
    folds = stored(make_folds(calendar, study.train_bars, study.test_bars), "folds")
    market = stored(market, "market")
    books = stored(fold_books(market.select(*pairs.columns), folds, study).select("fold", *PAIR), "books")
    sizes = book_size(books, ("fold",))
    inside = (F.col("open_time") >= F.col("train_start")) & (F.col("open_time") < F.col("test_end"))
    spans = books.join(folds, "fold")
    span = both_ways(market).join(spans, [*PAIR]).where(inside).drop("train_start", "test_start", "test_end")
    dates = folds.select("fold", "test_start", "test_end")
    results = stored(run_params(span, study, ("fold",)), "results").join(dates, "fold")
    searched = grid_search(results.where(F.col("open_time") < F.col("test_start")), study, ("fold",))
    best = stored(grid_best(searched, ("fold",)).select("fold", *PARAMS, F.col("sharpe").alias("train_sharpe")), "best")
    chosen = fresh_entries(grid.set_signals(results, best, study, ("fold",)), F.col("test_start"), ("fold",), F.col("test_end"))
    traded = backtest(chosen, study, more=("fold",)).where(F.col("open_time") >= F.col("test_start"))
    curve = stored(portfolio_curve(traded, sizes, ("fold",)), "curve")
    stats = curve.groupBy("fold").agg(F.sum("net").alias("test_net"), sharpe("net", study.bars_per_year).alias("test_sharpe"))
    out = folds.join(sizes, "fold", "left").join(best, "fold", "left").join(stats, "fold", "left")
    status = F.when(F.col("n_pairs").isNull(), "cash_no_pairs").when(F.col("delta").isNull(), "cash_no_config").otherwise("traded")
    return out.withColumn("status", status), stitched(curve)
