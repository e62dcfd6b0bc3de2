"""Parameter grids as arrays: a bar of a pair is one row, whose array columns have an element for each parameter set, in the order of
``Grid.product``. Rows that are sorted or shuffled are as many as the bars, whatever the number of sets; sets become rows only
where a portfolio's bars are summed up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Grid, Study
from ..functions.recursions import kalman, positions
from ..shared import by_groups
from .backtest import PARTS, backtest
from .metrics import sharpe
from .panel import PAIR, by_pair
from .stats import rolling_zscore

PARAMS = ("delta", "window", "entry", "exit", "stop")


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(width), pa.array(values.ravel(), kind))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """An array column without null elements but NaN, as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _added(df: DataFrame, **columns: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{k} {v}" for k, v in columns.items()])


def _hedges(market: DataFrame, study: Study, keys: list[str]) -> DataFrame:
    """market after the burn-in, with ly, lx and the filter's alpha and beta for each delta. A task runs all deltas over a pair's bars."""

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("open_time")
        y, x = (np.log(g[c].to_numpy().astype(float)) for c in ("close_y", "close_x"))
        some = len(y) > study.burn_in
        got = np.stack([kalman(y, x, study.burn_in, d) for d in study.grid.deltas], axis=1) if some else np.zeros((0, len(study.grid.deltas), 2))
        out = g.slice(study.burn_in if some else len(y))
        for name, values in (("ly", y[study.burn_in :]), ("lx", x[study.burn_in :])):
            out = out.append_column(name, pa.array(values, pa.float64()))
        for k, name in enumerate(("alpha", "beta")):
            out = out.append_column(name, _lists(got[:, :, k], pa.float64()))
        return out

    return by_groups(market, *keys).applyInArrow(run, _added(market, ly="double", lx="double", alpha="array<double>", beta="array<double>"))


def _scored(hedged: DataFrame, study: Study, more: tuple[str, ...]) -> DataFrame:
    """z of each delta and window (that of null is NaN) in place of ly, lx and alpha; the first bar, which has no earlier hedge ratio, goes.
    One sort serves all windows."""
    w = by_pair(*more)
    rows = hedged.withColumns({"_a": F.lag("alpha").over(w), "_b": F.lag("beta").over(w)})
    n = len(study.grid.deltas)
    rows = rows.withColumns({f"_s{i}": F.col("ly") - (F.get("_a", F.lit(i)) + F.get("_b", F.lit(i)) * F.col("lx")) for i in range(n)})
    names = []
    for i in range(n):
        for window in study.grid.windows:
            rows = rolling_zscore(rows.withColumn("spread", F.col(f"_s{i}")), window, more).withColumnRenamed("z", f"_z{i}_{window}")
            names.append(f"_z{i}_{window}")
    z = F.array(*[F.coalesce(F.round(c, 9), F.lit(float("nan"))) for c in names])
    rows = rows.withColumn("z", z).where("_s0 is not null")
    return rows.drop("spread", "ly", "lx", "alpha", "_a", "_b", *names, *[f"_s{i}" for i in range(n)])


def _since(event: np.ndarray, value: np.ndarray) -> np.ndarray:
    """In each column of event, the value (one a row) at the last row with an event; NaN before."""
    at = np.maximum.accumulate(np.where(event, np.arange(len(event))[:, None], -1), axis=0)
    return np.where(at >= 0, value[np.maximum(at, 0)], np.nan)


def held(desired: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(desired without episodes whose first bar's beta is not above 0, weight of leg y one bar later). Columns are sets of one delta."""
    before = np.zeros_like(desired[:1])
    opens = (desired != 0) & (np.concatenate([before, desired[:-1]]) == 0)
    kept = np.where(_since(opens, beta) > 0, desired, 0).astype(np.int8)
    state = np.concatenate([before, kept[:-1]])
    ratio = _since(state != np.concatenate([before, state[:-1]]), np.concatenate([[np.nan], beta[:-1]]))
    return kept, np.where(state == 0, 0.0, state / (1 + np.where(state == 0, 0.0, ratio)))


def grid_signals(market: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """market's columns, beta (array by delta), and by parameter set the arrays desired (positions, without episodes that open at a
    hedge ratio not above 0) and w (leg y's weight while the bar lasts; leg x's is w - sign(w)).

    market: pair, more, open_time, close_y, close_x and whatever a backtest needs. Pairs with no more bars than the burn-in give no rows."""
    keys = [*PAIR, *more]
    scored = _scored(_hedges(market, study, keys), study, more)
    rules = np.array([(e, x, s) for e in study.grid.entries for x in study.grid.exits for s in study.grid.stops], dtype=float)
    windows = len(study.grid.windows)

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("open_time")
        n = g.num_rows
        beta, z = _matrix(g["beta"], n), _matrix(g["z"], n)
        got = positions(z, rules)
        parts = [held(got[:, k], beta[:, k // windows]) for k in range(z.shape[1])]
        out = g.drop_columns(["z"])
        for name, kind, values in zip(("desired", "w"), (pa.int8(), pa.float64()), zip(*parts, strict=True), strict=True):
            out = out.append_column(name, _lists(np.concatenate(values, axis=1), kind))
        return out

    return by_groups(scored, *keys).applyInArrow(run, _added(scored.drop("z"), desired="array<tinyint>", w="array<double>"))


def grid_parts(frame: DataFrame, study: Study, more: tuple[str, ...] = (), names: tuple[str, ...] = PARTS) -> DataFrame:
    """Adds the parts of the profit as arrays by set, as :func:`~.backtest.backtest` gives them for one."""
    if study.next_open and not {"open_y", "open_x"} <= set(frame.columns):
        raise ValueError("fills at the next open need open_y and open_x")
    w = by_pair(*more)
    ret = lambda now, then: F.coalesce(F.try_divide(now, then) - 1, F.lit(0.0))
    moves = {}
    for leg in ("y", "x"):
        last, close = F.lag(f"close_{leg}").over(w), F.col(f"close_{leg}")
        moves[f"_r_{leg}"] = ret(close, F.col(f"open_{leg}")) if study.next_open else ret(close, last)
        moves[f"_o_{leg}"] = ret(F.col(f"open_{leg}"), last) if study.next_open else F.lit(0.0)
    rows = frame.withColumns({**moves, "_w": F.coalesce(F.lag("w").over(w), F.transform("w", lambda _: F.lit(0.0)))})

    def part(name: str):
        def of(now: Column, before: Column) -> Column:
            other, was = now - F.signum(now), before - F.signum(before)
            moved = F.abs(now - before) + F.abs(other - was)
            short = F.greatest(-now, F.lit(0.0)) + F.greatest(-other, F.lit(0.0))
            gross = before * F.col("_o_y") + now * F.col("_r_y") + (was * F.col("_o_x") + other * F.col("_r_x"))
            parts = {"gross": gross, "fee": moved * study.fee_bps / 1e4, "slip": moved * study.slip_bps / 1e4, "funding": -(now * F.col("rate_y") + other * F.col("rate_x")), "borrow": short * study.borrow_per_bar}
            parts["net"] = parts["gross"] - parts["fee"] - parts["slip"] + parts["funding"] - parts["borrow"]
            return parts[name]

        return of

    return rows.withColumns({p: F.zip_with("w", "_w", part(p)) for p in names}).drop("_w", *moves)


def _params(grid: Grid, place: Column) -> list[Column]:
    """The parameters of the set in a place."""
    size = len(grid.product())
    out = []
    for name, values in zip(PARAMS, (grid.deltas, grid.windows, grid.entries, grid.exits, grid.stops), strict=True):
        size //= len(values)
        kind = "int" if name == "window" else "double"
        out.append(F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.floor(place / size).cast("int") % len(values)).alias(name))
    return out


def _place(grid: Grid) -> Column:
    """The place of a set from its parameters."""
    out = F.lit(0)
    for name, values in zip(PARAMS, (grid.deltas, grid.windows, grid.entries, grid.exits, grid.stops), strict=True):
        out = out * len(values) + F.array_position(F.array(*[F.lit(v).cast("int" if name == "window" else "double") for v in values]), F.col(name)).cast("int") - 1
    return out


def grid_totals(results: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the parts of each pair and set, and whether they add up; summed before the shuffle."""
    each = results.select(*PAIR, *more, F.posexplode(F.arrays_zip(*PARTS)).alias("_i", "_p"))
    out = each.groupBy(*PAIR, *more, "_i").agg(*[F.sum(f"_p.{p}").alias(p) for p in PARTS])
    off = F.col("net") - (F.col("gross") - F.col("fee") - F.col("slip") + F.col("funding") - F.col("borrow"))
    return out.select(*PAIR, *more, *_params(study.grid, F.col("_i")), *PARTS, (F.abs(off) < 1e-9).alias("reconciled"))


def grid_portfolios(results: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """net, sharpe, bars, trades and eligibility of each set's portfolio at equal capital. results: w and net by set.

    Pairs are summed up bar by bar, element by element, in rows that hold all sets; the portfolio's bars, not the pairs', become a row a set."""
    w, sets = by_pair(*more), len(study.grid.product())
    opens = F.zip_with("w", "_w", lambda now, before: ((now != 0) & (F.coalesce(before, F.lit(0.0)) == 0)).cast("int"))
    rows = results.select(*PAIR, *more, "open_time", "w", "net", F.lag("w").over(w).alias("_w"), F.lag("open_time").over(w).isNull().cast("int").alias("_first"))
    rows = rows.withColumn("_w", F.coalesce("_w", F.transform("w", lambda _: F.lit(0.0)))).withColumn("_opens", opens)
    summed = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(sets)])
    port = rows.groupBy(*more, "open_time").agg(summed("net").alias("net"), summed("_opens").alias("trades"), F.sum("_first").alias("_first"))
    each = port.select(*more, "_first", F.posexplode(F.arrays_zip("net", "trades")).alias("_i", "_p"))
    n = F.sum("_first")  # a pair is counted at its first bar
    out = each.groupBy(*more, "_i").agg((F.sum("_p.net") / n).alias("net"), sharpe("_p.net", study.bars_per_year).alias("sharpe"), F.count(F.lit(1)).alias("bars"), F.sum("_p.trades").alias("trades"), n.alias("n_pairs"))
    floor = study.trades_per_year * F.col("bars") / study.bars_per_year * F.col("n_pairs")
    return out.select(*more, *_params(study.grid, F.col("_i")), "net", "sharpe", "bars", "trades", (F.col("trades") >= floor).alias("eligible"))


def set_signals(frame: DataFrame, best: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """The rows of one set (of each of ``more``; ``best`` has its parameters) as plain columns desired and beta, and the parameters."""
    chosen = best.select(*more, *PARAMS, _place(study.grid).alias("_i"))
    joined = frame.join(F.broadcast(chosen), [*more]) if more else frame.crossJoin(F.broadcast(chosen))  # a row, or one for each of more
    per = len(study.grid.product()) // len(study.grid.deltas)
    desired, beta = F.get("desired", F.col("_i")).cast("long"), F.get("beta", F.floor(F.col("_i") / per).cast("int"))
    arrays = {"desired", "beta", "w", *PARTS}
    return joined.select(*[c for c in frame.columns if c not in arrays], *PARAMS, desired.alias("desired"), beta.alias("beta"))


def set_results(frame: DataFrame, best: DataFrame, study: Study, more: tuple[str, ...] = ()) -> DataFrame:
    """The backtest of one set (of each of ``more``), with plain columns."""
    return backtest(set_signals(frame, best, study, more), study, more=(*PARAMS, *more))
