"""Signals: the causal hedge ratio, the spread it leaves, z-scores, positions and weights.

Frames are keyed by pair and open_time; ``more`` names further keys, such as a parameter set."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursions import kalman, positions
from ..shared import by_groups
from .panel import PAIR, by_pair
from .stats import rolling_zscore


def kalman_hedge(pairs: DataFrame, burn_in: int, deltas: tuple[float, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """(pair, more, open_time, ly, lx, delta, alpha, beta) of the bars after the burn-in; pairs with
    no more bars than that give none. One task per pair (and each of ``more``) runs all deltas over its bars."""
    keys = [*PAIR, *more]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("open_time")
        y, x = np.log(g["close_y"].to_numpy(float)), np.log(g["close_x"].to_numpy(float))
        out = []
        for delta in deltas if len(g) > burn_in else ():
            got = kalman(y, x, burn_in, delta)
            out.append(g.iloc[burn_in:][[*keys, "open_time"]].assign(ly=y[burn_in:], lx=x[burn_in:], delta=delta, alpha=got[:, 0], beta=got[:, 1]))
        columns = [*keys, "open_time", "ly", "lx", "delta", "alpha", "beta"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    types = dict(pairs.dtypes)
    ddl = "".join(f"{k} {types[k]}, " for k in keys)
    return by_groups(pairs.select(*keys, "open_time", "close_y", "close_x"), *keys).applyInPandas(run, ddl + "open_time timestamp_ntz, ly double, lx double, delta double, alpha double, beta double")


def innovation_spread(hedged: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds spread: this bar's prices under the last bar's hedge ratio; the first bar goes."""
    w = by_pair("delta", *more)
    return hedged.withColumn("spread", F.col("ly") - (F.lag("alpha").over(w) + F.lag("beta").over(w) * F.col("lx"))).where("spread is not null")


def signal_frame(pairs: DataFrame, burn_in: int, deltas: tuple[float, ...], window: int) -> DataFrame:
    """(pair, delta, open_time, beta, spread, z); z is null while its window fills."""
    return rolling_zscore(innovation_spread(kalman_hedge(pairs, burn_in, deltas)), window, ("delta",)).select(*PAIR, "delta", "open_time", "beta", "spread", "z")


def with_positions(frame: DataFrame, rules: list[tuple[float, float, float]], more: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """(keys, open_time, beta, z, entry, exit, stop, desired) for each of the rules; z is rounded to ``digits``
    before it meets a threshold, so that the last bits of a sum decide nothing."""
    table = np.array(rules, dtype=float).reshape(-1, 3)
    keys = [*PAIR, *more]

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("open_time")
        got = positions(g["z"].to_numpy().astype(float), table).astype(np.int8)
        states = pa.ListArray.from_arrays(np.arange(len(got) + 1, dtype=np.int32) * len(table), got.ravel())
        return g.append_column("states", states)

    slim = frame.select(*keys, "open_time", "beta", F.round("z", digits).alias("z"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + ", states array<tinyint>"
    # A row comes back with the states of all rules; they become rows of their own outside of Python.
    each = by_groups(slim, *keys).applyInArrow(run, ddl).select(*slim.columns, F.posexplode("states").alias("rule", "state"))
    rule = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(x).alias("exit"), F.lit(s).alias("stop")) for e, x, s in table.tolist()])
    return each.withColumn("_r", F.get(rule, F.col("rule"))).select(*slim.columns, "_r.*", F.col("state").cast("long").alias("desired"))


def _since(event: Column, value: Column, w: Window) -> Column:
    """The value at the last row with the event, null where it was null there; the window's own sort serves it."""
    return F.last(F.when(event, F.struct(value.alias("v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["v"]


def cancel_bad_beta(frame: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """desired is 0 for whole episodes whose first bar's beta is not above 0."""
    w = by_pair(*more)
    rows = frame.withColumn("_opens", (F.col("desired") != 0) & (F.lag("desired", 1, 0).over(w) == 0))
    good = F.coalesce(_since(F.col("_opens"), F.col("beta"), w) > 0, F.lit(False))
    return rows.withColumn("desired", F.when(good, F.col("desired")).otherwise(F.lit(0))).drop("_opens")


def fresh_entries(frame: DataFrame, start: Column, more: tuple[str, ...] = (), end: Column | None = None) -> DataFrame:
    """desired is 0 before ``start`` and, with ``end``, from the second-to-last bar before it, so that nothing stays open."""
    inside = F.col("open_time") >= start
    if end is not None:
        back = F.row_number().over(Window.partitionBy(*PAIR, *more, F.col("open_time") < end).orderBy(F.col("open_time").desc()))
        inside = inside & (F.col("open_time") < end) & (back > 2)
    return frame.withColumn("desired", F.when(inside, F.col("desired")).otherwise(F.lit(0)))


def held_weights(frame: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds w_y and w_x: the desired state one bar later, at the hedge ratio known when it was decided, kept until the state
    changes. A new state with a hedge ratio not above 0 is an error."""
    w = by_pair(*more)
    rows = frame.withColumns({"_s": F.lag("desired", 1, 0).over(w), "_b": F.lag("beta").over(w)})
    rows = rows.withColumn("_changed", F.col("_s") != F.lag("_s", 1, 0).over(w))
    rows = rows.withColumn("_b", _since(F.col("_changed"), F.col("_b"), w))
    bad = (F.col("_s") != 0) & ~F.coalesce(F.col("_b") > 0, F.lit(False))
    safe = F.when(bad, F.raise_error(F.lit("an entry needs a hedge ratio above 0")).cast("double")).otherwise(F.col("_b"))
    flat = F.col("_s") == 0
    w_y = F.when(flat, 0.0).otherwise(F.col("_s") / (1 + safe))
    w_x = F.when(flat, 0.0).otherwise(-F.col("_s") * safe / (1 + safe))
    return rows.withColumns({"w_y": w_y, "w_x": w_x}).drop("_s", "_b", "_changed")


def turnover(frame: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    w = by_pair(*more)
    moved = lambda c: F.abs(F.col(c) - F.lag(c, 1, 0.0).over(w))
    return frame.withColumn("turnover", moved("w_y") + moved("w_x"))


def signal_summary(frame: DataFrame, stop: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a position series: bars, tradeable, entries, mean exits, stop-outs, open at the end, mean hold, share in the market."""
    w = by_pair(*more)
    prev = F.lag("desired", 1, 0).over(w)
    rows = frame.withColumns({"opens": ((F.col("desired") != 0) & (prev == 0)).cast("long"), "ends": (F.col("desired") == 0) & (prev != 0), "is_last": F.lead("open_time").over(w).isNull()})
    stopped = F.coalesce(F.col("ends") & (F.abs("z") >= stop), F.lit(False))
    held = F.sum((F.col("desired") != 0).cast("long"))
    return rows.groupBy(*PAIR, *more).agg(
        F.count(F.lit(1)).alias("bars"), F.count("z").alias("tradeable"), F.sum("opens").alias("entries"), F.sum((F.col("ends") & ~stopped).cast("long")).alias("mean_exits"), F.sum(stopped.cast("long")).alias("stop_outs"),
        F.sum((F.col("is_last") & (F.col("desired") != 0)).cast("long")).alias("open_at_end"), F.try_divide(held.cast("double"), F.sum("opens")).alias("avg_hold"), F.avg((F.col("desired") != 0).cast("double")).alias("pct_in_market"),
    )
