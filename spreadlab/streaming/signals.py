"""Hedge ratio, z-score and position bar by bar, with the same recursions as in batch.

The state of a pair is typed and bounded, whatever the length of the stream: the burn-in's prices as a list, until it is full; then the filter's
numbers and the position as values, and the z window as a map by place in a ring, of which a bar rewrites one entry.
It lies in the state store (RocksDB), not in the rows. A timer clears pairs that have been silent for long."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.recursions import kalman_start, kalman_step, position_step

#: The state store that typed state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "leg_y string, leg_x string, open_time timestamp_ntz, beta double, spread double, z double, desired long"
_COLUMNS = ["leg_y", "leg_x", "open_time", "beta", "spread", "z", "desired"]


class PairSignals(StatefulProcessor):
    """One pair's bars in time order; a row for each from the second after the burn-in on."""

    def __init__(self, burn_in: int, delta: float, window: int, rule: tuple[float, float, float], silent_ms: int | None) -> None:
        self.burn_in, self.delta, self.window, self.rule, self.silent_ms = burn_in, delta, window, rule, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prices = handle.getListState("prices", "y double, x double")
        self.filter = handle.getValueState("filter", "a double, b double, p00 double, p01 double, p11 double, r double, bars long")
        self.position = handle.getValueState("position", "pos long, armed boolean")
        self.ring = handle.getMapState("ring", "place int", "spread double")

    def _warm(self, y: np.ndarray, x: np.ndarray) -> int:
        """Takes bars into the burn-in as far as it goes; how many."""
        had = list(self.prices.get()) if self.prices.exists() else []
        taken = min(self.burn_in - len(had), len(y))
        new = list(zip(y[:taken].tolist(), x[:taken].tolist(), strict=True))
        if len(had) + taken < self.burn_in:
            self.prices.appendList(new)
        else:
            whole = np.array([*had, *new], dtype=float)
            self.filter.update((*kalman_start(whole[:, 0], whole[:, 1]), 0))
            self.prices.clear()
        return taken

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(rows).sort_values("open_time")
        y, x = (np.log(bars[c].to_numpy(float)) for c in ("close_y", "close_x"))
        out, at = [], 0
        if not self.filter.exists():
            at = self._warm(y, x)
        if at < len(y):
            *state, seen = self.filter.get()
            pos, armed = self.position.get() if self.position.exists() else (0, False)
            spreads = {k[0]: v[0] for k, v in self.ring.iterator()} if seen > 1 else {}
            changed = set()
            for i in range(at, len(y)):
                a, b = state[:2]
                state = kalman_step(tuple(state), y[i], x[i], self.delta)
                seen += 1
                if seen == 1:  # there is no earlier hedge ratio that is the filter's
                    continue
                spread, place = y[i] - (a + b * x[i]), (seen - 2) % self.window
                spreads[place] = spread
                changed.add(place)
                z = None
                if len(spreads) == self.window:
                    values = np.fromiter(spreads.values(), float, self.window)
                    sd = float(values.std(ddof=1))
                    z = (spread - float(values.mean())) / sd if sd > 0 else None
                pos, armed = position_step(pos, armed, None if z is None else round(z, 9), *self.rule)
                out.append((*key, bars["open_time"].iloc[i], state[1], spread, z, pos))
            self.filter.update((*map(float, state), seen))
            self.position.update((int(pos), bool(armed)))
            for place in changed:
                self.ring.updateValue((place,), (float(spreads[place]),))
        if self.silent_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(bars["open_time"].iloc[-1].timestamp() * 1000) + self.silent_ms)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"z": float, "beta": float, "spread": float, "desired": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A pair that was silent starts anew if it comes back."""
        for state in (self.prices, self.filter, self.position, self.ring):
            state.clear()
        yield pd.DataFrame(columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_signals(pairs: DataFrame, burn_in: int, delta: float, window: int, entry: float, exit: float, stop: float, silent: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """pairs: leg_y, leg_x, open_time, close_y, close_x, each bar once and in time order between micro-batches.

    ``silent`` is an interval, such as ``30 days``: a pair without a bar for so long of event time is forgotten; bars later than ``delay`` are
    then dropped. The session's state store must be :data:`PROVIDER`."""
    spark = pairs.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    silent_ms = None
    rows = pairs.select("leg_y", "leg_x", "open_time", "close_y", "close_x")
    if silent is not None:
        silent_ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {silent}"))).first()[0]
        rows = rows.withColumn("at", F.col("open_time").cast("timestamp")).withWatermark("at", delay)
    processor = PairSignals(burn_in, delta, window, (entry, exit, stop), silent_ms)
    mode = "None" if silent is None else "EventTime"
    return rows.groupBy("leg_y", "leg_x").transformWithStateInPandas(processor, _OUT, "Append", mode)
