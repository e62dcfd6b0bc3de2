"""The two recursions over very long series, in chunks that run apart.

What a chunk of bars does is summed up in a small element that composes associatively: for the position rules the map of
their six states, for the filter an affine and Gaussian map. Chunks give their elements in parallel, a fold over a pair's elements, one row
a chunk, gives the state before each chunk, and chunks then run in parallel from there. A pair's bars are in one task
only to be numbered."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursions import filter_after, filter_element, kalman_start, kalman_step, position_map, positions
from ..shared import by_groups, stored
from .panel import PAIR

CHUNK = 4096


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


def _chunked(df: DataFrame, keys: list[str], size: int, skip: int = 0) -> DataFrame:
    """df with _chunk, and stored: it is read twice. The first ``skip`` rows of a series are chunk -1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("open_time")) - 1
    chunk = F.floor((n - skip) / size).cast("int")
    return stored(df.withColumn("_chunk", F.when(n < skip, -1).otherwise(chunk)), "chunks")


def chunked_positions(frame: DataFrame, rules: list[tuple[float, float, float]], more: tuple[str, ...] = (), digits: int = 9, size: int = CHUNK) -> DataFrame:
    """As :func:`~.signals.with_positions`, with several tasks a pair."""
    table, keys = np.array(rules, dtype=float).reshape(-1, 3), [*PAIR, *more]
    rows = _chunked(frame.select(*keys, "open_time", "beta", F.round("z", digits).alias("z")), keys, size)
    part = [*keys, "_chunk"]
    keyed = rows.select(*part)

    def summed(g: pa.Table) -> pa.Table:
        moved = position_map(g.sort_by("open_time")["z"].to_numpy().astype(float), table)
        return g.select(part).slice(0, 1).append_column("map", pa.array([moved.ravel().tolist()], pa.list_(pa.int8())))

    maps = by_groups(rows.select(*part, "open_time", "z"), *part).applyInArrow(summed, _ddl(keyed, "map array<tinyint>"))

    def folded(g: pa.Table) -> pa.Table:
        """State numbers before each chunk: a map looks up where the state before it leads."""
        g = g.sort_by("_chunk")
        state, out = np.ones(len(table), np.int64), []  # flat, not armed
        for m in g["map"].to_pylist():
            out.append(state.tolist())
            state = np.array(m, np.int64).reshape(6, -1)[state, np.arange(len(table))]
        return g.drop_columns(["map"]).append_column("state", pa.array(out, pa.list_(pa.int8())))

    starts = by_groups(maps, *keys).applyInArrow(folded, _ddl(keyed, "state array<tinyint>"))

    def run(g: pa.Table, start: pa.Table) -> pa.Table:
        g, state = g.sort_by("open_time"), np.array(start["state"][0].as_py())
        got = positions(g["z"].to_numpy().astype(float), table, (state % 3 - 1, state >= 3))
        lists = pa.ListArray.from_arrays(np.arange(len(got) + 1, dtype=np.int32) * np.int32(len(table)), pa.array(got.astype(np.int8).ravel()))
        return g.drop_columns(["_chunk"]).append_column("states", lists)

    slim = rows.drop("_chunk")
    each = rows.groupBy(*part).cogroup(starts.groupBy(*part)).applyInArrow(run, _ddl(slim, "states array<tinyint>"))
    rule = F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(x).alias("exit"), F.lit(s).alias("stop")) for e, x, s in table.tolist()])
    each = each.select(*slim.columns, F.posexplode("states").alias("rule", "state"))
    return each.withColumn("_r", F.get(rule, F.col("rule"))).select(*slim.columns, "_r.*", F.col("state").cast("long").alias("desired"))


def chunked_kalman(pairs: DataFrame, burn_in: int, deltas: tuple[float, ...], more: tuple[str, ...] = (), size: int = CHUNK) -> DataFrame:
    """As :func:`~.signals.kalman_hedge`, with several tasks a pair."""
    keys = [*PAIR, *more]
    rows = _chunked(pairs.select(*keys, "open_time", "close_y", "close_x"), keys, size, burn_in)
    part = [*keys, "_chunk"]
    names = ["a", "b", "p00", "p01", "p11", "r"]
    keyed = rows.select(*keys)

    def logs(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.log(g["close_y"].to_numpy(float)), np.log(g["close_x"].to_numpy(float))

    def begun(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("open_time")
        start = kalman_start(*logs(g)) if len(g) == burn_in else None
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), *start]] if start else [], columns=[*keys, *names])

    begins = stored(by_groups(rows.where("_chunk < 0"), *keys).applyInPandas(begun, _ddl(keyed, *[f"{n} double" for n in names])), "starts")

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("open_time")
        y, x = logs(g)
        numbers = [v for d in deltas for part_ in filter_element(y, x, d, float(g["r"].iloc[0])) for v in part_.ravel().tolist()]
        return pd.DataFrame([[*(g[k].iloc[0] for k in part), numbers]], columns=[*part, "element"])

    later = rows.where("_chunk >= 0")
    elements = by_groups(later.join(begins.select(*keys, "r"), keys), *part).applyInPandas(summed, _ddl(rows.select(*part), "element array<double>"))

    def folded(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_chunk")
        states, out = [tuple(float(g[n].iloc[0]) for n in names)] * len(deltas), []
        for numbers in g["element"]:
            out.append([v for s in states for v in s])
            each = np.asarray(numbers, float).reshape(len(deltas), 16)
            states = [filter_after(s, (e[:4].reshape(2, 2), e[4:6], e[6:10].reshape(2, 2), e[10:12], e[12:].reshape(2, 2))) for s, e in zip(states, each, strict=True)]
        return g[part].assign(state=out)

    starts = by_groups(elements.join(begins, keys), *keys).applyInPandas(folded, _ddl(rows.select(*part), "state array<double>"))

    def run(g: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        columns, out = [*keys, "open_time", "ly", "lx", "delta", "alpha", "beta"], []
        g = g.sort_values("open_time")
        y, x = logs(g)
        states = np.asarray(start["state"].iloc[0], float).reshape(len(deltas), 6) if len(start) else []
        for delta, state in zip(deltas if len(start) else (), states, strict=True):
            now, got = tuple(state.tolist()), np.empty((len(y), 2))
            for i in range(len(y)):
                now = kalman_step(now, y[i], x[i], delta)
                got[i] = now[:2]
            out.append(g[[*keys, "open_time"]].assign(ly=y, lx=x, delta=delta, alpha=got[:, 0], beta=got[:, 1]))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    ddl = _ddl(rows.select(*keys, "open_time"), "ly double", "lx double", "delta double", "alpha double", "beta double")
    return later.groupBy(*part).cogroup(starts.groupBy(*part)).applyInPandas(run, ddl)
