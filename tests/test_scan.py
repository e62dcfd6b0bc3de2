"""Recursions in chunks against the loops over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import hours, ou, walk

from spreadlab.functions.recursions import combined, filter_after, filter_element, kalman, kalman_start, position_map, positions
from spreadlab.operators import scan, signals

RULES = np.array([(2.0, 0.0, 3.0), (1.0, 0.5, 4.0), (1.5, -0.5, 2.0)])


def zs(rng, n):
    z = 2 * ou(rng, 0.9, 0.5, n)
    z[rng.random(n) < 0.05] = np.nan
    return z


def test_maps_of_runs_compose():
    rng = np.random.default_rng(1)
    for _ in range(30):
        z = zs(rng, 90)
        cut = rng.integers(0, 91)
        first, then, whole = position_map(z[:cut], RULES), position_map(z[cut:], RULES), position_map(z, RULES)
        assert (np.take_along_axis(then, first.astype(int), axis=0) == whole).all()
        assert (whole[1] % 3 - 1 == positions(z, RULES)[-1]).all()


def test_elements_of_runs_are_associative_and_exact():
    rng = np.random.default_rng(2)
    x = walk(rng, 400)
    y = 0.4 + 1.2 * x + ou(rng, 0.8, 0.01, 400)
    start = kalman_start(y[:50], x[:50])
    for delta in (1e-5, 1e-8, 1e-3):
        element = lambda a, b, d=delta: filter_element(y[a:b], x[a:b], d, start[5])
        parts = [element(50, 51), element(51, 190), element(190, 333), element(333, 400)]
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = combined(left, p)
        for p in parts[-2::-1]:
            right = combined(p, right)
        want = kalman(y, x, 50, delta)[-1]
        for e in (left, right, element(50, 400)):
            assert filter_after(start, e)[:2] == pytest.approx(tuple(want), abs=1e-9)


def test_half_a_million_bars():
    rng = np.random.default_rng(3)
    n = 500_000
    x = 3 + np.sin(np.arange(n) / 5000) + 0.05 * ou(rng, 0.99, 0.1, n)
    y = 0.4 + 1.2 * x + ou(rng, 0.8, 0.01, n)
    state = kalman_start(y[:1000], x[:1000])
    want, delta, size = kalman(y, x, 1000, 1e-5), 1e-5, scan.CHUNK
    for a in range(1000, n, size):
        b = min(a + size, n)
        state = filter_after(state, filter_element(y[a:b], x[a:b], delta, state[5]))
        assert state[:2] == pytest.approx(tuple(want[b - 1001]), abs=1e-9)


def series(spark, n=700):
    rng, parts = np.random.default_rng(4), []
    for k, pair in enumerate((("a", "b"), ("c", "d"), ("short", "e"))):
        x = walk(rng, n)
        pdf = pd.DataFrame({"leg_y": pair[0], "leg_x": pair[1], "open_time": hours(n), "close_y": np.exp(0.3 + x + ou(rng, 0.8, 0.01, n)), "close_x": np.exp(x), "beta": 1.0, "z": zs(rng, n)})
        parts.append(pdf[: 40 if k == 2 else n - 37 * k])
    df = spark.createDataFrame(pd.concat(parts)).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    return df.withColumn("z", F.nanvl("z", F.lit(None).cast("double")))


@pytest.mark.parametrize("size", [64, 652, 5000])
def test_chunks_give_the_whole_series(spark, size):
    df = series(spark)
    rules = [tuple(r) for r in RULES.tolist()]
    key = lambda d, *c: sorted(tuple(r[k] for k in c) for r in d.collect())
    columns = ("leg_y", "open_time", "entry", "exit", "stop", "desired")
    got, want = scan.chunked_positions(df, rules, size=size), signals.with_positions(df, rules)
    assert got.columns == want.columns and key(got, *columns) == key(want, *columns)
    got, want = (f(df, 48, (1e-5, 1e-7), **m) for f, m in ((scan.chunked_kalman, {"size": size}), (signals.kalman_hedge, {})))
    take = lambda d: {(r.leg_y, r.open_time, r.delta): (r.alpha, r.beta, r.ly, r.lx) for r in d.collect()}
    one, two = take(got), take(want)
    assert got.columns == want.columns and one.keys() == two.keys() and len(one) == 2 * (652 + 615)
    assert max(abs(a - b) for k in one for a, b in zip(one[k], two[k], strict=True)) < 1e-9


def test_no_bars(spark):
    df = series(spark).limit(0)
    assert scan.chunked_positions(df, [(2.0, 0.0, 3.0)]).count() == 0 == scan.chunked_kalman(df, 48, (1e-5,)).count()
