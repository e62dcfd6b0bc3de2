"""Pairs within a bar, rolling unit-root tests and the screen, against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import hours, ou, walk

from spreadlab.config import Study
from spreadlab.functions.adf import RollingEngleGranger, engle_granger_p, mackinnon_p
from spreadlab.operators import panel, screen, stats


def test_published_critical_values():
    # Asymptotic critical values for two variables and a constant (MacKinnon 2010).
    for tau, p in ((-3.89644, 0.01), (-3.33613, 0.05), (-3.04445, 0.10)):
        assert mackinnon_p(tau) == pytest.approx(p, rel=0.02)


@pytest.mark.parametrize(("window", "step"), [(48, 7), (100, 24), (100, 100), (250, 300), (60, 1)])
def test_sums_over_stretches_give_the_refits_p_values(window, step):
    rng = np.random.default_rng(window + step)
    for phi, far, slope in ((0.5, 0, 1.4), (0.9, 100, -1.0), (0.99, 10, 0.5), (1.0, 0, 0.8)):
        x = walk(rng, 420) + far
        y = 3 + slope * x + ou(rng, phi, 0.01, 420)
        got = RollingEngleGranger(y, x, window, step).p_values()
        assert [e for e, _, _ in got] == list(range(window - 1, 420, step))
        for end, one, two in got:
            a, b = y[end - window + 1 : end + 1], x[end - window + 1 : end + 1]
            assert (one, two) == pytest.approx((engle_granger_p(a, b), engle_granger_p(b, a)), abs=1e-9)


def test_windows_without_noise_or_movement_are_fitted_plainly():
    x = walk(np.random.default_rng(0), 300)
    for y in (2 * x + 1, np.full(300, 1.5), np.where(np.arange(300) < 150, 1.0, x)):
        for end, one, two in RollingEngleGranger(y, x, 100, 50).p_values():
            a, b = y[end - 99 : end + 1], x[end - 99 : end + 1]
            assert (one, two) == pytest.approx((engle_granger_p(a, b), engle_granger_p(b, a)), abs=1e-9)


def prices(spark, n=400):
    rng = np.random.default_rng(8)
    x = walk(rng, n)
    series = {"a": x, "b": 0.1 + 1.2 * x + ou(rng, 0.85, 0.01, n), "c": walk(rng, n), "d": 0.5 - 0.7 * x + ou(rng, 0.9, 0.02, n)}
    rows = [pd.DataFrame({"symbol": s, "open_time": hours(n), "close": np.exp(v)}) for s, v in series.items()]
    rows[3] = rows[3][50:]
    return spark.createDataFrame(pd.concat(rows)).withColumn("open_time", F.col("open_time").cast("timestamp_ntz")), series


def test_rolling_tests_copy_no_bars(spark):
    bars, series = prices(spark)
    pairs = panel.pair_align(bars)
    rolled = screen.rolling_eg(pairs, 150, 40)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 0  # the pairs of a bar
    got = {(r.leg_y, r.leg_x, r.window_end): r.eg_p_max for r in rolled.collect()}
    times = hours(400)
    for y, x in itertools.combinations("abcd", 2):
        skip = 50 if "d" in (y, x) else 0
        for s in range(skip, 400 - 150 + 1, 40):
            a, b = series[y][s : s + 150], series[x][s : s + 150]
            assert got.pop((y, x, times[s + 149])) == pytest.approx(max(engle_granger_p(a, b), engle_granger_p(b, a)), abs=1e-9)
    assert not got


def test_screen_is_one_pass_with_the_plain_figures(spark):
    bars, series = prices(spark)
    out = screen.pair_screen(panel.pair_align(bars), Study(min_overlap=360, half_life=(1, 100)))
    rows = {frozenset((r.leg_y, r.leg_x)): r for r in out.collect()}
    assert set(rows) == {frozenset(p) for p in itertools.combinations("abc", 2)}  # d has too few bars
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("TableScan") == 2 and plan.count("InPandas") == 1
    for r in rows.values():
        y, x = series[r.leg_y], series[r.leg_x]
        assert engle_granger_p(y, x) <= engle_granger_p(x, y)
        beta, alpha = np.polyfit(x, y, 1)
        u = y - alpha - beta * x
        phi = 1 + np.polyfit(u[:-1], np.diff(u), 1)[0]
        assert (r.alpha, r.beta) == pytest.approx((alpha, beta), abs=1e-9)
        assert r.half_life_bars == (pytest.approx(-math.log(2) / math.log(phi), rel=1e-7) if 0 < phi < 1 else None)
        assert r.ret_corr == pytest.approx(np.corrcoef(np.diff(y), np.diff(x))[0, 1], abs=1e-9)
    assert rows[frozenset("ab")].passed and rows[frozenset("ab")].rank == 1
    spread = stats.static_spread(panel.pair_align(bars).where("leg_y = 'a' and leg_x = 'b'"))
    turned = rows[frozenset("ab")].leg_y == "b"
    assert turned or stats.half_life(spread).first().half_life_bars == pytest.approx(rows[frozenset("ab")].half_life_bars, rel=1e-7)


def test_pairs_meet_within_their_bar(spark):
    t = hours(4)
    rows = [("b", t[0], 1.0, 10.0), ("a", t[0], 2.0, 20.0), ("c", t[0], 3.0, None), ("a", t[1], 4.0, 40.0), ("b", t[1], 5.0, 50.0), ("b", t[1], 5.5, 55.0), ("c", t[1], 6.0, 60.0), (None, t[1], 7.0, 70.0), ("c", t[2], 8.0, 80.0), ("a", None, 1.0, 1.0), ("b", None, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, close double, open double")
    whole = [r for r in rows if None not in r]
    want = sorted((y[1], y[0], x[0], y[2], y[3], x[2], x[3]) for y in whole for x in whole if y[1] == x[1] and y[0] < x[0])
    got = panel.pair_align(bars, ("close", "open"))
    assert got.columns == ["open_time", "leg_y", "close_y", "open_y", "leg_x", "close_x", "open_x"]
    take = lambda df: sorted((r.open_time, r.leg_y, r.leg_x, r.close_y, r.open_y, r.close_x, r.open_x) for r in df.collect())
    assert take(got) == want
    assert take(panel.pair_align(bars, ("close", "open"), wanted=[("c", "a"), ("b", "z")])) == [w for w in want if w[1:3] == ("a", "c")]
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert panel.pair_align(bars.limit(0)).count() == 0
