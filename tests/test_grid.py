"""The grid's arrays against one backtest after another with plain columns."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import hours, ou, walk

from spreadlab.config import Grid, Study
from spreadlab.operators import backtest as bt
from spreadlab.operators import grid, metrics, signals, validation

STUDY = Study(burn_in=48, borrow_bps_per_year=300.0, trades_per_year=15.0, grid=Grid((1e-5, 1e-7), (12, 24), (1.0, 1.5), (0.0, 0.4), (2.0, 3.0)))


def market(spark, n=260):
    rng, parts = np.random.default_rng(4), []
    for k, pair in enumerate((("a", "b"), ("a", "c"), ("late", "d"))):
        x = walk(rng, n)
        y = 0.2 + (-1.0 if k == 1 else 1.3) * x + ou(rng, 0.8, 0.01, n)
        pdf = pd.DataFrame({"leg_y": pair[0], "leg_x": pair[1], "open_time": hours(n), "close_y": np.exp(y), "close_x": np.exp(x), "open_y": np.exp(y + 0.001), "open_x": np.exp(x - 0.001), "rate_y": 0.0001 * (np.arange(n) % 8 == 0), "rate_x": -0.0002 * (np.arange(n) % 5 == 0)})
        parts.append(pdf[90:] if pair[0] == "late" else pdf)
    short = parts[0].head(40).assign(leg_y="short")  # not longer than the burn-in
    return spark.createDataFrame(pd.concat([*parts, short])).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


def plain(rows, study, params):
    delta, window, *rule = params
    frame = signals.signal_frame(rows, study.burn_in, (delta,), window)
    signal = signals.cancel_bad_beta(signals.with_positions(frame, [tuple(rule)], ("delta",)), ("delta",))
    return bt.backtest(signal.join(rows, ["leg_y", "leg_x", "open_time"]), study)


@pytest.mark.parametrize("next_open", [False, True])
def test_every_set_is_traded_as_alone(spark, next_open):
    study = replace(STUDY, next_open=next_open)
    rows = market(spark).cache()
    results = validation.run_params(rows, study, names=bt.PARTS).cache()
    sums = {tuple(r)[:7]: tuple(r)[7:-1] for r in grid.grid_totals(results, study).collect()}
    ranked = {tuple(r)[:5]: r for r in validation.grid_search(results, study).collect()}
    sets = study.grid.product()
    assert len(sums) == 3 * len(sets) == 96 and len(ranked) == 32
    traded = 0
    for params in sets[:: 3 if next_open else 5]:
        alone = plain(rows, study, params).cache()
        for r in bt.totals(alone).collect():
            assert sums[(r.leg_y, r.leg_x, *params)] == pytest.approx(tuple(r)[2:8], abs=1e-9)
        curve = bt.portfolio_curve(alone, 3)
        want = curve.agg(F.sum("net").alias("net"), metrics.sharpe("net", study.bars_per_year).alias("sharpe"), F.count(F.lit(1)).alias("bars")).first()
        trades = metrics.round_trips(alone).agg(F.sum("trades")).first()[0]
        got = ranked[params]
        assert (got.net, got.sharpe) == pytest.approx((want.net, want.sharpe), abs=1e-9) and (got.bars, got.trades) == (want.bars, trades)
        traded += trades
        one = grid.set_results(results, spark.createDataFrame([params], "delta double, window int, entry double, exit double, stop double"), study)
        key = lambda df: sorted((r.leg_y, r.leg_x, r.open_time, r.desired, round(r.net, 9)) for r in df.collect())
        assert key(one) == key(alone)
    assert traded > 20


def test_a_trade_under_way_at_a_cut_counts_on_both_sides(spark):
    results = validation.run_params(market(spark), STUDY).cache()
    for cut in (hours(130)[-1], hours(201)[-1]):
        halves = [validation.grid_search(results.where(c), STUDY) for c in (F.col("open_time") < F.lit(cut), F.col("open_time") >= F.lit(cut))]
        got = [{tuple(r)[:5]: r.trades for r in h.collect()} for h in halves]
        for params in STUDY.grid.product()[::7]:
            alone = plain(market(spark), STUDY, params)
            want = [metrics.round_trips(alone.where(c)).agg(F.sum("trades")).first()[0] for c in (F.col("open_time") < F.lit(cut), F.col("open_time") >= F.lit(cut))]
            assert [g[params] for g in got] == want


def test_rows_moved_do_not_depend_on_the_sets(spark):
    """Exchanges of a pair's bars have no column of a set; what is exchanged by set are sums, a row a set and task."""
    plan = validation.grid_search(validation.run_params(market(spark), STUDY), STUDY)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate posexplode")
    assert below.count("Generate") == 0 and "hashpartitioning(_i" in above and "hashpartitioning(_i" not in below
    assert "partial_sum" in above and below.count("hashpartitioning(open_time") == 1
