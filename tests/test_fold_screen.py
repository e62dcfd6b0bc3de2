"""Folds: the screen's whole rule and direction, and a filter that starts anew on each fold's bars."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import frame, hours, ou, walk

from spreadlab.config import Grid, Study
from spreadlab.operators import screen, signals, validation


def folded(spark):
    rng = np.random.default_rng(0)
    x = walk(rng, 700)
    df = frame(spark, close_y=np.exp(0.5 + 1.5 * x + ou(rng, 0.9, 0.01, 700)), close_x=np.exp(x))
    return df, validation.make_folds(df.select("open_time"), 400, 150)


def test_fold_books_screen_like_pair_screen(spark):
    df, folds = folded(spark)
    study = Study(min_overlap=300, half_life=(1, 100))
    got = {r.fold: (r.leg_y, r.leg_x, r.eg_p_max) for r in screen.fold_books(df, folds, study).collect()}
    want = {}
    for f in folds.collect():
        r = screen.pair_screen(df.where((F.col("open_time") >= f.train_start) & (F.col("open_time") < f.test_start)), study).first()
        if r.passed:
            want[f.fold] = (r.leg_y, r.leg_x, pytest.approx(r.eg_p_max))
    assert got == want and got
    turned = df.select("leg_y", "leg_x", "open_time", F.col("close_x").alias("close_y"), F.col("close_y").alias("close_x"))
    other = {r.fold: (r.leg_x, r.leg_y) for r in screen.fold_books(turned, folds, study).collect()}
    assert other == {k: v[:2] for k, v in want.items()}
    assert screen.fold_books(df, folds, Study(min_overlap=300, half_life=(100, 200))).count() == 0


def test_filter_starts_anew_on_each_fold(spark):
    df, folds = folded(spark)
    span = df.join(F.broadcast(folds), (F.col("open_time") >= F.col("train_start")) & (F.col("open_time") < F.col("test_end"))).select("fold", "leg_y", "leg_x", "open_time", "close_y", "close_x")
    got = signals.kalman_hedge(span, 48, (1e-5,), ("fold",)).where("fold = 1").orderBy("open_time").collect()
    alone = signals.kalman_hedge(span.where("fold = 1").drop("fold"), 48, (1e-5,)).orderBy("open_time").collect()
    assert [(r.open_time, r.beta) for r in got] == [(r.open_time, r.beta) for r in alone] and got[0].open_time == hours(150 + 49)[-1]
    market = df.withColumns({"rate_y": F.lit(0.0), "rate_x": F.lit(0.0)})
    study = Study(min_overlap=300, half_life=(1, 100), burn_in=48, train_bars=400, test_bars=150, trades_per_year=0.0, grid=Grid((1e-5,), (24,), (1.5,), (0.0,), (3.0,)))
    out, curve = validation.walkforward(df, market, df.select("open_time"), study)
    assert {r.status for r in out.collect()} == {"traded"} and curve.count() > 0
