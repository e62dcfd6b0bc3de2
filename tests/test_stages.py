"""A study end to end on small data: ingestion, every stage, its tables and reports; and the stages' operators."""

import datetime as dt
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import T0, hours, ou, walk

from spreadlab import stages
from spreadlab.__main__ import main
from spreadlab.config import DAILY, ENV, HOURLY, Grid, Study, load
from spreadlab.operators import backtest, gaps, robustness, screen, validation
from spreadlab.sources import bars, feed, upsert
from spreadlab.streaming.bars import deduplicated, merge_batches, merged

STUDY = Study(
    start="2024-01-01", end="2024-02-20", train_end="2024-02-04", universe=("A", "B", "C"), aux=("IDX",), book=(("B", "A"), ("C", "A")), factor="IDX", benchmarks=("IDX",), subdir="try", min_overlap=300,
    half_life=(0.5, 200.0), burn_in=48, window=24, train_bars=500, test_bars=300, max_pairs=2, regime_window=24, eg_window=400, eg_step=200, trades_per_year=1.0, grid=Grid((1e-5, 1e-7), (12, 24), (1.5, 2.0), (0.0,), (3.0,)),
)


def prices():
    rng = np.random.default_rng(5)
    n = 1200
    a, idx = walk(rng, n), walk(rng, n)
    logs = {"A": a, "B": 0.3 + a + ou(rng, 0.85, 0.01, n), "C": 0.1 + 1.2 * a + ou(rng, 0.85, 0.01, n), "IDX": idx}
    return {s: np.exp(v) for s, v in logs.items()}


def bar_pages(symbol, start, end, limit):
    p, hour, first = prices()[symbol], 3_600_000, int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    k = range(max(0, -(-(start - first) // hour)), len(p))
    rows = [[first + i * hour, *[f"{p[i]:.10f}"] * 4, "1.0", first + (i + 1) * hour - 1, "1.0", 1, "0", "0", "0"] for i in k if not (symbol == "B" and 700 <= i < 703)]
    return [r for r in rows if r[0] < end][:limit]


def funding_pages(symbol, start, end, limit):
    return feed.sample_funding(symbol, start, end, limit)


def catalogue():
    return [{"symbol": s, "baseAsset": s, "quoteAsset": "USD", "status": "TRADING", "onboardDate": 1_600_000_000_000} for s in ("A", "B", "IDX")]


FETCH = {"bars": "test_stages:bar_pages", "premium": "test_stages:bar_pages", "funding": "test_stages:funding_pages", "catalogue": "test_stages:catalogue"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    for name in ("test_core.py", "test_stages.py"):  # the fetch functions run in the workers
        spark.sparkContext.addPyFile(str(pathlib.Path(__file__).with_name(name)))
    s = stages.Store(spark, str(tmp_path_factory.mktemp("study")), STUDY)
    stages.ingest(s, FETCH, 0, {"bars": 400})
    return s


def text(path):
    with open(path) as f:
        return f.read()


def test_ingestion_resumes_and_keeps_what_is_there(spark, store):
    bars_ = store.read("ohlcv", stages.OHLCV)
    counts = {r.symbol: r["count"] for r in bars_.groupBy("symbol").count().collect()}
    assert counts == {"A": 1200, "B": 1197, "C": 1200, "IDX": 1200}
    before = bars_.agg(F.sum("close")).first()[0], store.read("funding", stages.FUNDING).count(), store.read("premium_index", stages.PREMIUM).count()
    stages.ingest(store, FETCH, 0)
    assert (store.read("ohlcv", stages.OHLCV).agg(F.sum("close")).first()[0], store.read("funding", stages.FUNDING).count(), store.read("premium_index", stages.PREMIUM).count()) == before
    assert before[1] == gaps.event_counts(store.read("funding", stages.FUNDING)).agg(F.sum("n_events")).first()[0] > 0
    assert {r.symbol for r in store.read("symbols", stages.SYMBOLS).collect()} == {"A", "B", "IDX"}


def test_all_stages(spark, store):
    report = text(stages.provenance(store))
    assert "| B |" in report and "| B | 2024-01-30 04:00:00 | 2024-01-30 06:00:00 | 3 |" in report and "| C |" in report.split("catalogue lacks")[1].split("##")[0]
    stages.provenance(store)
    assert store.read("data_gaps", None, market=STUDY.market).count() == 1

    told = text(stages.pairs(store))
    assert "of 3 pairs pass" in told and "By chance alone 0.2" in told
    stored = lambda: store.read("pair_screen", None, train_end=STUDY.train_end)
    assert stored().count() == 3 and {"eg_p_max", "created_at"} <= set(stored().columns)
    stages.pairs(store)
    assert stored().count() == 3

    told = text(stages.make_signals(store))
    got = store.read("pair_signal", stages.SIGNAL)
    assert {(r.leg_y, r.leg_x) for r in got.select("leg_y", "leg_x").distinct().collect()} == set(STUDY.book)
    assert got.agg(F.max("open_time")).first()[0] < dt.datetime(2024, 2, 5) and "| B | A |" in told and got.where("position <> 0").count() > 0
    assert got.where("leg_y = 'C'").count() == 35 * 24 - 48 - 1

    told = text(stages.backtest(store))
    assert told.count("| portfolio |") == 1
    rows = store.read("pair_backtest", None)
    assert rows.count() == got.count() and "turnover" not in rows.columns and rows.where("abs(net - (gross - fee - slip + funding - borrow)) > 1e-12").count() == 0

    told = text(stages.measure(store))
    assert "no walk-forward series yet" in told
    told = text(stages.validate(store))
    assert "8 sets" in told and "folds:" in told and told.count("| train |") == 1
    series = upsert.read_net_csv(spark, store.apart("series", "walkforward"))
    assert series.count() == series.select("open_time").distinct().count() > 0 and "/try/" in store.apart("series", "walkforward")
    told = text(stages.measure(store))
    assert "walk-forward |" in told and "IDX held, test |" in told and "strategy, train |" in told and told.count("| B | A |") == 1
    told = text(stages.stress(store))
    assert all(h in told for h in ("## Costs", "train against test", "without a pair", "Regimes of IDX", "Cointegration over 400 bars"))


def test_daily_ingestion_rewrites_history(spark, tmp_path):
    with pytest.raises(ValueError):
        stages.ingest_daily(stages.Store(spark, str(tmp_path), STUDY), None, "2024-01-09")
    study = Study(interval="1d", market="equity", start="2024-01-02", train_end="2024-01-05", universe=("A", "B"), aux=("S",))
    store = stages.Store(spark, str(tmp_path), study)

    def frames(scale):
        days = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4, 5, 8)]
        rows = [(s, d, *[scale * (i + 10.0)] * 3, None if s == "B" and d.day == 3 else scale * 10.0, None) for s in ("A", "B", "S", "other") for i, d in enumerate(days)]
        return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")

    stages.ingest_daily(store, frames(1), "2024-01-08")
    stages.ingest_daily(store, frames(2), "2024-01-08")
    got = store.read("ohlcv", stages.OHLCV)
    assert got.groupBy("symbol").count().count() == 3 and got.count() == 11 and got.where("volume <> 0").count() == 0
    assert {float(r.close) for r in got.collect()} == {20.0} and store.read("symbols", stages.SYMBOLS).where("onboard_date = timestamp_ntz'2024-01-02'").count() == 3
    assert "| B | 2024-01-03 00:00:00 | 2024-01-03 00:00:00 | 1 |" in text(stages.provenance(store))


def test_command_line(spark, store, tmp_path, monkeypatch, capsys):
    with pytest.raises(SystemExit):
        main(["nothing", "--root", str(tmp_path)])
    path = tmp_path / "study.yaml"
    path.write_text("universe: [A, B, C]\nbook: [[B, A]]\nstart: 2024-01-01\ntrain_end: 2024-02-04\nmin_overlap: 300\nhalf_life: [0.5, 200]\nsubdir: cli\ngrid: {windows: [12]}\n")
    monkeypatch.setenv(ENV, str(path))
    study = load()
    assert study.book == (("B", "A"),) and study.grid.windows == (12,) and study.grid.deltas == HOURLY.grid.deltas and study.train_end == "2024-02-04" and study.half_life == (0.5, 200)
    main(["pairs", "--root", store.root])
    assert capsys.readouterr().out.strip().endswith("/reports/cli/pairs.md")
    path.write_text("interval: 1d\naux: [S]\nuniverse: [S, T]\n")
    assert load().window == DAILY.window and load().symbols == ("S", "T")
    path.write_text("no_such_name: 1\n")
    with pytest.raises(TypeError):
        load()
    monkeypatch.delenv(ENV)
    assert load() == HOURLY


def test_static_split_without_an_eligible_set_is_empty(spark):
    n = 200
    rng = np.random.default_rng(2)
    x = walk(rng, n)
    pdf = pd.DataFrame({"leg_y": "a", "leg_x": "b", "open_time": hours(n), "close_y": np.exp(x + ou(rng, 0.8, 0.01, n)), "close_x": np.exp(x), "rate_y": 0.0, "rate_x": 0.0})
    market = spark.createDataFrame(pdf).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    study = Study(burn_in=48, trades_per_year=1e6, grid=Grid((1e-5,), (24,), (2.0,), (0.0,), (3.0,)))
    assert validation.static_split(market, study, F.lit(hours(150)[-1]).cast("timestamp_ntz")).count() == 0


def test_leaving_a_pair_out(spark):
    rows = [{"leg_y": y, "leg_x": "x", "open_time": hours(9)[i], "net": v * (1 + i)} for y, v, r in (("a", 0.01, range(5)), ("b", 0.03, range(2, 7)), ("c", -0.02, range(9))) for i in r]
    df = spark.createDataFrame(pd.DataFrame(rows))
    start = hours(3)[-1]
    got = {r.leg_y: r for r in robustness.leave_one_out_stats(df, 8760, F.lit(start)).collect()}
    pdf = pd.DataFrame(rows)
    for y in "abc":
        rest = pdf[(pdf.leg_y != y) & (pdf.open_time >= start)].groupby("open_time").net.sum() / 2
        assert (got[y].net, got[y].sharpe, got[y].bars) == (pytest.approx(rest.sum()), pytest.approx(rest.mean() / rest.std() * 8760**0.5), len(rest))


def test_benchmark_takes_the_strategys_bars_first(spark):
    held = spark.createDataFrame([("s", hours(k + 1)[-1], 100.0 + k) for k in (0, 1, 3, 4, 5)], "symbol string, open_time timestamp_ntz, close double")
    on = spark.createDataFrame([(hours(k + 1)[-1],) for k in (1, 2, 3, 4)], "open_time timestamp_ntz")
    got = [r.net for r in backtest.benchmark_frame(held, on).orderBy("open_time").collect()]
    assert got == pytest.approx([0, 0, 0, 104 / 103 - 1])


def test_screen_on_plain_prices(spark):
    rng = np.random.default_rng(0)
    x = 100 + np.cumsum(rng.normal(0, 1, 600))
    pdf = pd.DataFrame({"leg_y": "a", "leg_x": "b", "open_time": hours(600), "close_y": 5 + 2 * x + ou(rng, 0.8, 1.0, 600), "close_x": x})
    df = spark.createDataFrame(pdf).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    r = screen.pair_screen(df, Study(min_overlap=100, half_life=(0.1, 100), use_log_prices=False)).first()
    own = {"a": pdf.close_y, "b": pdf.close_x}
    assert r.passed and r.beta == pytest.approx(np.polyfit(own[r.leg_x], own[r.leg_y], 1)[0]) and r.ret_corr == pytest.approx(np.corrcoef(pdf.close_y.diff()[1:], pdf.close_x.diff()[1:])[0, 1])
    assert screen.screen_counts(screen.pair_screen(df, Study(min_overlap=100)), 0.05).first().expected_by_chance == pytest.approx(0.05)


def test_parsers_and_spacing(spark):
    raw = spark.createDataFrame([("S", '[1704067200000, "1.5", "2.25", "1.0", "2.0", "", 0]')], "symbol string, raw string")
    r = bars.parse_premium(raw).first()
    assert (str(r.close)[:3], r.open_time, len(r)) == ("2.0", T0, 6)
    now, waits = [0.0], []
    get = feed.Spaced(lambda x: x, 0.35, clock=lambda: now[0], sleep=waits.append)
    assert [get(1), get(2)] == [1, 2] and waits == [0.35]
    now[0] = 9.0
    assert get(3) == 3 and waits == [0.35]


def test_stitched_series_refuses_overlaps(spark):
    df = spark.createDataFrame([(0, T0, 1.0), (1, T0, 2.0)], "fold int, open_time timestamp_ntz, net double")
    with pytest.raises(Exception, match="two folds"):
        validation.stitched(df).collect()
    assert validation.stitched(df.where("fold = 0")).count() == 1


def test_late_rewrites_and_replays(spark, tmp_path):
    schema = "symbol string, t int, volume double"
    batches = [[("a", 1, 1.0), ("b", 1, 2.0)], [("a", 1, 5.0)], [("c", 2, None), ("b", 1, 9.0), ("b", 1, 8.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = merge_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["symbol", "t"], str(tmp_path / "c"), buckets=4).start()
        q.processAllAvailable()
        q.stop()
    got = sorted(map(tuple, merged(spark, str(tmp_path / "out"), 2, schema).collect()))
    assert got == [("a", 1, 5.0), ("b", 1, 9.0), ("c", 2, 0.0)]
    assert sorted(map(tuple, merged(spark, str(tmp_path / "out"), 0, schema).collect())) == [("a", 1, 1.0), ("b", 1, 2.0)]
    (tmp_path / "out" / "versions" / "v2").rename(tmp_path / "lost")
    spark.createDataFrame([("d", 1, 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = merge_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), ["symbol", "t"], str(tmp_path / "c"), buckets=4).start()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        q.processAllAvailable()

    events = spark.createDataFrame([(i % 5, T0 + dt.timedelta(minutes=i % 5)) for i in range(10)], "event_id long, ts timestamp_ntz").coalesce(1)
    events.write.parquet(str(tmp_path / "e"))
    q = deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), ["event_id"], "ts", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 5


def test_scopes_and_series(spark, tmp_path):
    series = spark.createDataFrame([(T0, 0.5)], "open_time timestamp_ntz, net double")
    upsert.write_csv(series, str(tmp_path / "csv"))
    assert upsert.read_net_csv(spark, str(tmp_path / "csv")).collect() == series.collect()
    old = spark.createDataFrame([("a", "x", "u", "on", T0)], stages.SYMBOLS)
    new = spark.createDataFrame([("a", "other", "u", "off", None), ("b", "y", "u", "on", T0)], stages.SYMBOLS)
    assert sorted(map(tuple, upsert.upsert_catalogue(old, new).collect())) == [("a", "x", "u", "off", None), ("b", "y", "u", "on", T0)]
