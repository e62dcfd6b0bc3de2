"""The study from ingestion to reports: each stage reads the tables of the stages before it and writes its own.

``python -m spreadlab STAGE --root FOLDER [--config FILE]``. Tables are Parquet under the root, in folders by exchange, interval and
further scope; a stage replaces its scope as a whole, in one commit, so that running it again leaves no stale rows and breaking it off no half table. Reports are
Markdown, apart for each study (``subdir``)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Study
from .operators import backtest as bt
from .operators import gaps, metrics, panel, robustness, screen, signals, validation
from .operators.panel import PAIR
from .plans import report
from .shared import stored
from .sources import bars as src
from .sources import feed, upsert, versions

OHLCV = "symbol string, open_time timestamp_ntz, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume decimal(38,18), quote_volume decimal(38,18), n_trades bigint"
PREMIUM = "symbol string, open_time timestamp_ntz, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18)"
FUNDING = "symbol string, funding_time timestamp_ntz, funding_rate decimal(38,18), mark_price decimal(38,18)"
SYMBOLS = "symbol string, base_asset string, quote_asset string, status string, onboard_date timestamp_ntz"
#: Tables that lie by month, and the time that decides.
MONTHLY = {"ohlcv": "open_time", "premium_index": "open_time", "funding": "funding_time", "pair_signal": "open_time"}
_SHOWN = {c: report.percent for c in ("net", "gross", "costs", "fee", "slip", "funding", "borrow", "test_net", "max_drawdown", "hit_rate", "exposure", "pct_in_market", "share_passing", "share_positive")}
_SHOWN["delta"] = lambda v: "n/a" if v is None else f"{v:g}"
_SHOWN |= {c: report.number for c in ("sharpe", "ann_sortino", "train_sharpe", "test_sharpe", "beta", "ret_corr", "spearman", "least", "most", "ann_turnover")}


@dataclass
class Store:
    """The tables and reports of a study under a root folder."""

    spark: SparkSession
    root: str
    study: Study

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/tables/{name}"

    def apart(self, kind: str, name: str) -> str:
        """A path for one study: reports and series of another ``subdir`` lie elsewhere."""
        return "/".join(x for x in (self.root.rstrip("/"), kind, self.study.subdir, name) if x)

    def scope(self, **more: str) -> dict[str, str]:
        return {"exchange": self.study.exchange, "interval": self.study.interval, **more}

    def has(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _scope(self, name: str, **more: str) -> str:
        return upsert.scope_path(self.path(name), self.scope(**more))

    def read(self, name: str, schema: str, start: Column | None = None, end: Column | None = None, **more: str) -> DataFrame:
        """The rows of a scope, none where it was never written; ``start`` and ``end`` open only the months between, where the table lies by month."""
        return versions.read(self.spark, self._scope(name, **more), schema, month_of=MONTHLY.get(name), start=start, end=end)

    def update(self, name: str, schema: str, build: Callable[[DataFrame], DataFrame], append: bool = False, **more: str) -> None:
        """A new version of a scope from its newest rows, or with these after them; old versions go after a day."""
        versions.update(self.spark, self._scope(name, **more), schema, build, append, MONTHLY.get(name))
        versions.vacuum(self.spark, self._scope(name, **more))

    def replace(self, name: str, df: DataFrame, **more: str) -> None:
        versions.replace(df, self._scope(name, **more), MONTHLY.get(name))
        versions.vacuum(self.spark, self._scope(name, **more))

    def table(self, name: str, df: DataFrame, shown: dict | None = None) -> str:
        """A report's table. More rows than a report shows lie beside it, all of them, and the report counts them."""
        beside = self.apart("reports", f"{name}-rows")
        return report.table(df, shown, lambda rows: versions.replace(rows, beside), beside)

    def write_report(self, name: str, text: str) -> str:
        """One small file, through the same file system as the tables."""
        path = self.apart("reports", f"{name}.md")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
        out.write(text.encode())
        out.close()
        return path

    @property
    def cutoff(self) -> Column:
        """The first moment after the training bars: ``train_end`` is their last day."""
        return F.date_add(F.lit(self.study.train_end).cast("date"), 1).cast("timestamp_ntz")

    def bars(self, symbols: tuple[str, ...] | None = None, end: Column | None = None) -> DataFrame:
        """(symbol, open_time, close, open) of the universe by default, before ``end``; prices become doubles here."""
        rows = self.read("ohlcv", OHLCV, end=end).where(F.col("symbol").isin(list(symbols or self.study.universe)))
        return rows.select("symbol", "open_time", F.col("close").cast("double").alias("close"), F.col("open").cast("double").alias("open"))

    def rates(self) -> DataFrame:
        events = self.read("funding", FUNDING).withColumn("funding_rate", F.col("funding_rate").cast("double"))
        return panel.funding_per_bar(events, self.study.seconds)

    def pairs(self, end: Column | None = None) -> DataFrame:
        return panel.pair_align(self.bars(end=end), ("close", "open"))

    def of_book(self, end: Column | None = None) -> DataFrame:
        """The book's pairs, each in the book's direction; no others are made."""
        pairs = panel.pair_align(self.bars(end=end), ("close", "open"), wanted=list(self.study.book))
        book = self.spark.createDataFrame(list(self.study.book), "leg_y string, leg_x string")
        return panel.both_ways(pairs).join(F.broadcast(book), [*PAIR], "left_semi")  # the book is a setting


def _ms(day: str) -> Column:
    return F.unix_millis(F.lit(day).cast("timestamp"))


def ingest(store: Store, fetch: dict[str, str], now_ms: int, limits: dict[str, int] | None = None) -> None:
    """Bars, premium index, funding and the catalogue from paged fetch functions, named ``module:function`` under bars, premium,
    funding and catalogue; the last takes no arguments and returns a list. Each symbol goes on after its last row; rows that are there already stay as they are."""
    spark, study = store.spark, store.study
    spark.dataSource.register(feed.PagedFeed)
    first, last = spark.range(1).select(_ms(study.start), _ms(study.end) if study.end else F.lit(now_ms)).first()
    for name, schema, time, step, parse in (
        ("bars", OHLCV, "open_time", study.seconds * 1000, src.parse_klines), ("premium", PREMIUM, "open_time", study.seconds * 1000, src.parse_premium), ("funding", FUNDING, "funding_time", 1, src.parse_funding),
    ):
        if name not in fetch:
            continue
        table = {"bars": "ohlcv", "premium": "premium_index"}.get(name, name)
        known = store.read(table, schema)
        ends = upsert.resume_cursor(known, "symbol", time, step / 1000, F.lit(None).cast("timestamp_ntz")).select("symbol", F.unix_millis(F.col("resume_at").cast("timestamp")).alias("at"))
        starts = {r.symbol: r.at for r in ends.where(F.col("symbol").isin(list(study.symbols))).collect()}  # a row a symbol
        options = {"fetch": fetch[name], "symbols": ",".join(study.symbols), "start_ms": first, "end_ms": last, "step_ms": step, "limit": (limits or {}).get(name, 1000), "starts": json.dumps(starts), "calls_per_second": study.calls_per_second}
        raw = spark.read.format("paged_feed").options(**options, **({"time_field": "fundingTime"} if name == "funding" else {})).load()
        rows = stored(parse(raw).dropDuplicates(["symbol", time]), name)
        store.update(table, schema, lambda there, rows=rows, time=time: rows.join(there.select("symbol", time), ["symbol", time], "left_anti").select(*there.columns), append=True)
    if "catalogue" in fetch:
        module, _, function = fetch["catalogue"].partition(":")
        raw = [(json.dumps(x),) for x in getattr(__import__(module, fromlist=[function]), function)()]
        told = src.parse_catalogue(spark.createDataFrame(raw, "raw string")).where(F.col("symbol").isin(list(study.symbols)))
        store.update("symbols", SYMBOLS, lambda there: upsert.upsert_catalogue(there, told))


def ingest_daily(store: Store, frames: DataFrame, today: str) -> None:
    """Daily bars (symbol, open_time, open, high, low, close, volume) of a download, which may rewrite history: the new version
    of a bar wins, missing volume is 0. A symbol's onboarding is its first bar. Only for studies of daily bars."""
    study = store.study
    if study.interval != "1d":
        raise ValueError("daily bars need a study with interval 1d")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    fresh = src.clean_daily(frames.where(F.col("symbol").isin(list(study.symbols))), day(study.start), day(today))
    if study.end:
        fresh = fresh.where(F.col("open_time") <= day(study.end))
    cast = [F.col(c).cast("decimal(38,18)").alias(c) for c in ("open", "high", "low", "close", "volume")]
    fresh = fresh.select("symbol", "open_time", *cast, F.lit(None).cast("decimal(38,18)").alias("quote_volume"), F.lit(None).cast("bigint").alias("n_trades"), F.lit(1).alias("batch"))
    store.update("ohlcv", OHLCV, lambda there: upsert.keep_last(there.withColumn("batch", F.lit(0)).unionByName(fresh), ["symbol", "open_time"], ["batch"]).select(*fresh.columns[:-1]))
    bars = store.read("ohlcv", OHLCV)
    none = F.lit(None).cast("string")
    told = bars.groupBy("symbol").agg(F.min("open_time").alias("onboard_date")).select("symbol", none.alias("base_asset"), none.alias("quote_asset"), F.lit("TRADING").alias("status"), "onboard_date")
    store.update("symbols", SYMBOLS, lambda there: upsert.upsert_catalogue(there, told))


def provenance(store: Store) -> str:
    """Stores the gaps anew and reports coverage, event counts, symbols without catalogue entry and gaps."""
    study = store.study
    bars = stored(store.read("ohlcv", OHLCV).where(F.col("symbol").isin(list(study.symbols))), "bars")
    found = gaps.calendar_gaps(bars) if study.interval == "1d" else gaps.find_gaps(bars, study.seconds)
    found = stored(found.withColumn("detected_at", F.current_timestamp()), "gaps")
    store.replace("data_gaps", found, market=study.market)
    catalogue = store.read("symbols", SYMBOLS)
    wanted = store.spark.createDataFrame([(s,) for s in study.symbols], "symbol string")
    out = gaps.coverage(bars, study.seconds)
    if study.interval == "1d":  # a calendar has no bars on days off: count only its own slots
        lacking = found.groupBy("symbol").agg(F.sum("n_missing").alias("lacking"))
        out = out.join(lacking, "symbol", "left").withColumn("missing", F.coalesce("lacking", F.lit(0))).withColumn("expected", F.col("n_bars") + F.col("missing")).drop("lacking")
    out = wanted.join(out, "symbol", "left").join(catalogue.select("symbol", "onboard_date"), "symbol", "left")
    out = out.join(gaps.event_counts(store.read("funding", FUNDING)).select("symbol", "n_events"), "symbol", "left").na.fill(0, ["n_bars", "n_events"])
    absent = upsert.symbols_missing(wanted, catalogue)
    return store.write_report("provenance", report.document(
        "Where the data comes from", ("", f"{study.exchange}, {study.market}, bars of {study.interval} from {study.start} to {study.end or 'now'}."), ("Coverage", store.table("provenance-coverage", out.orderBy("symbol"))),
        ("Symbols that the catalogue lacks", store.table("provenance-absent", absent.orderBy("symbol"))), ("Gaps", store.table("provenance-gaps", found.select("symbol", "gap_start", "gap_end", "n_missing").orderBy("symbol", "gap_start"))),
    ))


def pairs(store: Store) -> str:
    """Screens all pairs of the universe on the training bars."""
    study = store.study
    found = stored(screen.pair_screen(store.pairs(store.cutoff), study), "screen")
    store.replace("pair_screen", found.drop("rank").withColumn("created_at", F.current_timestamp()), train_end=study.train_end)
    n = screen.screen_counts(found, study.adf_alpha).first()
    told = f"Bars up to {study.train_end}. {n.passed} of {n.tested} pairs pass: the worse direction below {study.adf_alpha}, half-life within {study.half_life[0]:g} to {study.half_life[1]:g} bars. By chance alone {n.expected_by_chance:.1f} would pass the first gate."
    shown = _SHOWN | {"half_life_bars": lambda v: report.duration(v, study.interval)}
    return store.write_report("pairs", report.document("Pair screen", ("", told), ("Ranking", store.table("pairs", found.select("rank", *PAIR, "n_bars", "beta", "eg_p_max", "half_life_bars", "ret_corr", "passed").orderBy("rank"), shown))))


SIGNAL = "leg_y string, leg_x string, open_time timestamp_ntz, beta double, spread double, z double, position int"


def make_signals(store: Store) -> str:
    """Signals of the book on the training bars."""
    study = store.study
    frame = stored(signals.signal_frame(store.of_book(store.cutoff), study.burn_in, (study.delta,), study.window), "frame")
    rule = (study.entry, study.exit, study.stop)
    rows = signals.cancel_bad_beta(signals.with_positions(frame, [rule], ("delta",)), ("delta",))
    rows = stored(rows.select(*PAIR, "open_time", "beta", "z", "desired").join(frame.select(*PAIR, "open_time", "spread"), [*PAIR, "open_time"]), "signals")
    store.replace("pair_signal", rows.select(*PAIR, "open_time", "beta", "spread", "z", F.col("desired").cast("int").alias("position")))
    out = signals.signal_summary(rows, study.stop)
    told = f"Bars up to {study.train_end}; in at {study.entry:g}, out at {study.exit:g}, stop at {study.stop:g} deviations over {study.window} bars. The first {study.burn_in + study.window} bars warm up."
    shown = _SHOWN | {"avg_hold": lambda v: report.duration(v, study.interval)}
    return store.write_report("signals", report.document("Signals", ("", told), ("Trades", store.table("signals", out.orderBy(*PAIR), shown))))


def load_signals(store: Store, end: Column) -> DataFrame:
    """The stored signals of the book before ``end``."""
    rows = store.read("pair_signal", SIGNAL, end=end)
    book = store.spark.createDataFrame(list(store.study.book), "leg_y string, leg_x string")
    return rows.join(F.broadcast(book), [*PAIR], "left_semi").where(F.col("open_time") < end)


def backtest(store: Store) -> str:
    """Backtests of the stored signals; an error if a sum does not add up."""
    study = store.study
    frame = bt.on_driving_bars(load_signals(store, store.cutoff).withColumnRenamed("position", "desired"), store.bars(end=store.cutoff), store.rates(), study.next_open)
    results = stored(bt.backtest(frame, study), "results")
    store.replace("pair_backtest", results.select(*PAIR, "open_time", "w_y", "w_x", *bt.PARTS))
    curve = bt.portfolio_curve(results, len(study.book)).select(F.lit("portfolio").alias("leg_y"), F.lit("").alias("leg_x"), *bt.PARTS)
    sums = stored(bt.totals(results).unionByName(bt.totals(curve)), "totals")
    if sums.where("not reconciled").count():
        raise ArithmeticError("profit and loss does not add up")
    fills = "the next bar's open" if study.next_open else "the close at which the signal is known"
    told = f"Bars up to {study.train_end}; filled at {fills}, fee {study.fee_bps:g} and slip {study.slip_bps:g} basis points of turnover, borrow {study.borrow_bps_per_year:g} a year. Sums on unit capital."
    return store.write_report("backtest", report.document("Backtest", ("", told), ("Parts", store.table("backtest", sums.drop("reconciled").orderBy(F.col("leg_x") == "", *PAIR), _SHOWN))))


def _split(store: Store) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    book = stored(bt.with_funding(store.of_book(), store.rates()), "book")
    found = validation.static_results(book, store.study, store.cutoff)
    if found[1].isEmpty():
        raise ValueError("no parameter set of the training bars is eligible")
    return found


def validate(store: Store) -> str:
    """The static split and the walk-forward; the stitched series goes to a CSV folder."""
    study = store.study
    searched, best, chosen, _ = _split(store)
    curve = validation.with_part(bt.portfolio_curve(chosen, len(study.book)), store.cutoff)
    static = metrics.summarize(curve, study.bars_per_year, ("part",), weights=False)
    market = bt.with_funding(store.pairs(), store.rates())
    folds, series = validation.walkforward(market.select(*PAIR, "open_time", "close_y", "close_x"), market, gaps.union_calendar(store.bars()), study)
    folds = stored(folds, "folds")
    upsert.write_csv(series.select("open_time", "net").coalesce(1), store.apart("series", "walkforward"))
    out = series.agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("bars"), metrics.sharpe("net", study.bars_per_year).alias("sharpe"))
    n, sets = validation.fold_counts(folds).first(), searched.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible")).first()
    return store.write_report("validation", report.document(
        "Validation", ("Static split", f"{sets.n} sets, {sets.eligible} with {study.trades_per_year:g} trades a year and pair or more; the best on the bars up to {study.train_end}, then frozen."),
        ("", report.table(best.select(*validation.PARAMS, "net", "sharpe", "trades"), _SHOWN)), ("", report.table(static.orderBy(F.desc("part")), _SHOWN)), ("The ten best sets of the training bars", report.table(searched.orderBy("place").limit(10), _SHOWN)),
        ("Walk-forward", f"{n.folds} folds: {n.traded} traded, {n.cash_no_pairs} in cash without pairs, {n.cash_no_config} in cash without an eligible set."), ("", report.table(out, _SHOWN)), ("", store.table("validation-folds", folds.orderBy("fold"), _SHOWN)),
    ))


def measure(store: Store) -> str:
    """Risk and trade figures of the frozen set, of the walk-forward series if there is one, and of the benchmarks on the same bars."""
    study, year = store.study, store.study.bars_per_year
    results = stored(validation.with_part(_split(store)[2], store.cutoff), "chosen")
    curve = validation.with_part(bt.portfolio_curve(results.drop("part"), len(study.book)), store.cutoff)
    rows = metrics.series_summary(curve, year, ("part",)).select(F.concat(F.lit("strategy, "), "part").alias("series"), "*").drop("part")
    extras = [metrics.portfolio_extras(results.where(F.col("part") == p), year).withColumn("series", F.lit(f"strategy, {p}")) for p in ("train", "test")]
    rows = rows.join(extras[0].unionByName(extras[1]), "series", "left")
    path = store.apart("series", "walkforward")
    if store.has(path):
        walked = metrics.series_summary(bt.oos_frame(upsert.read_net_csv(store.spark, path)).withColumn("series", F.lit("walk-forward")), year, ("series",))
        rows = rows.unionByName(walked, allowMissingColumns=True)
    for symbol in study.benchmarks:
        held = store.bars((symbol,))
        for part in ("train", "test"):
            frame = bt.benchmark_frame(held, curve.where(F.col("part") == part).select("open_time"))
            bench = metrics.series_summary(frame.withColumn("series", F.lit(f"{symbol} held, {part}")), year, ("series",)).withColumn("exposure", F.lit(1.0))
            rows = rows.unionByName(bench, allowMissingColumns=True)
    per = metrics.full_summary(results.where(F.col("part") == "test"), year)
    note = "" if store.has(path) else " There is no walk-forward series yet; the validate stage writes it."
    return store.write_report("metrics", report.document(
        "Metrics", ("", "Net of costs, on unit capital, not compounded. Benchmarks have no costs; the walk-forward's are inside its net." + note), ("Series", report.table(rows.orderBy("series"), _SHOWN)),
        ("Pairs, test bars", store.table("metrics-pairs", per.orderBy(*PAIR), _SHOWN)),
    ))


def stress(store: Store) -> str:
    """Costs, parameters, book, regimes and the persistence of cointegration, all of the frozen set on the test bars."""
    study, year, cut = store.study, store.study.bars_per_year, store.cutoff
    _, _, chosen, results = _split(store)
    chosen = stored(chosen, "chosen")
    costs = robustness.cost_stress(chosen, study.cost_multipliers, year, bt.book_size(chosen), cut)
    halves = [validation.grid_search(results.where(c), study) for c in (F.col("open_time") < cut, F.col("open_time") >= cut)]
    sets = robustness.grid_robustness(*halves, validation.PARAMS)
    without = robustness.leave_one_out_stats(chosen, year, cut)
    parts = [("Costs", report.table(costs.orderBy("multiplier"), _SHOWN)), ("Parameter sets, train against test", report.table(sets, _SHOWN)), ("The book without a pair", store.table("robustness-without", without.orderBy(*PAIR), _SHOWN))]
    if study.factor:
        curve = bt.portfolio_curve(chosen, len(study.book)).where(F.col("open_time") >= cut)
        regimes = robustness.regime_slices(curve, store.bars((study.factor,)), study.regime_window, year)
        parts.append((f"Regimes of {study.factor}", report.table(regimes.orderBy("regime"), _SHOWN)))
    windows = screen.rolling_eg(store.of_book(), study.eg_window, study.eg_step)
    parts.append((f"Cointegration over {study.eg_window} bars", store.table("robustness-rolling", screen.rolling_eg_summary(windows, study.adf_alpha).orderBy(*PAIR), _SHOWN)))
    return store.write_report("robustness", report.document("Robustness", ("", "All on the test bars, after the choice was made."), *parts))


STAGES: dict[str, Callable[[Store], str]] = {"provenance": provenance, "pairs": pairs, "signals": make_signals, "backtest": backtest, "validate": validate, "metrics": measure, "report": stress}


def run_all(store: Store) -> list[str]:
    return [stage(store) for stage in STAGES.values()]
