"""All queries of the package outside the subpackage for training data, with their SQL.

Each takes (spark, sf_dir), reads the given tables and works on whole tables. Values are rounded at
the edge, for sums in another order differ in their last bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SMALL as S
from ..operators import backtest as bt
from ..operators import gaps, grid, metrics, panel, robustness, scan, screen, signals, stats, validation
from ..operators.panel import PAIR
from ..shared import fresh_path, stored
from ..sources import bars as src
from ..sources import upsert, versions
from . import grid_sql, sql

HOUR, DAY = 3600, 86400
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


class Data:
    """The derived inputs of the queries."""

    def __init__(self, spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> None:
        self.spark, self.seconds = spark, seconds
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.orders_path = f"{sf_dir}/orders.parquet"

    @property
    def orders(self) -> DataFrame:
        return self.spark.read.parquet(self.orders_path)

    @property
    def bars(self) -> DataFrame:
        return src.hourly(self.events, self.seconds)

    @property
    def days(self) -> DataFrame:
        return src.daily(self.orders)

    @property
    def prices(self) -> DataFrame:
        return src.prices(self.events, self.seconds)

    @property
    def funding(self) -> DataFrame:
        return src.funding_events(self.events)

    @property
    def rates(self) -> DataFrame:
        return panel.funding_per_bar(self.funding, self.seconds)

    @property
    def raw_pairs(self) -> DataFrame:
        return panel.pair_align(self.bars)

    @property
    def pairs(self) -> DataFrame:
        return panel.pair_align(self.prices, ("close", "open"))

    @property
    def market(self) -> DataFrame:
        return bt.with_funding(self.pairs, self.rates)

    @property
    def spreads(self) -> DataFrame:
        return stats.static_spread(self.raw_pairs)

    @property
    def tape(self) -> DataFrame:
        """Positions by a closed rule, so that no other operator decides them."""
        n = F.row_number().over(panel.by_pair())
        rows = self.market.withColumn("rn", n)
        desired = F.when((F.col("rn") % 20).between(5, 14), F.when(F.col("rn") % 40 < 20, 1).otherwise(-1)).otherwise(0)
        return rows.withColumns({"desired": desired.cast("long"), "beta": 1 + (F.col("rn") % 7) / F.lit(10.0)})

    @property
    def results(self) -> DataFrame:
        return bt.backtest(self.tape, S)

    @property
    def frame(self) -> DataFrame:
        return signals.signal_frame(self.pairs, S.burn_in, (S.delta,), S.window)

    @property
    def signalled(self) -> DataFrame:
        return signals.cancel_bad_beta(signals.with_positions(self.frame, [(S.entry, S.exit, S.stop)], ("delta",)), ("delta",))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Data(spark, sf_dir, 6 * HOUR)
    return rounded(stats.rolling_zscore(stats.static_spread(d.raw_pairs), 12), "spread", "z").select(*PAIR, "open_time", "spread", "z")


_OHLC = ("open", "high", "low", "close")
_P = "leg_y, leg_x"


@_register("bars_hourly", sql.query(f"select symbol, open_time, open, high, low, close, {_r('volume', digits=4)}, n_trades from bars", *sql.BARS))
def _(spark, d):
    return rounded(Data(spark, d).bars, "volume", digits=4)


@_register("bars_daily", sql.query(f"select symbol, open_time, open, high, low, close, {_r('volume', digits=2)}, n_trades from days", *sql.DAILY))
def _(spark, d):
    return rounded(Data(spark, d).days, "volume", digits=2)


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for the comparison of values."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@_register("parse_kline", """
select event_type as symbol, ts - (epoch_us(ts) % 1000) * interval 1 microsecond as open_time, value as open, value as high, value as low,
    value as close, cast(user_id as double) as volume, cast(null as double) as quote_volume, event_id as n_trades from events""")
def _(spark, d):
    e = Data(spark, d).events
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    v = F.col("value").cast("decimal(38,2)").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = F.concat(F.lit("["), F.array_join(F.array(ms, quoted(v), quoted(v), quoted(v), quoted(v), quoted(F.col("user_id").cast("string")), ms, F.lit('""'), F.col("event_id").cast("string"), F.lit('"0"'), F.lit('"0"'), F.lit('"0"')), ", "), F.lit("]"))
    return _doubles(src.parse_klines(e.select(F.col("event_type").alias("symbol"), raw.alias("raw"))))


@_register("parse_funding", """
select event_type as symbol, ts - (epoch_us(ts) % 1000) * interval 1 microsecond as funding_time, value as funding_rate, case when event_id % 2 = 0 then cast(user_id as double) end as mark_price from events""")
def _(spark, d):
    e = Data(spark, d).events
    mark = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.lit(""))
    raw = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("fundingTime"), F.col("value").cast("decimal(38,2)").cast("string").alias("fundingRate"), mark.alias("markPrice")))
    return _doubles(src.parse_funding(e.select(raw.alias("raw"))))


@_register("clean_daily", sql.query(f"select symbol, open_time, open, high, low, close, {_r('volume', digits=2)}, n_trades from days where n_trades % 5 <> 0 and open_time >= timestamp '1995-02-01' and open_time < timestamp '2001-01-01'", *sql.DAILY))
def _(spark, d):
    days = Data(spark, d).days.withColumn("open", F.when(F.col("n_trades") % 5 != 0, F.col("open")))
    return rounded(src.clean_daily(days, F.lit("1995-02-01").cast("timestamp_ntz"), F.lit("2001-01-01").cast("timestamp_ntz")), "volume", digits=2)


@_register("drop_forming", sql.query("select symbol, open_time, close from bars where open_time + interval 1 hour <= (select max(ts) from events)", *sql.BARS))
def _(spark, d):
    x = Data(spark, d)
    now = F.broadcast(x.events.agg(F.max("ts").alias("now")))  # one row
    return src.drop_forming(x.bars.crossJoin(now), F.col("now"), HOUR).select("symbol", "open_time", "close")


@_register("upsert_keep_first", sql.query("select symbol, open_time, close from bars where open_time < timestamp '2024-01-10' union all select symbol, open_time, close + 1 from bars where open_time >= timestamp '2024-01-10'", *sql.BARS))
def _(spark, d):
    b = Data(spark, d).bars.select("symbol", "open_time", "close")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    fresh = b.where(F.col("open_time") >= F.lit("2024-01-05").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    return upsert.keep_first(b.where(F.col("open_time") < cut), fresh, ["symbol", "open_time"], ["close"])


@_register("upsert_keep_last", sql.query(f"select symbol, open_time, case when open_time >= timestamp '1998-01-01' then close * 0.5 else close end as close, case when n_trades % 3 = 0 then 0 else {'round(volume, 2)'} end as volume from days", *sql.DAILY))
def _(spark, d):
    days = Data(spark, d).days.select("symbol", "open_time", "close", F.when(F.col("n_trades") % 3 != 0, F.round("volume", 2)).alias("volume"), F.lit(1).alias("batch"))
    again = days.where(F.col("open_time") >= F.lit("1998-01-01").cast("timestamp_ntz")).withColumns({"close": F.col("close") * 0.5, "batch": F.lit(2)})
    return upsert.keep_last(days.unionByName(again), ["symbol", "open_time"], ["batch"]).drop("batch")


@_register("resume_cursor", sql.query("select symbol, max(open_time) + interval 1 hour as resume_at from bars group by symbol", *sql.BARS))
def _(spark, d):
    return upsert.resume_cursor(Data(spark, d).bars, "symbol", "open_time", HOUR, F.lit("2024-01-01").cast("timestamp_ntz"))


@_register("symbols_missing", sql.query("select distinct o_orderpriority as symbol from orders where o_orderpriority not in (select symbol from bars) union select distinct o_orderstatus from orders", *sql.BARS))
def _(spark, d):
    x = Data(spark, d)
    wanted = x.orders.select(F.explode(F.array("o_orderpriority", "o_orderstatus")).alias("symbol")).unionByName(x.events.select(F.col("event_type").alias("symbol"))).distinct()
    return upsert.symbols_missing(wanted, x.bars.select("symbol").distinct())


@_register("coverage", sql.query("""select symbol, min(open_time) as first_bar, max(open_time) as last_bar, count(*) as n_bars, cast(epoch(max(open_time) - min(open_time)) / 3600 + 1 as bigint) as expected,
    cast(epoch(max(open_time) - min(open_time)) / 3600 + 1 as bigint) - count(*) as missing from bars group by symbol""", *sql.BARS))
def _(spark, d):
    return gaps.coverage(Data(spark, d).bars, HOUR)


@_register("find_gaps", sql.query("""select symbol, prev + interval 1 hour as gap_start, open_time - interval 1 hour as gap_end, cast(epoch(open_time - prev) / 3600 as bigint) - 1 as n_missing
    from (select symbol, open_time, lag(open_time) over (partition by symbol order by open_time) as prev from bars) where open_time - prev > interval 1 hour""", *sql.BARS))
def _(spark, d):
    return gaps.find_gaps(Data(spark, d).bars, HOUR)


@_register("union_calendar", sql.query("select distinct open_time from days", *sql.DAILY))
def _(spark, d):
    return gaps.union_calendar(Data(spark, d).days)


@_register("calendar_gaps", sql.query("""select symbol, min(open_time) as gap_start, max(open_time) as gap_end, count(*) as n_missing from (
    select s.symbol, c.open_time, c.slot - row_number() over (partition by s.symbol order by c.slot) as run
    from (select open_time, row_number() over (order by open_time) as slot from (select distinct open_time from days)) c
    join (select symbol, min(open_time) as lo, max(open_time) as hi from days group by symbol) s on c.open_time between lo and hi
    left join days d on d.symbol = s.symbol and d.open_time = c.open_time where d.symbol is null) group by symbol, run""", *sql.DAILY))
def _(spark, d):
    return gaps.calendar_gaps(Data(spark, d).days)


@_register("panel_long", sql.query("select symbol, open_time, close from bars where symbol in ('click', 'purchase', 'view') and open_time < timestamp '2024-01-20'", *sql.BARS))
def _(spark, d):
    return panel.long_panel(Data(spark, d).bars, ["click", "purchase", "view"], F.lit("2024-01-20").cast("timestamp_ntz"))


@_register("panel_pivot", sql.query("select open_time, " + ", ".join(f"max(close) filter (symbol = '{x}') as {x}" for x in ("click", "error", "purchase", "signup", "view")) + " from bars group by open_time", *sql.BARS))
def _(spark, d):
    return panel.pivot_panel(panel.long_panel(Data(spark, d).bars))


@_register("slice_half_open", sql.query("select symbol, open_time, close from bars where open_time >= timestamp '2024-01-05' and open_time < timestamp '2024-01-12'", *sql.BARS))
def _(spark, d):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return panel.slice_half_open(Data(spark, d).bars, day("2024-01-05"), day("2024-01-12")).select("symbol", "open_time", "close")


@_register("train_test_split", sql.query("select case when open_time < timestamp '2024-01-21' then 'train' else 'test' end as part, count(*) as n, min(open_time) as first_bar, max(open_time) as last_bar from bars group by 1", *sql.BARS))
def _(spark, d):
    out = panel.train_test_split(Data(spark, d).bars, F.lit("2024-01-20").cast("date"))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"))


@_register("pair_candidates", sql.query("select a.symbol as leg_y, b.symbol as leg_x from (select distinct symbol from bars) a join (select distinct symbol from bars) b on a.symbol < b.symbol", *sql.BARS))
def _(spark, d):
    return panel.pair_candidates(Data(spark, d).bars)


@_register("pair_align", sql.query("select leg_y, leg_x, open_time, close_y, close_x from raw_pairs", *sql.FIT[:2]))
def _(spark, d):
    return Data(spark, d).raw_pairs.select(*PAIR, "open_time", "close_y", "close_x")


@_register("log_prices", sql.query("select symbol, open_time, round(ln(close), 6) as log_close from bars", *sql.BARS))
def _(spark, d):
    return rounded(panel.log_prices(Data(spark, d).bars), "log_close").select("symbol", "open_time", "log_close")


@_register("bar_returns", sql.query("select symbol, open_time, round(coalesce(close / nullif(lag(close) over (partition by symbol order by open_time), 0) - 1, 0), 6) as ret from bars", *sql.BARS))
def _(spark, d):
    return rounded(panel.bar_returns(Data(spark, d).bars), "ret").select("symbol", "open_time", "ret")


@_register("normalized_close", sql.query("select symbol, open_time, round(close / first_value(close) over (partition by symbol order by open_time), 6) as normalized from bars", *sql.BARS))
def _(spark, d):
    return rounded(panel.normalized_close(Data(spark, d).bars), "normalized").select("symbol", "open_time", "normalized")


@_register("funding_per_bar", sql.query("select symbol, open_time, round(rate, 9) as rate from rates", *sql.FUNDING))
def _(spark, d):
    return rounded(Data(spark, d).rates, "rate", digits=9)


@_register("funding_join", sql.query("select b.symbol, b.open_time, b.close, round(coalesce(rate, 0), 9) as rate from bars b left join rates r on r.symbol = b.symbol and r.open_time = b.open_time", *sql.FUNDING))
def _(spark, d):
    x = Data(spark, d)
    return rounded(panel.funding_join(panel.long_panel(x.bars), x.rates), "rate", digits=9)


@_register("funding_rolling_mean", sql.query("""select symbol, funding_time, case when count(*) over w >= 90 then round(avg(funding_rate) over w * 1e4, 6) end as mean_bps
    from funding window w as (partition by symbol order by funding_time rows between 89 preceding and current row)""", *sql.FUNDING))
def _(spark, d):
    return rounded(panel.funding_rolling_mean(Data(spark, d).funding), "mean_bps").select("symbol", "funding_time", "mean_bps")


@_register("ols_hedge", sql.query(f"select leg_y, leg_x, {_r('alpha', 'beta')}, n_bars from fit", *sql.FIT))
def _(spark, d):
    return rounded(stats.ols_hedge(Data(spark, d).raw_pairs), "alpha", "beta")


@_register("half_life", sql.query(f"""select leg_y, leg_x, case when phi > 0 and phi < 1 then round(-ln(2) / ln(phi), 5) end as half_life_bars from (
    select leg_y, leg_x, 1 + regr_slope(spread - l, l) as phi from (select *, lag(spread) over (partition by {_P} order by open_time) as l from spreads) group by all)""", *sql.FIT))
def _(spark, d):
    return rounded(stats.half_life(Data(spark, d).spreads), "half_life_bars", digits=5)


@_register("ret_corr", sql.query(f"select leg_y, leg_x, round(corr(dy, dx), 6) as ret_corr from (select leg_y, leg_x, ly - lag(ly) over w as dy, lx - lag(lx) over w as dx from raw_pairs window w as (partition by {_P} order by open_time)) group by all", *sql.FIT))
def _(spark, d):
    return rounded(stats.ret_corr(Data(spark, d).raw_pairs), "ret_corr")


@_register("rolling_beta", sql.query(f"""select leg_y, leg_x, open_time, case when count(*) over w >= {S.window} then round(covar_samp(ly, lx) over w / nullif(var_samp(lx) over w, 0), 6) end as rolling_beta
    from raw_pairs window w as (partition by {_P} order by open_time rows between {S.window - 1} preceding and current row)""", *sql.FIT))
def _(spark, d):
    return rounded(stats.rolling_beta(Data(spark, d).raw_pairs, S.window), "rolling_beta").select(*PAIR, "open_time", "rolling_beta")


@_register("rolling_zscore", sql.query(f"select leg_y, leg_x, open_time, {_r('spread', 'z')} from zs", *sql.Z))
def _(spark, d):
    return rounded(stats.rolling_zscore(Data(spark, d).spreads, S.window), "spread", "z").select(*PAIR, "open_time", "spread", "z")


@_register("trailing_vol", sql.query(f"""select symbol, open_time, case when count(r) over w >= {S.regime_window} then round(stddev_samp(r) over w, 6) end as vol
    from (select *, close / lag(close) over (partition by symbol order by open_time) - 1 as r from prices) window w as (partition by symbol order by open_time rows between {S.regime_window - 1} preceding and current row)""", *sql.PRICES))
def _(spark, d):
    return rounded(stats.trailing_vol(Data(spark, d).prices, S.regime_window), "vol").select("symbol", "open_time", "vol")


@_register("spread_bands", sql.query("select leg_y, leg_x, round(avg(spread) + 0.0, 6) as mid, round(avg(spread) - 2 * stddev_samp(spread), 6) as low, round(avg(spread) + 2 * stddev_samp(spread), 6) as high from spreads group by all", *sql.FIT))
def _(spark, d):
    return rounded(stats.spread_bands(Data(spark, d).spreads), "mid", "low", "high").withColumn("mid", F.col("mid") + F.lit(0.0))


@_register("spearman", sql.query(f"""select leg_y, leg_x, round(corr(ra, rb), 6) as spearman from (
    select leg_y, leg_x, rank() over (partition by {_P} order by close_y) + (count(*) over (partition by {_P}, close_y) - 1) / 2.0 as ra, rank() over (partition by {_P} order by close_x) + (count(*) over (partition by {_P}, close_x) - 1) / 2.0 as rb from raw_pairs) group by all""", *sql.FIT))
def _(spark, d):
    return rounded(stats.spearman(Data(spark, d).raw_pairs, "close_y", "close_x", PAIR), "spearman")


@_register("engle_granger", sql.query(f"select split_part(unit, '~', 1) as leg_y, split_part(unit, '~', 2) as leg_x, cast(n_bars as bigint) as n_bars, {_r('p_forward', 'p_reverse')} from eg", *grid_sql.EG))
def _(spark, d):
    return rounded(screen.engle_granger(Data(spark, d).pairs, S.min_overlap), "p_forward", "p_reverse")


@_register("pair_screen", sql.query(f"select leg_y, leg_x, cast(n_bars as bigint) as n_bars, {_r('eg_p', 'eg_p_max', 'alpha', 'beta', 'half_life_bars', 'ret_corr')}, passed, cast(place as int) as rank from screen", *grid_sql.SCREEN))
def _(spark, d):
    return rounded(screen.pair_screen(Data(spark, d).pairs, S), "alpha", "beta", "eg_p", "eg_p_max", "half_life_bars", "ret_corr")


@_register("rolling_eg", sql.query(f"select leg_y, leg_x, window_end, {_r('eg_p_max')} from rolled", *grid_sql.ROLLING))
def _(spark, d):
    return rounded(screen.rolling_eg(Data(spark, d).pairs, S.eg_window, S.eg_step), "eg_p_max")


@_register("rolling_eg_summary", sql.query("select leg_y, leg_x, round(min(eg_p_max), 6) as least_p, round(median(eg_p_max), 6) as median_p, round(avg(case when eg_p_max < 0.05 then 1.0::double else 0 end), 6) as share_passing from rolled group by all", *grid_sql.ROLLING))
def _(spark, d):
    return rounded(screen.rolling_eg_summary(screen.rolling_eg(Data(spark, d).pairs, S.eg_window, S.eg_step)), "least_p", "median_p", "share_passing")


@_register("fold_books", sql.query(f"select fold, leg_y, leg_x, cast(place as int) as place, {_r('eg_p_max')} from books", *grid_sql.BOOKS))
def _(spark, d):
    x = Data(spark, d)
    return rounded(screen.fold_books(x.pairs, validation.make_folds(gaps.union_calendar(x.bars), S.train_bars, S.test_bars), S), "eg_p_max")


@_register("kalman_hedge", sql.query(f"select leg_y, leg_x, open_time, {_r('alpha', 'beta')} from hedged", *sql.KALMAN))
def _(spark, d):
    return rounded(signals.kalman_hedge(Data(spark, d).pairs, S.burn_in, (S.delta,)), "alpha", "beta").select(*PAIR, "open_time", "alpha", "beta")


@_register("pair_spread", sql.query(f"select leg_y, leg_x, open_time, {_r('spread')} from innov", *sql.KALMAN))
def _(spark, d):
    x = signals.innovation_spread(signals.kalman_hedge(Data(spark, d).pairs, S.burn_in, (S.delta,)))
    return rounded(x, "spread").select(*PAIR, "open_time", "spread")


@_register("signal_frame", sql.query(f"select leg_y, leg_x, open_time, {_r('beta', 'spread', 'z', digits=5)} from zframe", *sql.KALMAN))
def _(spark, d):
    return rounded(Data(spark, d).frame, "beta", "spread", "z", digits=5).drop("delta")


_STATIC_Z = (*sql.Z, sql.fsm("zs", beta="1.0"))
_SIGNALS = (*sql.KALMAN, sql.fsm("zframe"), sql.CANCELLED.format(source="positioned"))


@_register("positions", sql.query("select leg_y, leg_x, open_time, desired from positioned", *_STATIC_Z))
def _(spark, d):
    z = stats.rolling_zscore(Data(spark, d).spreads, S.window)
    return signals.with_positions(z, [(S.entry, S.exit, S.stop)]).select(*PAIR, "open_time", "desired")


@_register("pair_signals", sql.query(f"select leg_y, leg_x, open_time, {_r('beta', 'z')}, cast(desired as bigint) as desired from cancelled", *_SIGNALS))
def _(spark, d):
    return rounded(Data(spark, d).signalled, "beta", "z").select(*PAIR, "open_time", "beta", "z", "desired")


@_register("signal_summary", sql.query(f"""select leg_y, leg_x, count(*) as bars, count(z) as tradeable, cast(sum(opens) as bigint) as entries, cast(sum(case when ends and not stopped then 1 else 0 end) as bigint) as mean_exits,
    cast(sum(case when stopped then 1 else 0 end) as bigint) as stop_outs, cast(sum(case when nxt is null and desired <> 0 then 1 else 0 end) as bigint) as open_at_end,
    round(sum(case when desired <> 0 then 1 else 0 end)::double / nullif(sum(opens), 0), 6) as avg_hold, round(avg(case when desired <> 0 then 1.0::double else 0 end), 6) as pct_in_market
    from (select *, case when desired <> 0 and pd = 0 then 1 else 0 end as opens, desired = 0 and pd <> 0 as ends, coalesce(desired = 0 and pd <> 0 and abs(z) >= {S.stop}, false) as stopped from (
        select *, coalesce(lag(desired) over w, 0) as pd, lead(open_time) over w as nxt from cancelled window w as (partition by {_P} order by open_time))) group by all""", *_SIGNALS))
def _(spark, d):
    return rounded(signals.signal_summary(Data(spark, d).signalled, S.stop, ("delta",)), "avg_hold", "pct_in_market").drop("delta")


_DIPPED = "dipped as (select * exclude (beta), case when rn % 9 < 3 then -beta else beta end as beta from tape)"


@_register("cancel_bad_beta", sql.query("select leg_y, leg_x, open_time, cast(desired as bigint) as desired from cancelled", *sql.TAPE, _DIPPED, sql.CANCELLED.format(source="dipped")))
def _(spark, d):
    tape = Data(spark, d).tape.withColumn("beta", F.when(F.col("rn") % 9 < 3, -F.col("beta")).otherwise(F.col("beta")))
    return signals.cancel_bad_beta(tape).select(*PAIR, "open_time", "desired")


@_register("held_weights", sql.query(f"select leg_y, leg_x, open_time, {_r('w_y', 'w_x')} from held", *sql.TAPE, sql.held("tape")))
def _(spark, d):
    return rounded(signals.held_weights(Data(spark, d).tape), "w_y", "w_x").select(*PAIR, "open_time", "w_y", "w_x")


@_register("turnover", sql.query(f"select leg_y, leg_x, open_time, {_r('turnover')} from turned", *sql.TAPE, sql.held("tape")))
def _(spark, d):
    return rounded(signals.turnover(signals.held_weights(Data(spark, d).tape)), "turnover").select(*PAIR, "open_time", "turnover")


@_register("fresh_entries", sql.query(f"""select leg_y, leg_x, open_time, cast(case when open_time >= timestamp '2024-01-10' and open_time < timestamp '2024-01-20' and back > 2 then desired else 0 end as bigint) as desired
    from (select *, row_number() over (partition by {_P}, open_time < timestamp '2024-01-20' order by open_time desc) as back from tape)""", *sql.TAPE))
def _(spark, d):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return signals.fresh_entries(Data(spark, d).tape, day("2024-01-10"), (), day("2024-01-20")).select(*PAIR, "open_time", "desired")


_PARTS = ("gross", "fee", "slip", "funding", "borrow", "net")


@_register("backtest_close", sql.query(f"select leg_y, leg_x, open_time, {_r('w_y', 'w_x', 'turnover', *_PARTS, digits=11)} from bt", *sql.RESULT))
def _(spark, d):
    return rounded(Data(spark, d).results, "w_y", "w_x", "turnover", *_PARTS, digits=11).select(*PAIR, "open_time", "w_y", "w_x", "turnover", *_PARTS)


@_register("backtest_next_open", sql.query(f"select leg_y, leg_x, open_time, {_r('gross', 'net', digits=8)} from bt", *sql.RESULT_OPEN))
def _(spark, d):
    return rounded(bt.backtest(Data(spark, d).tape, S, next_open=True), "gross", "net", digits=8).select(*PAIR, "open_time", "gross", "net")


@_register("pnl_totals", sql.query(f"select leg_y, leg_x, {', '.join(f'round(sum({p}), 7) as {p}' for p in _PARTS)}, abs(sum(net) - (sum(gross) - sum(fee) - sum(slip) + sum(funding) - sum(borrow))) < 1e-9 as reconciled from bt group by all", *sql.RESULT))
def _(spark, d):
    return rounded(bt.totals(Data(spark, d).results), *_PARTS, digits=7)


@_register("portfolio_curve", sql.query(f"select open_time, {_r(*_PARTS, digits=11)} from port", *sql.PORT))
def _(spark, d):
    x = Data(spark, d).results
    return rounded(bt.portfolio_curve(x, bt.book_size(x)), *_PARTS, digits=11)


@_register("benchmark_frame", sql.query("select symbol, open_time, round(r, 7) as gross, 0.0::double as fee, 0.0::double as slip, 0.0::double as funding, 0.0::double as borrow, round(r, 7) as net from (select *, coalesce(close / lag(close) over (partition by symbol order by open_time) - 1, 0) as r from prices)", *sql.PRICES))
def _(spark, d):
    return rounded(bt.benchmark_frame(Data(spark, d).prices), "gross", "net", digits=7)


@_register("equity_curve", sql.query(f"select leg_y, leg_x, open_time, {_r('equity')} from curves", *sql.CURVES))
def _(spark, d):
    return rounded(metrics.equity_curve(Data(spark, d).results), "equity").select(*PAIR, "open_time", "equity")


@_register("drawdown_curve", sql.query(f"select leg_y, leg_x, open_time, {_r('equity', 'drawdown')} from curves", *sql.CURVES))
def _(spark, d):
    return rounded(metrics.drawdown_curve(Data(spark, d).results), "equity", "drawdown").select(*PAIR, "open_time", "equity", "drawdown")


_Y = f"sqrt({float(S.bars_per_year)})"
_SHARPE, _SORTINO = f"avg(net) / nullif(stddev_samp(net), 0) * {_Y}", f"avg(net) / nullif(sqrt(avg(least(net, 0) ** 2)), 0) * {_Y}"
_HOLD = "sum(case when active then 1 else 0 end)::double / nullif(sum(opens), 0)"
_TURN = f"sum(turnover) / count(*) * {S.bars_per_year}"
_PNLS = "select leg_y, leg_x, episode, sum(net) as pnl from eps where active or was_active group by all"


@_register("ann_sharpe", sql.query(f"select leg_y, leg_x, round({_SHARPE}, 5) as ann_sharpe from bt group by all", *sql.RESULT))
def _(spark, d):
    return rounded(metrics.ann_sharpe(Data(spark, d).results, S.bars_per_year), "ann_sharpe", digits=5)


@_register("ann_sortino", sql.query(f"select leg_y, leg_x, round({_SORTINO}, 5) as ann_sortino from bt group by all", *sql.RESULT))
def _(spark, d):
    return rounded(metrics.ann_sortino(Data(spark, d).results, S.bars_per_year), "ann_sortino", digits=5)


@_register("max_drawdown", sql.query("select leg_y, leg_x, round(min(drawdown), 6) as max_drawdown from curves group by all", *sql.CURVES))
def _(spark, d):
    return rounded(metrics.max_drawdown(Data(spark, d).results), "max_drawdown")


@_register("round_trips", sql.query("select leg_y, leg_x, cast(sum(opens) as bigint) as trades from eps group by all", *sql.EPISODES))
def _(spark, d):
    return metrics.round_trips(Data(spark, d).results)


@_register("trade_pnls", sql.query(f"select leg_y, leg_x, cast(episode as bigint) as episode, round(pnl, 7) as pnl from ({_PNLS})", *sql.EPISODES))
def _(spark, d):
    return rounded(metrics.trade_pnls(Data(spark, d).results), "pnl", digits=7)


@_register("hit_rate", sql.query(f"select leg_y, leg_x, round(avg(case when pnl > 0 then 1.0::double else 0 end), 6) as hit_rate from ({_PNLS}) group by all", *sql.EPISODES))
def _(spark, d):
    return rounded(metrics.hit_rate(Data(spark, d).results), "hit_rate")


@_register("avg_holding", sql.query(f"select leg_y, leg_x, round({_HOLD}, 6) as avg_holding from eps group by all", *sql.EPISODES))
def _(spark, d):
    return rounded(metrics.avg_holding(Data(spark, d).results), "avg_holding")


@_register("ann_turnover", sql.query(f"select leg_y, leg_x, round({_TURN}, 5) as ann_turnover from bt group by all", *sql.RESULT))
def _(spark, d):
    return rounded(metrics.ann_turnover(Data(spark, d).results, S.bars_per_year), "ann_turnover", digits=5)


_SUMMARY = f"""round(sum(net), 6) as net, round(sum(gross), 6) as gross, round(sum(fee + slip + borrow), 6) as costs, round(sum(funding), 7) as funding, round({_SHARPE}, 5) as sharpe,
    round(min(drawdown), 6) as max_drawdown, count(*) as bars, cast(sum(opens) as bigint) as trades, round(avg(case when active then 1.0::double else 0 end), 6) as pct_in_market"""


def _summary(df: DataFrame) -> DataFrame:
    return rounded(rounded(rounded(df, "net", "gross", "costs", "max_drawdown", "pct_in_market"), "funding", digits=7), "sharpe", digits=5)


@_register("summarize", sql.query(f"select leg_y, leg_x, {_SUMMARY} from curves group by all", *sql.CURVES))
def _(spark, d):
    return _summary(metrics.summarize(Data(spark, d).results, S.bars_per_year))


@_register("full_summary", sql.query(f"""select a.*, round(h.hit_rate, 6) as hit_rate from (select leg_y, leg_x, {_SUMMARY}, round({_SORTINO}, 5) as ann_sortino, round({_HOLD}, 6) as avg_holding, round({_TURN}, 5) as ann_turnover from curves group by all) a
    join (select leg_y, leg_x, avg(case when pnl > 0 then 1.0::double else 0 end) as hit_rate from ({_PNLS}) group by all) h using (leg_y, leg_x)""", *sql.CURVES))
def _(spark, d):
    out = metrics.full_summary(Data(spark, d).results, S.bars_per_year)
    return rounded(rounded(_summary(out), "ann_sortino", "ann_turnover", digits=5), "avg_holding", "hit_rate")


@_register("portfolio_extras", sql.query(f"""select (select cast(sum(opens) as bigint) from eps) as trades, (select round({_HOLD}, 6) from eps) as avg_holding, (select round(avg(case when pnl > 0 then 1.0::double else 0 end), 6) from ({_PNLS})) as hit_rate,
    (select round(avg(t), 5) from (select {_TURN} as t from bt group by leg_y, leg_x)) as ann_turnover, (select round(avg(case when a then 1.0::double else 0 end), 6) from (select bool_or(active) as a from eps group by open_time)) as exposure""", *sql.EPISODES))
def _(spark, d):
    return rounded(rounded(metrics.portfolio_extras(Data(spark, d).results, S.bars_per_year), "avg_holding", "hit_rate", "exposure"), "ann_turnover", digits=5)


_G = S.grid


@_register("param_grid", sql.query(f"""select leg_y, leg_x, delta, cast(w as int) as "window", entry, exit, stop, greatest(0, n - {S.burn_in} - w) as n_tradeable from (select leg_y, leg_x, count(*) as n from pairs group by all),
    (select unnest({list(_G.deltas)}::double[]) as delta), (select unnest({list(_G.windows)}) as w), (select unnest({list(_G.entries)}::double[]) as entry), (select unnest({list(_G.exits)}::double[]) as exit), (select unnest({list(_G.stops)}::double[]) as stop)""", *sql.PRICES, sql._PAIRS))
def _(spark, d):
    """Every parameter set of every pair, with the bars that have a full z window after the burn-in."""
    pairs = Data(spark, d).pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    return pairs.crossJoin(F.broadcast(validation.param_grid(spark, S.grid))).withColumn("n_tradeable", F.greatest(F.lit(0).cast("long"), F.col("n") - S.burn_in - F.col("window"))).drop("n")


@_register("make_folds", sql.query("select * from folds", *sql.FOLDS))
def _(spark, d):
    return validation.make_folds(gaps.union_calendar(Data(spark, d).bars), S.train_bars, S.test_bars)


@_register("fold_assignment", sql.query("""select fold, symbol, case when open_time < test_start then 'train' else 'test' end as part, count(*) as n, round(sum(close), 4) as total
    from bars join folds on open_time >= train_start and open_time < test_end group by all""", *sql.FOLDS))
def _(spark, d):
    x = Data(spark, d)
    out = validation.fold_assignment(x.bars, validation.make_folds(gaps.union_calendar(x.bars), S.train_bars, S.test_bars))
    return out.groupBy("fold", "symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


def _grid_results(x: Data, names: tuple[str, ...] = ("net",)) -> DataFrame:
    return validation.run_params(x.market, S, names=names)


@_register("run_params", sql.query(f"select leg_y, leg_x, {grid_sql.PARAMS}, {', '.join(f'round(sum({p}), 6) as {p}' for p in _PARTS)}, abs(sum(net) - (sum(gross) - sum(fee) - sum(slip) + sum(funding) - sum(borrow))) < 1e-9 as reconciled from bt group by all", *grid_sql.GRID))
def _(spark, d):
    return rounded(grid.grid_totals(_grid_results(Data(spark, d), bt.PARTS), S), *_PARTS)


@_register("grid_search", sql.query(f"select {grid_sql.PARAMS}, {_r('net', 'sharpe')}, bars, trades, eligible, cast(place as int) as place from grid", *grid_sql.GRID, grid_sql.searched('bt', 'grid')))
def _(spark, d):
    return rounded(validation.grid_search(_grid_results(Data(spark, d)), S), "net", "sharpe")


@_register("grid_best", sql.query(f"select {grid_sql.PARAMS}, {_r('net', 'sharpe')}, bars, trades, eligible, cast(place as int) as place from grid_best", *grid_sql.GRID, grid_sql.searched('bt', 'grid'), grid_sql.best('grid')))
def _(spark, d):
    return rounded(validation.grid_best(validation.grid_search(_grid_results(Data(spark, d)), S)), "net", "sharpe")


_CUTOFF = "2024-01-20"
_TRAIN = f"open_time < timestamp '{_CUTOFF}'"
_CHOSEN = f"""
curve as (
    select open_time, {', '.join(f'sum({p}) / any_value(book) as {p}' for p in _PARTS)} from bt join (select delta, win, entry, exit, stop from grid_best) using (delta, win, entry, exit, stop), (select count(*) as book from (select distinct leg_y, leg_x from bt)) group by open_time
), parts as (
    select *, equity - max(equity) over w as drawdown from (
        select *, case when {_TRAIN} then 'train' else 'test' end as part, sum(net) over (partition by {_TRAIN} order by open_time rows unbounded preceding) as equity from curve)
    window w as (partition by part order by open_time rows unbounded preceding)
)"""


@_register("static_split", sql.query(f"""select part, round(sum(net), 6) as net, round(sum(gross), 6) as gross, round(sum(fee + slip + borrow), 6) as costs, round(sum(funding), 6) as funding,
    round({grid_sql.SHARPE}, 6) as sharpe, round(min(drawdown), 6) as max_drawdown, count(*) as bars from parts group by part""", *grid_sql.GRID, grid_sql.searched('bt', 'grid', _TRAIN), grid_sql.best('grid'), _CHOSEN))
def _(spark, d):
    x = Data(spark, d)
    curve = validation.static_split(x.market, S, F.lit(_CUTOFF).cast("timestamp_ntz"))
    return rounded(metrics.summarize(curve, S.bars_per_year, ("part",), weights=False), "net", "gross", "costs", "funding", "sharpe", "max_drawdown")


def _walked(spark, d):
    x = Data(spark, d)
    return validation.walkforward(x.pairs, x.market, gaps.union_calendar(x.bars), S)


@_register("walkforward", sql.query(f"""select f.*, n_pairs, {grid_sql.PARAMS}, round(g.sharpe, 6) as train_sharpe, round(test_net, 6) as test_net, round(test_sharpe, 6) as test_sharpe,
    case when n_pairs is null then 'cash_no_pairs' when delta is null then 'cash_no_config' else 'traded' end as status
    from folds f left join (select fold, count(*) as n_pairs from books group by fold) b on b.fold = f.fold left join grid_best g on g.fold = f.fold
    left join (select fold, sum(net) as test_net, {grid_sql.SHARPE} as test_sharpe from curve group by fold) c on c.fold = f.fold""", *grid_sql.WALK))
def _(spark, d):
    return rounded(_walked(spark, d)[0], "train_sharpe", "test_net", "test_sharpe")


@_register("walkforward_oos", sql.query("select fold, open_time, round(net, 6) as net from curve", *grid_sql.WALK))
def _(spark, d):
    return rounded(_walked(spark, d)[1].select("fold", "open_time", "net"), "net")


_STRESS = f"(gross - m * (fee + slip) + funding - borrow)"


@_register("cost_stress", sql.query(f"""select m as multiplier, round(sum(net), 6) as net, round({_SHARPE}, 5) as sharpe from (select m, open_time, {_STRESS} as net from port, (select unnest([0.5, 1.0, 2.0, 3.0]::double[]) as m)) group by m""", *sql.PORT))
def _(spark, d):
    x = Data(spark, d).results
    return rounded(rounded(robustness.cost_stress(x, S.cost_multipliers, S.bars_per_year, bt.book_size(x)), "net"), "sharpe", digits=5)


@_register("leave_one_out", sql.query("select leg_y, leg_x, round((t - own) / (n - 1), 6) as net from (select leg_y, leg_x, sum(net) as own from bt group by all), (select sum(net) as t, count(distinct leg_y || leg_x) as n from bt)", *sql.RESULT))
def _(spark, d):
    return rounded(robustness.leave_one_out(Data(spark, d).results), "net")


_TEST = f"open_time >= timestamp '{_CUTOFF}'"


def _cutoff():
    return F.lit(_CUTOFF).cast("timestamp_ntz")


@_register("cost_stress_test", sql.query(f"""select m as multiplier, round(sum(net), 6) as net, round({_SHARPE}, 5) as sharpe from (select m, open_time, {_STRESS} as net from port, (select unnest([0.5, 1.0, 2.0, 3.0]::double[]) as m) where {_TEST}) group by m""", *sql.PORT))
def _(spark, d):
    x = Data(spark, d).results
    return rounded(rounded(robustness.cost_stress(x, S.cost_multipliers, S.bars_per_year, bt.book_size(x), _cutoff()), "net"), "sharpe", digits=5)


@_register("leave_one_out_test", sql.query(f"""select leg_y, leg_x, round(sum(net), 6) as net, round({_SHARPE}, 5) as sharpe, count(*) as bars from (
    select p.leg_y, p.leg_x, b.open_time, sum(b.net) / (any_value(n) - 1) as net from (select distinct leg_y, leg_x from bt) p, (select count(*) as n from (select distinct leg_y, leg_x from bt)), bt b
    where {_TEST} and (b.leg_y <> p.leg_y or b.leg_x <> p.leg_x) group by p.leg_y, p.leg_x, b.open_time) group by leg_y, leg_x""", *sql.RESULT))
def _(spark, d):
    return rounded(rounded(robustness.leave_one_out_stats(Data(spark, d).results, S.bars_per_year, _cutoff()), "net"), "sharpe", digits=5)


@_register("benchmark_test", sql.query(f"""select symbol, open_time, round(coalesce(close / nullif(lag(close) over (partition by symbol order by open_time), 0) - 1, 0), 7) as net
    from (select b.open_time, s.symbol, p.close from (select distinct open_time from pairs where leg_y = 'click' and leg_x = 'error' and {_TEST}) b, (select distinct symbol from prices) s
    left join prices p on p.symbol = s.symbol and p.open_time = b.open_time)""", *sql.PRICES, sql._PAIRS))
def _(spark, d):
    x = Data(spark, d)
    on = x.pairs.where((F.col("leg_y") == "click") & (F.col("leg_x") == "error") & (F.col("open_time") >= _cutoff()))
    return rounded(bt.benchmark_frame(x.prices, on.select("open_time")), "net", digits=7).select("symbol", "open_time", "net")


@_register("driving_bars", sql.query("""select s.leg_y, s.leg_x, s.open_time, y.close as close_y, x.close as close_x, coalesce(ry.rate, 0) as rate_y, coalesce(rx.rate, 0) as rate_x
    from (select a.symbol as leg_y, b.symbol as leg_x, c.open_time from (select distinct symbol from bars) a, (select distinct symbol from bars) b, (select distinct open_time from bars) c where a.symbol < b.symbol) s
    left join bars y on y.symbol = s.leg_y and y.open_time = s.open_time left join bars x on x.symbol = s.leg_x and x.open_time = s.open_time
    left join rates ry on ry.symbol = s.leg_y and ry.open_time = s.open_time left join rates rx on rx.symbol = s.leg_x and rx.open_time = s.open_time""", *sql.FUNDING).replace("coalesce(ry.rate, 0)", "round(coalesce(ry.rate, 0), 9)").replace("coalesce(rx.rate, 0)", "round(coalesce(rx.rate, 0), 9)"))
def _(spark, d):
    x = Data(spark, d)
    every = panel.pair_candidates(x.bars).crossJoin(F.broadcast(gaps.union_calendar(x.bars)))  # a row per bar of the calendar
    return rounded(bt.on_driving_bars(every, x.bars, x.rates), "rate_y", "rate_x", digits=9)


@_register("event_counts", sql.query("select symbol, count(*) as n_events, min(funding_time) as first_event, max(funding_time) as last_event from funding group by symbol", *sql.FUNDING))
def _(spark, d):
    return gaps.event_counts(Data(spark, d).funding)


@_register("screen_counts", sql.query(f"select count(*) as tested, count(*) filter (passed) as passed, round(count(*) * {S.adf_alpha}::double, 6) as expected_by_chance from screen", *grid_sql.SCREEN))
def _(spark, d):
    return rounded(screen.screen_counts(screen.pair_screen(Data(spark, d).pairs, S), S.adf_alpha), "expected_by_chance")


@_register("fold_counts", sql.query("""select count(*) as folds, count(*) filter (held is not null and delta is not null) as traded, count(*) filter (held is null) as cash_no_pairs, count(*) filter (held is not null and delta is null) as cash_no_config
    from folds f left join (select fold, count(*) as held from books group by fold) b on b.fold = f.fold left join grid_best g on g.fold = f.fold""", *grid_sql.WALK))
def _(spark, d):
    return validation.fold_counts(_walked(spark, d)[0])


@_register("catalogue_upsert", sql.query("""select symbol, symbol as base_asset, case when symbol < 'p' then 'off' else 'on' end as status, case when symbol < 'p' then null else onboard_date end as onboard_date
    from (select symbol, min(open_time) as onboard_date from bars group by symbol) union all select distinct o_orderstatus, o_orderstatus, 'new', cast(null as timestamp) from orders""", *sql.BARS))
def _(spark, d):
    x = Data(spark, d)
    known = x.bars.groupBy("symbol").agg(F.min("open_time").alias("onboard_date")).select("symbol", F.col("symbol").alias("base_asset"), F.lit("on").alias("status"), "onboard_date")
    none = F.lit(None).cast("timestamp_ntz").alias("onboard_date")
    told = known.where("symbol < 'p'").select("symbol", F.lit("ignored").alias("base_asset"), F.lit("off").alias("status"), none)
    told = told.unionByName(x.orders.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderstatus").alias("base_asset"), F.lit("new").alias("status"), none).distinct())
    return upsert.upsert_catalogue(known, told)


_W = S.regime_window


@_register("regime_slices", sql.query(f"""select regime, round(sum(net), 6) as net, round({_SHARPE}, 5) as sharpe, count(*) as bars from (
    select net, unnest([case when trend > 0 then 'up' when trend <= 0 then 'down' end, case when vol > mid then 'high_vol' when vol <= mid then 'low_vol' end]) as regime
    from (select *, case when count(r) over v >= {_W} then stddev_samp(r) over v end as vol from (
        select p.open_time, p.net, f.close / lag(f.close, {_W}) over (order by p.open_time) - 1 as trend, f.close / lag(f.close) over (order by p.open_time) - 1 as r
        from port p left join prices f on f.open_time = p.open_time and f.symbol = 'view') window v as (order by open_time rows between {_W - 1} preceding and current row)) a,
    (select median(vol) as mid from (select case when count(r) over v >= {_W} then stddev_samp(r) over v end as vol from (
        select p.open_time, f.close / lag(f.close) over (order by p.open_time) - 1 as r from port p left join prices f on f.open_time = p.open_time and f.symbol = 'view') window v as (order by open_time rows between {_W - 1} preceding and current row)))
    ) where regime is not null group by regime""", *sql.PORT))
def _(spark, d):
    x = Data(spark, d)
    curve = bt.portfolio_curve(x.results, bt.book_size(x.results))
    out = robustness.regime_slices(curve, x.prices.where("symbol = 'view'"), _W, S.bars_per_year)
    return rounded(rounded(out, "net"), "sharpe", digits=5)


@_register("grid_robustness", sql.query(f"""select round(corr(ra, rb), 6) as spearman, round(min(b), 6) as least, round(max(b), 6) as most, round(avg(case when b > 0 then 1.0::double else 0 end), 6) as share_positive, count(*) as sets from (
    select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from (
        select round(x.sharpe, 9) as a, round(y.sharpe, 9) as b from one x join two y using (delta, win, entry, exit, stop)) where a is not null and b is not null)""",
    *grid_sql.GRID, grid_sql.searched('bt', 'one', _TRAIN), grid_sql.searched('bt', 'two', f'not {_TRAIN}')))
def _(spark, d):
    results = stored(_grid_results(Data(spark, d)), "results")
    cut = F.lit(_CUTOFF).cast("timestamp_ntz")
    halves = [validation.grid_search(results.where(c), S) for c in (F.col("open_time") < cut, F.col("open_time") >= cut)]
    return rounded(robustness.grid_robustness(*halves, validation.PARAMS), "spearman", "least", "most", "share_positive")


@_register("kalman_scan", _SQL["kalman_hedge"])
def _(spark, d):
    return rounded(scan.chunked_kalman(Data(spark, d).pairs, S.burn_in, (S.delta,), size=200), "alpha", "beta").select(*PAIR, "open_time", "alpha", "beta")


@_register("positions_scan", _SQL["positions"])
def _(spark, d):
    z = stats.rolling_zscore(Data(spark, d).spreads, S.window)
    return scan.chunked_positions(z, [(S.entry, S.exit, S.stop)], size=200).select(*PAIR, "open_time", "desired")


# Tables as the stages keep them: written as versions in the shared folder and read back.


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _read_back(df: DataFrame, tag: str, month_of: str | None = None) -> DataFrame:
    path = fresh_path(df.sparkSession, tag)
    versions.replace(df, path, month_of)
    return versions.read(df.sparkSession, path, _ddl(df), month_of=month_of)


@_register("table_pair_screen", _SQL["pair_screen"])
def _(spark, d):
    return rounded(_read_back(screen.pair_screen(Data(spark, d).pairs, S), "pair_screen"), "alpha", "beta", "eg_p", "eg_p_max", "half_life_bars", "ret_corr")


@_register("table_pair_signal", _SQL["pair_signals"])
def _(spark, d):
    return rounded(_read_back(Data(spark, d).signalled.select(*PAIR, "open_time", "beta", "z", "desired"), "pair_signal", "open_time"), "beta", "z")


@_register("table_pair_backtest", _SQL["backtest_close"])
def _(spark, d):
    rows = Data(spark, d).results.select(*PAIR, "open_time", "w_y", "w_x", "turnover", *_PARTS)
    return rounded(_read_back(rows, "pair_backtest", "open_time"), "w_y", "w_x", "turnover", *_PARTS, digits=11)


def _rewritten(spark: SparkSession, d: str) -> tuple[str, str]:
    """A table of days, of which a second version rewrites the later ones; its path and schema."""
    days = Data(spark, d).days.select("symbol", "open_time", "close", F.when(F.col("n_trades") % 3 != 0, F.round("volume", 2)).alias("volume"))
    again = days.where(F.col("open_time") >= F.lit("1998-01-01").cast("timestamp_ntz")).withColumns({"close": F.col("close") * 0.5, "batch": F.lit(2)})
    path, ddl = fresh_path(spark, "days"), _ddl(days)
    versions.replace(days, path, "open_time")
    versions.update(spark, path, ddl, lambda there: upsert.keep_last(there.withColumn("batch", F.lit(1)).unionByName(again), ["symbol", "open_time"], ["batch"]).drop("batch"), month_of="open_time")
    return path, ddl


@_register("table_upsert", _SQL["upsert_keep_last"])
def _(spark, d):
    path, ddl = _rewritten(spark, d)
    return versions.read(spark, path, ddl, month_of="open_time")


@_register("table_version", sql.query("select symbol, open_time, close, case when n_trades % 3 <> 0 then round(volume, 2) end as volume from days", *sql.DAILY))
def _(spark, d):
    path, ddl = _rewritten(spark, d)
    return versions.read(spark, path, ddl, 1, "open_time")


@_register("table_span", sql.query("select symbol, open_time, close from days where open_time >= timestamp '1995-06-15' and open_time < timestamp '1997-03-02'", *sql.DAILY))
def _(spark, d):
    path, ddl = _rewritten(spark, d)
    span = [F.lit(x).cast("timestamp_ntz") for x in ("1995-06-15", "1997-03-02")]
    return versions.read(spark, path, ddl, month_of="open_time", start=span[0], end=span[1]).select("symbol", "open_time", "close")


@_register("table_append", _SQL["upsert_keep_first"])
def _(spark, d):
    b = Data(spark, d).bars.select("symbol", "open_time", "close")
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    fresh = b.where(F.col("open_time") >= F.lit("2024-01-05").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    path, key = fresh_path(spark, "bars"), ["symbol", "open_time"]
    versions.replace(b.where(F.col("open_time") < cut), path, "open_time")
    versions.update(spark, path, _ddl(b), lambda there: fresh.join(there.select(*key), key, "left_anti").select(*b.columns), append=True, month_of="open_time")
    return versions.read(spark, path, _ddl(b), month_of="open_time")


@_register("parse_premium", "select event_type as symbol, ts - (epoch_us(ts) % 1000) * interval 1 microsecond as open_time, value as open, value + 1 as high, value - 1 as low, value as close from events")
def _(spark, d):
    e = Data(spark, d).events
    price = lambda k: F.concat(F.lit('"'), (F.col("value").cast("decimal(38,2)") + k).cast("string"), F.lit('"'))
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    raw = F.concat(F.lit("["), F.array_join(F.array(ms, price(0), price(1), price(-1), price(0), F.lit('"0"'), ms), ", "), F.lit("]"))
    return _doubles(src.parse_premium(e.select(F.col("event_type").alias("symbol"), raw.alias("raw"))))


@_register("parse_catalogue", "select event_type || '-' || event_id as symbol, event_type as base_asset, cast(null as varchar) as quote_asset, 'on' as status, ts - (epoch_us(ts) % 1000) * interval 1 microsecond as onboard_date from events")
def _(spark, d):
    e = Data(spark, d).events
    raw = F.to_json(F.struct(F.concat_ws("-", "event_type", "event_id").alias("symbol"), F.col("event_type").alias("baseAsset"), F.lit("on").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("onboardDate")))
    return src.parse_catalogue(e.select(raw.alias("raw")))


@_register("oos_frame", sql.query(f"select open_time, {', '.join('cast(null as double) as ' + p for p in _PARTS if p != 'net')}, round(net, 6) as net from curve", *grid_sql.WALK))
def _(spark, d):
    return rounded(bt.oos_frame(_walked(spark, d)[1]), "net")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
