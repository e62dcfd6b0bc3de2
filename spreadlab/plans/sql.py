"""The same queries as DuckDB SQL, put together from shared parts."""

from __future__ import annotations

from ..config import SMALL as S

_BARS = """
bars as (
    select event_type as symbol, date_trunc('hour', ts) as open_time, first(value order by ts, event_id) as open, max(value) as high,
        min(value) as low, last(value order by ts, event_id) as close, sum(value) as volume, count(*) as n_trades
    from events group by 1, 2
)"""
_DAILY = """
days as (
    select o_orderpriority as symbol, date_trunc('day', o_orderdate)::timestamp as open_time, first(o_totalprice order by o_orderdate, o_orderkey) as open, max(o_totalprice) as high,
        min(o_totalprice) as low, last(o_totalprice order by o_orderdate, o_orderkey) as close, sum(o_totalprice) as volume, count(*) as n_trades
    from orders group by 1, 2
)"""
_PRICES = """
market_index as (
    select open_time, sum(step) over (order by open_time rows unbounded preceding) as m
    from (select date_trunc('hour', ts) as open_time, (avg(value) - 50) / 1000 as step from events group by 1)
), prices as (
    select symbol, open_time, 100 * exp(m + (open - 50) / 5000) as open, 100 * exp(m + (close - 50) / 5000) as close from bars join market_index using (open_time)
)"""
_PAIRS = """
pairs as (
    select y.symbol as leg_y, x.symbol as leg_x, y.open_time, y.close as close_y, x.close as close_x, y.open as open_y, x.open as open_x
    from prices y join prices x on y.open_time = x.open_time and y.symbol < x.symbol
)"""
_RAW_PAIRS = """
raw_pairs as (
    select y.symbol as leg_y, x.symbol as leg_x, y.open_time, y.close as close_y, x.close as close_x, ln(y.close) as ly, ln(x.close) as lx
    from bars y join bars x on y.open_time = x.open_time and y.symbol < x.symbol
)"""
_FIT = """
fit as (
    select leg_y, leg_x, regr_intercept(ly, lx) as alpha, regr_slope(ly, lx) as beta, count(*) as n_bars from raw_pairs group by all
), spreads as (
    select r.*, ly - (alpha + beta * lx) as spread from raw_pairs r join fit using (leg_y, leg_x)
)"""
_Z = f"""
zs as (
    select *, case when count(spread) over w >= {S.window} then (spread - avg(spread) over w) / nullif(stddev_samp(spread) over w, 0) end as z
    from spreads window w as (partition by leg_y, leg_x order by open_time rows between {S.window - 1} preceding and current row)
)"""
_FUNDING = """
funding as (
    select event_type as symbol, ts as funding_time, (value - 50) / 1e6 as funding_rate from events
), rates as (
    select symbol, date_trunc('hour', funding_time) as open_time, sum(funding_rate) as rate from funding group by 1, 2
)"""
_TAPE = """
tape as (
    select p.*, coalesce(ry.rate, 0) as rate_y, coalesce(rx.rate, 0) as rate_x,
        case when rn % 20 between 5 and 14 then case when rn % 40 < 20 then 1 else -1 end else 0 end as desired, 1 + (rn % 7) / 10.0::double as beta
    from (select *, row_number() over (partition by leg_y, leg_x order by open_time) as rn from pairs) p
    left join rates ry on ry.symbol = p.leg_y and ry.open_time = p.open_time left join rates rx on rx.symbol = p.leg_x and rx.open_time = p.open_time
)"""


def held(source: str) -> str:
    return f"""
held0 as (
    select *, coalesce(lag(desired) over w, 0) as s, lag(beta) over w as b0 from {source} window w as (partition by leg_y, leg_x order by open_time)
), held1 as (
    select *, sum(case when s <> coalesce(ps, 0) then 1 else 0 end) over (partition by leg_y, leg_x order by open_time rows unbounded preceding) as run
    from (select *, lag(s) over (partition by leg_y, leg_x order by open_time) as ps from held0)
), held as (
    select * exclude (b), case when s = 0 then 0 else s / (1 + b) end as w_y, case when s = 0 then 0 else -s * b / (1 + b) end as w_x
    from (select *, first_value(b0) over (partition by leg_y, leg_x, run order by open_time) as b from held1)
), turned as (
    select *, abs(w_y - coalesce(lag(w_y) over w, 0)) + abs(w_x - coalesce(lag(w_x) over w, 0)) as turnover
    from held window w as (partition by leg_y, leg_x order by open_time)
)"""


def results(next_open: bool = False) -> str:
    close = "w_y * coalesce(close_y / lag(close_y) over w - 1, 0) + w_x * coalesce(close_x / lag(close_x) over w - 1, 0)"
    opened = (
        "coalesce(lag(w_y) over w, 0) * coalesce(open_y / lag(close_y) over w - 1, 0) + w_y * (close_y / open_y - 1)"
        " + coalesce(lag(w_x) over w, 0) * coalesce(open_x / lag(close_x) over w - 1, 0) + w_x * (close_x / open_x - 1)"
    )
    return f"""
bt as (
    select *, gross - fee - slip + funding - borrow as net from (
        select *, {opened if next_open else close} as gross, turnover * {S.fee_bps} / 1e4 as fee, turnover * {S.slip_bps} / 1e4 as slip,
            -(w_y * rate_y + w_x * rate_x) as funding, (greatest(-w_y, 0) + greatest(-w_x, 0)) * {S.borrow_per_bar!r} as borrow
        from turned window w as (partition by leg_y, leg_x order by open_time))
)"""


_EPISODES = """
eps as (
    select *, sum(opens) over (partition by leg_y, leg_x order by open_time rows unbounded preceding) as episode
    from (select *, case when active and not was_active then 1 else 0 end as opens
        from (select *, w_y <> 0 as active, coalesce(lag(w_y <> 0) over (partition by leg_y, leg_x order by open_time), false) as was_active from bt))
)"""
_CURVES = """
curves as (
    select *, equity - max(equity) over (partition by leg_y, leg_x order by open_time rows unbounded preceding) as drawdown
    from (select *, sum(net) over (partition by leg_y, leg_x order by open_time rows unbounded preceding) as equity from eps)
)"""
_PORT = """
port as (
    select open_time, sum(gross) / n as gross, sum(fee) / n as fee, sum(slip) / n as slip, sum(funding) / n as funding, sum(borrow) / n as borrow, sum(net) / n as net
    from bt, (select count(*) as n from (select distinct leg_y, leg_x from bt)) group by open_time, n
)"""
_CALENDAR = "calendar as (select distinct open_time from bars)"
_FOLDS = f"""
numbered as (
    select open_time, row_number() over (order by open_time) - 1 as n, lead(open_time) over (order by open_time) - open_time as gap from calendar
), folds as (
    select cast(s.n / {S.test_bars} as bigint) as fold, s.open_time as train_start, a.open_time as test_start, z.open_time + (select gap from numbered where n = 0) as test_end
    from numbered s, (select max(n) as last from numbered), numbered a, numbered z
    where s.n % {S.test_bars} = 0 and s.n + {S.train_bars} <= last and a.n = s.n + {S.train_bars} and z.n = least(s.n + {S.train_bars + S.test_bars - 1}, last)
)"""
_KALMAN = f"""
legs as (
    select *, ln(close_y) as ly, ln(close_x) as lx, row_number() over (partition by leg_y, leg_x order by open_time) as rn from pairs
), sums as (
    select leg_y, leg_x, count(*)::double as n, sum(lx) as sx, sum(lx * lx) as sxx, sum(ly) as sy, sum(lx * ly) as sxy from legs where rn <= {S.burn_in} group by all having count(*) = {S.burn_in}
), warm as (
    select leg_y, leg_x, n, sx, sxx, n * sxx - sx * sx as det, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as a from sums
), started as (
    select w.*, (select sum((l.ly - w.a - w.b * l.lx) ** 2) / ({S.burn_in} - 2) from legs l where l.leg_y = w.leg_y and l.leg_x = w.leg_x and l.rn <= {S.burn_in}) as r from warm w
), kalman(leg_y, leg_x, rn, a, b, p00, p01, p11, r) as (
    select leg_y, leg_x, {S.burn_in}::bigint, a, b, r * sxx / det, -r * sx / det, r * n / det, r from started
    union all
    select leg_y, leg_x, rn, a + h0 / s * e, b + h1 / s * e, p00 - h0 * h0 / s, p01 - h0 * h1 / s, p11 - h1 * h1 / s, r
    from (select *, h0 + lx * h1 + r as s, ly - (a + b * lx) as e from (
        select k.leg_y, k.leg_x, l.rn, k.a, k.b, k.p00 + {S.delta / (1 - S.delta)!r} as p00, k.p01, k.p11 + {S.delta / (1 - S.delta)!r} as p11, k.r, l.lx, l.ly,
            k.p00 + {S.delta / (1 - S.delta)!r} + k.p01 * l.lx as h0, k.p01 + (k.p11 + {S.delta / (1 - S.delta)!r}) * l.lx as h1
        from kalman k join legs l on l.leg_y = k.leg_y and l.leg_x = k.leg_x and l.rn = k.rn + 1))
), hedged as (
    select l.leg_y, l.leg_x, l.open_time, l.ly, l.lx, k.a as alpha, k.b as beta from kalman k join legs l using (leg_y, leg_x, rn) where rn > {S.burn_in}
), innov as (
    select * from (select *, ly - (lag(alpha) over w + lag(beta) over w * lx) as spread from hedged window w as (partition by leg_y, leg_x order by open_time)) where spread is not null
), zframe as (
    select leg_y, leg_x, open_time, beta, spread, case when count(spread) over w >= {S.window} then (spread - avg(spread) over w) / nullif(stddev_samp(spread) over w, 0) end as z
    from innov window w as (partition by leg_y, leg_x order by open_time rows between {S.window - 1} preceding and current row)
)"""


def fsm(source: str, beta: str = "beta") -> str:
    """Positions of ``source`` (z, beta) by recursion over its bars."""
    e, x, s = S.entry, S.exit, S.stop
    flat = f"(k.pos = -1 and (q.z >= {s} or q.z <= {x})) or (k.pos = 1 and (q.z <= -{s} or q.z >= -({x})))"
    pos = f"case when q.z is null then k.pos when k.pos = 0 then case when abs(q.z) >= {e} and k.armed and abs(q.z) < {s} then case when q.z > 0 then -1 else 1 end else 0 end when {flat} then 0 else k.pos end"
    armed = f"case when q.z is null then k.armed when k.pos = 0 then abs(q.z) < {e} else k.armed end"
    return f"""
zn as (
    select leg_y, leg_x, open_time, {beta} as beta, round(z, 9) as z, row_number() over (partition by leg_y, leg_x order by open_time) as rn from {source}
), steps(leg_y, leg_x, rn, pos, armed) as (
    select distinct leg_y, leg_x, 0::bigint, 0, false from zn
    union all
    select q.leg_y, q.leg_x, q.rn, {pos}, {armed} from steps k join zn q on q.leg_y = k.leg_y and q.leg_x = k.leg_x and q.rn = k.rn + 1
), positioned as (
    select zn.*, cast(steps.pos as bigint) as desired from zn join steps using (leg_y, leg_x, rn)
)"""


CANCELLED = """
opened as (
    select *, sum(case when desired <> 0 and coalesce(pd, 0) = 0 then 1 else 0 end) over (partition by leg_y, leg_x order by open_time rows unbounded preceding) as episode
    from (select *, lag(desired) over (partition by leg_y, leg_x order by open_time) as pd from {source})
), cancelled as (
    select * exclude (desired, pd, episode, fb), case when fb > 0 then desired else 0 end as desired
    from (select *, first_value(beta) over (partition by leg_y, leg_x, episode order by open_time) as fb from opened)
)"""


def query(select: str, *parts: str) -> str:
    return f"with recursive {','.join(p.strip() for p in parts)}\n{select.strip()}"


TAPE = (_BARS, _PRICES, _PAIRS, _FUNDING, _TAPE)
RESULT = (*TAPE, held("tape"), results())
RESULT_OPEN = (*TAPE, held("tape"), results(next_open=True))
EPISODES = (*RESULT, _EPISODES)
CURVES = (*EPISODES, _CURVES)
PORT = (*RESULT, _PORT)
FIT = (_BARS, _RAW_PAIRS, _FIT)
Z = (*FIT, _Z)
BARS, PRICES, DAILY, FUNDING = (_BARS,), (_BARS, _PRICES), (_DAILY,), (_BARS, _FUNDING)
FOLDS = (_BARS, _CALENDAR, _FOLDS)
KALMAN = (_BARS, _PRICES, _PAIRS, _KALMAN)
