"""DuckDB SQL of grids, unit-root tests and walk-forward, put together from parts keyed by ``unit``: a pair, or a pair in a fold or window."""

from __future__ import annotations

import re

from ..config import SMALL as S
from ..functions import adf
from . import sql

_GRID = S.grid
_SET = "delta, win, entry, exit, stop"
_BY = f"unit, {_SET}"
PARAMS = "delta, cast(win as int) as \"window\", entry, exit, stop"
SHARPE = f"avg(net) / nullif(stddev_samp(net), 0) * sqrt({float(S.bars_per_year)})"


def _numbers(values) -> str:
    return f"unnest([{', '.join(map(repr, values))}])"


MARKET = """
market as (
    select p.*, coalesce(ry.rate, 0) as rate_y, coalesce(rx.rate, 0) as rate_x from pairs p
    left join rates ry on ry.symbol = p.leg_y and ry.open_time = p.open_time left join rates rx on rx.symbol = p.leg_x and rx.open_time = p.open_time
)"""


def filtered(source: str) -> str:
    """gframe0 (unit, delta, win, open_time, beta, z) of all deltas and windows for ``source`` (unit, open_time, close_y, close_x)."""
    b = S.burn_in
    zs = " union all ".join(
        f"select unit, delta, {w} as win, open_time, beta, case when count(spread) over w >= {w} then (spread - avg(spread) over w) / nullif(stddev_samp(spread) over w, 0) end as z"
        f" from gspread window w as (partition by unit, delta order by open_time rows between {w - 1} preceding and current row)"
        for w in _GRID.windows
    )
    return f"""
glegs as (
    select unit, open_time, ln(close_y) as ly, ln(close_x) as lx, row_number() over (partition by unit order by open_time) as rn from {source}
), gsums as (
    select unit, count(*)::double as n, sum(lx) as sx, sum(lx * lx) as sxx, sum(ly) as sy, sum(lx * ly) as sxy from glegs where rn <= {b} group by unit having count(*) = {b}
), gwarm as (
    select *, n * sxx - sx * sx as det, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as a from gsums
), gstart as (
    select w.unit, any_value(a) as a, any_value(b) as b, any_value(sx) as sx, any_value(sxx) as sxx, any_value(det) as det, any_value(n) as n, sum((ly - a - b * lx) ** 2) / ({b} - 2) as r
    from gwarm w join glegs l on l.unit = w.unit and l.rn <= {b} group by w.unit
), gkalman(unit, delta, rn, a, b, p00, p01, p11, r) as (
    select unit, delta, {b}::bigint, a, b, r * sxx / det, -r * sx / det, r * n / det, r from gstart, (select {_numbers(_GRID.deltas)}::double as delta)
    union all
    select unit, delta, rn, a + h0 / s * e, b + h1 / s * e, p00 - h0 * h0 / s, p01 - h0 * h1 / s, p11 - h1 * h1 / s, r from (
        select *, h0 + lx * h1 + r as s, ly - (a + b * lx) as e from (
            select *, p00 + p01 * lx as h0, p01 + p11 * lx as h1 from (
                select k.unit, k.delta, l.rn, k.a, k.b, k.p00 + k.delta / (1 - k.delta) as p00, k.p01, k.p11 + k.delta / (1 - k.delta) as p11, k.r, l.lx, l.ly
                from gkalman k join glegs l on l.unit = k.unit and l.rn = k.rn + 1)))
), gspread as (
    select * from (select l.unit, k.delta, l.open_time, k.b as beta, ly - (lag(k.a) over w + lag(k.b) over w * lx) as spread
        from gkalman k join glegs l using (unit, rn) where rn > {b} window w as (partition by l.unit, k.delta order by rn)) where spread is not null
), gframe0 as ({zs})"""


def positions() -> str:
    """cancelled (unit, set, open_time, beta, desired) of all parameter sets."""
    flat = "(k.pos = -1 and (q.z >= k.stop or q.z <= k.exit)) or (k.pos = 1 and (q.z <= -k.stop or q.z >= -k.exit))"
    pos = f"case when q.z is null then k.pos when k.pos = 0 then case when abs(q.z) >= k.entry and k.armed and abs(q.z) < k.stop then case when q.z > 0 then -1 else 1 end else 0 end when {flat} then 0 else k.pos end"
    armed = "case when q.z is null then k.armed when k.pos = 0 then abs(q.z) < k.entry else k.armed end"
    cancelled = sql.CANCELLED.format(source="gpos").replace("leg_y, leg_x", _BY)
    return f"""
gq as (
    select * exclude (z), round(z, 9) as z, row_number() over (partition by unit, delta, win order by open_time) as rn from gframe0
), gsteps(unit, delta, win, entry, exit, stop, rn, pos, armed) as (
    select distinct unit, delta, win, e, x, s, 0::bigint, 0, false from gq, (select {_numbers(_GRID.entries)}::double as e), (select {_numbers(_GRID.exits)}::double as x), (select {_numbers(_GRID.stops)}::double as s)
    union all
    select k.unit, k.delta, k.win, k.entry, k.exit, k.stop, q.rn, {pos}, {armed} from gsteps k join gq q on q.unit = k.unit and q.delta = k.delta and q.win = k.win and q.rn = k.rn + 1
), gpos as (
    select s.unit, s.delta, s.win, entry, exit, stop, q.open_time, q.beta, cast(s.pos as bigint) as desired from gsteps s join gq q using (unit, delta, win, rn)
), {cancelled.strip()}"""


def traded(source: str, market: str, prefix: str = "") -> str:
    """Results ``bt`` of ``source`` (unit, leg_y, leg_x, set, open_time, beta, desired) on a market; ``prefix`` renames the parts."""
    frame = f"""
gframe as (
    select g.*, m.* exclude (leg_y, leg_x, open_time) from {source} g join {market} m on m.leg_y = g.leg_y and m.leg_x = g.leg_x and m.open_time = g.open_time
)"""
    text = ",".join(x.strip() for x in (frame, sql.held("gframe"), sql.results())).replace("leg_y, leg_x order", f"{_BY} order").replace("leg_y, leg_x, run", f"{_BY}, run")
    return re.sub(r"\b(gframe|held0|held1|held|turned|bt)\b", rf"{prefix}\1", text) if prefix else text


def searched(results: str, name: str, where: str = "true", group: str = "") -> str:
    """The grid ``name`` (group, set, net, sharpe, bars, trades, eligible, place) of the rows of results that ``where`` keeps."""
    g, on = (f"{group}, ", f"using ({group})") if group else ("", "on true")
    part = f"partition by {group} " if group else ""
    return f"""
{name}_rows as (
    select * from {results} where {where}
), {name}_size as (
    select {g}count(*) as n from (select distinct {g}leg_y, leg_x from {name}_rows) {f'group by {group}' if group else ''}
), {name}_port as (
    select {g}{_SET}, open_time, sum(net) / any_value(n) as net, any_value(n) as n from {name}_rows join {name}_size {on} group by {g}{_SET}, open_time
), {name}_trades as (
    select {g}{_SET}, cast(sum(case when w_y <> 0 and not was then 1 else 0 end) as bigint) as trades
    from (select *, coalesce(lag(w_y <> 0) over (partition by {_BY} order by open_time), false) as was from {name}_rows) group by {g}{_SET}
), {name} as (
    select *, trades >= {S.trades_per_year!r} * bars / {S.bars_per_year} * n as eligible, row_number() over ({part}order by round(sharpe, 9) desc nulls last, {_SET}) as place
    from (select {g}{_SET}, sum(net) as net, {SHARPE} as sharpe, count(*) as bars, any_value(n) as n from {name}_port group by {g}{_SET}) join {name}_trades using ({g}{_SET})
)"""


def best(name: str, group: str = "") -> str:
    part = f"partition by {group} " if group else ""
    return f"""
{name}_best as (
    select * from (select *, row_number() over ({part}order by place) as r from {name} where eligible and sharpe is not null) where r = 1
)"""


def unit_roots(source: str, least: int, name: str = "eg") -> str:
    """``name`` (unit, n_bars, p_forward, p_reverse) of source (unit, open_time, ly, lx): regressions by sums, lags by
    sweeping one Gram matrix, which gives the squared rest of each nested model, and the normal distribution by its series or continued fraction."""
    sweep = "list_transform(m, lambda row, i: list_transform(row, lambda v, j: case when i = k + 1 and j = k + 1 then -1 / m[k + 1][k + 1] when i = k + 1 or j = k + 1 then v / m[k + 1][k + 1] else v - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] end))"

    def gram(lags: str, drop: str) -> str:
        columns = f"list_concat(list_concat([u[{drop} + 1 : n - 1]], list_transform(range(1, {lags} + 1), lambda k: d[{drop} - k + 1 : n - 1 - k])), [d[{drop} + 1 : n - 1]])"
        return f"list_transform({columns}, lambda a: list_transform({columns}, lambda b: list_inner_product(a, b)))"

    poly = lambda cs: " + ".join(f"({c!r}) * tau ** {i}" for i, c in enumerate(cs))
    near = "0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * sign(x) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(x), 1e-12)) - ((k + 1) * ln(2.0) + lgamma(k + 1.5) - 0.5 * ln(pi())))))"
    far = "exp(-x * x / 2) / sqrt(2 * pi()) / list_reduce(list_prepend(-x, list_transform(range(80, 0, -1), lambda k: k::double)), lambda f, k: -x + k / f)"
    return f"""
{name}_legs as (
    select unit, 0 as turned, open_time, ly as y, lx as x from {source} union all select unit, 1, open_time, lx, ly from {source}
), {name}_fit as (
    select unit, turned, avg(y) as my, avg(x) as mx, coalesce(regr_slope(y, x), 0) as b from {name}_legs group by all having count(*) >= {least}
), {name}_rest as (
    select unit, turned, list(y - my - b * (x - mx) order by open_time) as u, cast(count(*) as int) as n, sum((y - my - b * (x - mx)) ** 2) <= 1e-20 * greatest(sum((y - my) ** 2), 1e-300) as straight
    from {name}_legs join {name}_fit using (unit, turned) group by all
), {name}_diffs as (
    select *, list_transform(range(1, n), lambda i: u[i + 1] - u[i]) as d, least(cast(ceil(12 * (n / 100.0) ** 0.25) as int), greatest(0, n // 2 - 2)) as most from {name}_rest
), {name}_sweeps(unit, turned, most, n, k, m) as (
    select unit, turned, most, n, 0, {gram('most', 'most')} from {name}_diffs
    union all
    select unit, turned, most, n, k + 1, {sweep} from {name}_sweeps where k <= most
), {name}_lags as (
    select unit, turned, (list(k - 1 order by aic, k))[1] as lags
    from (select unit, turned, k, (n - 1 - most) * ln(greatest(m[most + 2][most + 2], 1e-300) / (n - 1 - most)) + 2 * k as aic from {name}_sweeps where k > 0) group by unit, turned
), {name}_again(unit, turned, lags, n, k, m) as (
    select unit, turned, lags, n, 0, {gram('lags', 'lags')} from {name}_diffs join {name}_lags using (unit, turned)
    union all
    select unit, turned, lags, n, k + 1, {sweep} from {name}_again where k <= lags
), {name}_tau as (
    select unit, turned, m[1][lags + 2] / sqrt(m[lags + 2][lags + 2] / greatest(1, n - 1 - lags - (lags + 1)) * -m[1][1]) as tau from {name}_again where k = lags + 1
), {name}_p as (
    select unit, turned, case when straight or tau < {adf._TAU_MIN} then 0 when tau > {adf._TAU_MAX} then 1 when x > -3 then {near} else {far} end as p
    from (select *, case when tau <= {adf._TAU_STAR} then {poly(adf._SMALL_P)} else {poly(adf._LARGE_P)} end as x from {name}_tau) join {name}_rest using (unit, turned)
), {name} as (
    select unit, any_value(n) as n_bars, max(p) filter (turned = 0) as p_forward, max(p) filter (turned = 1) as p_reverse from {name}_p join {name}_rest using (unit, turned) group by unit
)"""


def screened(source: str, within: str = "") -> str:
    """``screen`` of source (unit, within, leg_y, leg_x, open_time, close_y, close_x), after :func:`unit_roots` of it."""
    g = f"{within}, " if within else ""
    lo, hi = S.half_life
    part = f"partition by {within} " if within else ""
    return f"""
sides as (
    select unit, {g}case when p_reverse < p_forward then leg_x else leg_y end as leg_y, case when p_reverse < p_forward then leg_y else leg_x end as leg_x, open_time,
        ln(case when p_reverse < p_forward then close_x else close_y end) as ly, ln(case when p_reverse < p_forward then close_y else close_x end) as lx,
        n_bars, least(p_forward, p_reverse) as eg_p, greatest(p_forward, p_reverse) as eg_p_max
    from {source} join eg using (unit)
), fitted as (
    select unit, regr_intercept(ly, lx) as alpha, regr_slope(ly, lx) as beta from sides group by unit
), moved as (
    select *, spread - ls as ds from (select s.*, alpha, beta, ly - alpha - beta * lx as spread, lag(ly - alpha - beta * lx) over w as ls, ly - lag(ly) over w as dy, lx - lag(lx) over w as dx
        from sides s join fitted using (unit) window w as (partition by s.unit order by open_time))
), measured as (
    select unit, {g}leg_y, leg_x, any_value(n_bars) as n_bars, any_value(eg_p) as eg_p, any_value(eg_p_max) as eg_p_max, any_value(alpha) as alpha, any_value(beta) as beta, 1 + regr_slope(ds, ls) as phi, corr(dy, dx) as ret_corr
    from moved group by unit, {g}leg_y, leg_x
), screen as (
    select *, row_number() over ({part}order by passed desc, eg_p_max, leg_y, leg_x) as place from (
        select *, coalesce(eg_p_max < {S.adf_alpha} and half_life_bars between {lo} and {hi}, false) as passed
        from (select *, case when phi > 0 and phi < 1 then -ln(2) / ln(phi) end as half_life_bars from measured))
)"""


_UNITS = "plain as (select leg_y || '~' || leg_x as unit, * from pairs), logs as (select unit, open_time, ln(close_y) as ly, ln(close_x) as lx from plain)"
BASE = (sql._BARS, sql._PRICES, sql._PAIRS)
EG = (*BASE, _UNITS, unit_roots("logs", S.min_overlap))
SCREEN = (*EG, screened("plain"))
_WINDOWS = f"""
placed as (
    select *, row_number() over (partition by leg_y, leg_x order by open_time) - 1 as i, count(*) over (partition by leg_y, leg_x) as total from pairs
), windowed as (
    select leg_y || '~' || leg_x || '~' || part as unit, leg_y, leg_x, part, open_time, ln(close_y) as ly, ln(close_x) as lx
    from (select *, unnest(range(0, (total - {S.eg_window}) // {S.eg_step} + 1)) as part from placed where total >= {S.eg_window}) where i >= part * {S.eg_step} and i < part * {S.eg_step} + {S.eg_window}
)"""
_ENDS = "rolled as (select leg_y, leg_x, max(open_time) as window_end, any_value(greatest(p_forward, p_reverse)) as eg_p_max from windowed join eg using (unit) group by unit, leg_y, leg_x)"
ROLLING = (*BASE, _WINDOWS, unit_roots("windowed", S.eg_window), _ENDS)
_TRAINED = "trained as (select fold || '~' || leg_y || '~' || leg_x as unit, fold, p.* from pairs p join folds on open_time >= train_start and open_time < test_start), logs as (select unit, open_time, ln(close_y) as ly, ln(close_x) as lx from trained)"
BOOKS = (*BASE, sql._CALENDAR, sql._FOLDS, _TRAINED, unit_roots("logs", S.min_overlap), screened("trained", "fold"), f"books as (select fold, leg_y, leg_x, place, eg_p_max from screen where passed and place <= {S.max_pairs})")
_PLAIN = "plain as (select leg_y || '~' || leg_x as unit, * from pairs)"
_LEGS = "told as (select c.*, u.leg_y, u.leg_x from cancelled c join (select distinct unit, leg_y, leg_x from plain) u using (unit))"
GRID = (*BASE, sql._FUNDING, MARKET, _PLAIN, filtered("plain"), positions(), _LEGS, traded("told", "market"))
_BOTH = """
both_ways as (
    select leg_y, leg_x, open_time, close_y, close_x, rate_y, rate_x from market union all select leg_x, leg_y, open_time, close_x, close_y, rate_x, rate_y from market
), spans as (
    select f.fold || '~' || b.leg_y || '~' || b.leg_x as unit, f.fold, test_start, test_end, m.* from both_ways m join books b on b.leg_y = m.leg_y and b.leg_x = m.leg_x
    join folds f on f.fold = b.fold and m.open_time >= f.train_start and m.open_time < f.test_end
)"""
_TOLD = "told as (select c.*, u.leg_y, u.leg_x, u.fold, u.test_start, u.test_end from cancelled c join (select distinct unit, leg_y, leg_x, fold, test_start, test_end from spans) u using (unit)), trains as (select * from told where open_time < test_start)"
_FRESH = f"""
fresh as (
    select * exclude (desired), cast(case when open_time >= test_start and open_time < test_end and back > 2 then desired else 0 end as bigint) as desired from (
        select told.*, row_number() over (partition by told.unit, told.open_time < test_end order by told.open_time desc) as back from told join grid_best b using (fold, {_SET}))
)"""
_CURVE = """
curve as (
    select fold, open_time, sum(net) / any_value(n) as net from two_bt join (select fold, count(*) as n from books group by fold) using (fold) where open_time >= test_start group by fold, open_time
)"""
WALK = (*BOOKS, sql._FUNDING, MARKET, _BOTH, filtered("spans"), positions(), _TOLD, traded("trains", "both_ways"), searched("bt", "grid", group="fold"), best("grid", "fold"), _FRESH, traded("fresh", "both_ways", "two_"), _CURVE)
