"""DuckDB SQL of core queries that need more than a line: common table expressions by name, and whole queries.

Written from the operators' definitions, not from their Spark form: regressions by successive orthogonalisation,
as-of lookups by ASOF joins, recursions by recursive expressions.
"""

from __future__ import annotations

NAMES3 = ("mkt_rf", "smb", "hml")
NAMES5 = (*NAMES3, "rmw", "cma")
YEAR = "252.0::double"

PANEL = """panel as (
  select l_returnflag || l_linestatus as ticker, cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close
  from lineitem group by 1, 2)"""
MARKET = """market as (
  select cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem group by 1)"""
COMPLETE = """complete as (
  select * from panel where session in (
    select session from panel group by 1 having count(distinct ticker) = (select count(distinct ticker) from panel)))"""
RETS = """rets as (
  select * from (select ticker, session, close / lag(close) over (partition by ticker order by session) - 1 as ret from complete) where ret is not null)"""
LOGR = """logr as (
  select * from (select ticker, session, ln(close / lag(close) over (partition by ticker order by session)) as ret from panel) where ret is not null)"""
FX = """fx as (
  select session, v / first_value(v) over (order by session) as fx
  from (select cast(date_trunc('week', o_orderdate) as date) as session, avg(o_totalprice) as v from orders group by 1))"""
FACTORS = """cut as (select quantile_cont(p_size, 0.5) as ms, quantile_cont(p_retailprice, 0.5) as mv from part),
kinds as (select p_partkey, p_size <= ms as small, p_retailprice <= mv as cheap from part, cut),
wk as (
  select cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as m,
    avg(l_extendedprice) filter (small) as s, avg(l_extendedprice) filter (not small) as b,
    avg(l_extendedprice) filter (cheap) as v, avg(l_extendedprice) filter (not cheap) as g
  from lineitem join kinds on l_partkey = p_partkey group by 1),
steps as (
  select session, m / lag(m) over o - 1 as m, s / lag(s) over o - 1 as s, b / lag(b) over o - 1 as b, v / lag(v) over o - 1 as v, g / lag(g) over o - 1 as g
  from wk window o as (order by session)),
factors as (
  select * from (select session, m - 0.0004::double as mkt_rf, s - b as smb, v - g as hml, 0.0004::double as rf from steps)
  where mkt_rf is not null and smb is not null and hml is not null)"""
FACTORS5 = """factors5 as (
  select *, sin(date_diff('day', date '1992-01-06', session) / 7.0::double) / 100 as rmw,
    cos(date_diff('day', date '1992-01-06', session) / 3.0::double) / 100 as cma
  from factors)"""


def sample(prices: str, factors: str) -> str:
    """sample: returns over neighbouring sessions of the union of both calendars, before each ticker's last one."""
    return f"""days as (select session, lag(session) over (order by session) as prev from (select session from {prices} union select session from {factors})),
own as (
  select ticker, session, close / lag(close) over o - 1 as ret, lag(session) over o as own_prev, max(session) over (partition by ticker) as last
  from {prices} window o as (partition by ticker order by session)),
sample as (
  select own.ticker, f.*, own.ret, own.ret - f.rf as y from own join days using (session) join {factors} f using (session)
  where own_prev = prev and session < last)"""


def fits(names: tuple[str, ...], least: int = 80) -> str:
    """fits: regressions of y on names, each factor made orthogonal to the ones before it."""
    k, steps, source = len(names), [], "sample"
    for i, n in enumerate(names):
        slopes = ", ".join(f"covar_pop({n}, e{j}) over t / var_pop(e{j}) over t as g{i}_{j}" for j in range(i))
        rest = "".join(f" - g{i}_{j} * e{j}" for j in range(i))
        first = f"select *{', ' + slopes if slopes else ''}, avg({n}) over t as m{i} from {source} window t as (partition by ticker)"
        steps.append(f"o{i} as (select *, {n} - m{i}{rest} as e{i} from ({first}))")
        source = f"o{i}"
    sums = ", ".join(f"covar_pop(y, e{i}) / var_pop(e{i}) as p{i}, covar_pop(y, e{i}) * covar_pop(y, e{i}) / var_pop(e{i}) as q{i}, any_value(m{i}) as m{i}" for i in range(k))
    gs = ", ".join(f"any_value(g{i}_{j}) as g{i}_{j}" for i in range(k) for j in range(i))
    steps.append(f"sums as (select ticker, count(*) as n, avg(y) as my, avg(ret) as mret, avg(rf) as mrf, var_pop(y) as yy, {sums}{', ' + gs if gs else ''} from {source} group by 1)")
    inner = "sums"
    for i in reversed(range(k)):
        back = "".join(f" - g{j}_{i} * b{j}" for j in range(i + 1, k))
        inner = f"(select *, p{i}{back} as b{i} from {inner})"
    explained = " + ".join(f"q{i}" for i in range(k))
    mean = " + ".join(f"b{i} * m{i}" for i in range(k))
    betas = ", ".join(f"b{i} as beta_{n}" for i, n in enumerate(names))
    steps.append(f"""fits as (
  select ticker, (my - ({mean})) * {YEAR} as alpha, {betas}, ({explained}) / yy as r2, n, (mrf + {mean}) * {YEAR} as expected, mret * {YEAR} as historical,
    greatest(yy - ({explained}), 0) * n / (n - {k + 1}) as resid_var
  from {inner} where n >= {least})""")
    return ",\n".join(steps)


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def _fit_query(names: tuple[str, ...], head: str) -> str:
    cols = rounded("alpha", *(f"beta_{n}" for n in names), "r2", "expected", "historical", "resid_var")
    few = ", ".join(f"null::double as {c}" for c in ("alpha", *(f"beta_{n}" for n in names), "r2", "expected", "historical", "resid_var"))
    return f"{head}\nselect ticker, n, {cols}, 'ok' as status from fits\nunion all by name select ticker, count(*) as n, {few}, 'too few rows' as status from sample group by 1 having count(*) < 80"


THREE = f"with {PANEL},\n{FACTORS},\n{sample('panel', 'factors')},\n{fits(NAMES3)}"
FIVE = f"with {PANEL},\n{FACTORS},\n{FACTORS5},\n{sample('panel', 'factors5')},\n{fits(NAMES5)}"
USD = """usd as (
  select * exclude (c) from (select ticker, session, close * fx as close, count(*) over (partition by ticker) as c from (select p.ticker, p.session, p.close, x.fx from panel p asof join fx x on p.session >= x.session)) where c >= 81)"""

F11 = f"""{THREE},
long as (unpivot (select ticker, beta_mkt_rf as mkt_rf, beta_smb as smb, beta_hml as hml from fits) on mkt_rf, smb, hml into name f value b),
rows as (unpivot (select session, mkt_rf, smb, hml from factors) on mkt_rf, smb, hml into name f value x),
cov as (select a.f as fa, b.f as fb, covar_samp(a.x, b.x) as v from rows a join rows b using (session) group by 1, 2),
common as (select i.ticker as ti, j.ticker as tj, sum(i.b * v * j.b) as v from long i join cov on i.f = fa join long j on j.f = fb group by 1, 2)
select ti as ticker_i, tj as ticker_j, round((v + case when ti = tj then resid_var else 0 end) * {YEAR}, 6) as value from common join fits on ticker = ti"""

F12 = f"""with {MARKET},
{FX},
{FACTORS},
known as (
  select f.session, f.mkt_rf, f.smb, f.hml, f.rf, x.fx, case when f.session - r.session <= 7 then 2.0::double end as rate
  from factors f asof left join fx x on f.session >= x.session asof left join market r on f.session > r.session),
turned as (select *, lag(fx) over (order by session) / fx as q, rate / 100 * (session - lag(session) over (order by session)) / 360 as eur from known)
select session, round((1 + mkt_rf + rf) * q - 1 - eur, 6) as mkt_rf, round(smb * q, 6) as smb, round(hml * q, 6) as hml, round(eur, 6) as rf
from turned where (1 + mkt_rf + rf) * q - 1 - eur is not null"""

F15 = f"""with {PANEL},
{FX},
{USD},
{FACTORS},
{sample('usd', 'factors')},
{fits(NAMES3)},
change as (select avg(r) as m from (select fx / lag(fx) over (order by session) - 1 as r from fx))
select ticker, round(((1 + expected / {YEAR}) / (1 + m) - 1) * {YEAR}, 6) as mu from fits, change"""

CURVE = f"""{PANEL},
{COMPLETE},
curve as (
  select session, avg(close / c0) * 10000 as nav
  from (select *, first_value(close) over (partition by ticker order by session) as c0 from complete) group by 1)"""

F17 = f"""with {CURVE},
{FACTORS},
num as (select session, row_number() over (order by session) - 1 as no from (select distinct session from panel)),
rows as (
  select session, nav, lag(nav) over (order by session) as before,
    coalesce(count(*) filter (no % 20 = 0) over (order by session rows between unbounded preceding and 1 preceding), 0) > 0 as loaded, f.mkt_rf, f.smb, f.hml, f.rf
  from curve join num using (session) left join factors f using (session)),
days as (select *, (nav - coalesce(before, 10000)) / 10000 as day, before / 10000 as scale, before is not null and loaded and rf is not null as known from rows),
parts as (
  select session, case when known then mkt_rf * scale else 0 end as mkt_rf, case when known then 0.2 * smb * scale else 0 end as smb,
    case when known then -0.1 * hml * scale else 0 end as hml, case when known then rf * scale else 0 end as rf,
    case when before is null then day when known then day - (mkt_rf + 0.2 * smb - 0.1 * hml + rf) * scale else 0 end as unexplained,
    case when before is null or known then 0 else day end as unattributed
  from days),
long as (unpivot parts on mkt_rf, smb, hml, rf, unexplained, unattributed into name component value contribution)
select 'Equal Weight' as strategy, session, component, round(contribution, 6) as contribution,
  round(sum(contribution) over (partition by component order by session), 6) as cumulative
from long"""

B28_CALENDAR = f"""with {PANEL},
anchors as (select cast(a as date) as anchor, cast(a - interval 12 month as date) as est_start, cast(a + interval 12 month as date) as oos_end
  from unnest(generate_series(timestamp '1993-01-04', timestamp '1998-01-04', interval 6 month)) t(a)),
days as (select distinct session from panel),
seen as (
  select anchor, est_start, oos_end, min(session) filter (session < anchor) as first, count(*) filter (session < anchor) as est_rows,
    count(*) filter (session >= anchor and session < oos_end) as oos_rows, max(session) as last
  from anchors left join days on session >= est_start group by 1, 2, 3)
select anchor, est_start, oos_end, est_rows, oos_rows,
  case when first is null or first - est_start > 14 then 'history starts late' when est_rows < 180 then 'too few estimation rows'
    when oos_rows < 180 then 'too few out-of-sample rows' when last < oos_end then 'no row after the horizon' else 'ok' end as status
from seen"""

EWMA = f"""{PANEL},
{LOGR},
k as (select *, row_number() over (partition by ticker order by session) - 1 as k from logr),
v0 as (select ticker, var_samp(ret) as v from k where k < 21 group by 1),
ewma as (
  select k.ticker, session, ret, k, v as variance from k join v0 using (ticker) where k = 0
  union all
  select k.ticker, k.session, k.ret, k.k, 0.94::double * e.variance + 0.06::double * e.ret * e.ret from ewma e join k on k.ticker = e.ticker and k.k = e.k + 1)"""

V3 = f"""with recursive {EWMA},
roll as (
  select ticker, session, stddev_samp(ret) over w * sqrt({YEAR}) as vol from logr
  window w as (partition by ticker order by session rows between 62 preceding and current row) qualify count(ret) over w = 63),
last as (select ticker, arg_max(vol, session) as last from roll group by 1),
pct as (select ticker, 100.0 * count(*) filter (round(vol, 12) <= round(last, 12)) / count(*) as percentile, any_value(last) * 100 as rolling_pct from roll join last using (ticker) group by 1),
e as (select ticker, sqrt(arg_max(variance, session) * {YEAR}) * 100 as ewma_pct, sqrt(arg_max(variance * 0.94 + ret * ret * 0.06, session) * {YEAR}) * 100 as ewma_forecast_pct from ewma group by 1)
select ticker, {rounded('percentile', 'rolling_pct', 'ewma_pct', 'ewma_forecast_pct')},
  case when percentile >= 75 then 'High' when percentile <= 25 then 'Low' else 'Normal' end as regime
from pct join e using (ticker)"""

OVERLAY = f"""with recursive {PANEL},
{LOGR},
vols as (
  select ticker, session, case when count(ret) over w = 21 then stddev_samp(ret) over w * sqrt(52.0::double) * 100 end as vol from logr
  window w as (partition by ticker order by session rows between 20 preceding and current row)),
rows as (
  select p.ticker, session, close, vol, row_number() over (partition by p.ticker order by session) - 1 as j, count(*) over (partition by p.ticker) as n
  from panel p left join vols using (ticker, session)),
decided as (select *, j % 5 = 0 and j < n - 1 as due, case when vol > 0 then least(1.0::double, 15.0::double / vol) end as want from rows),
overlay as (
  select ticker, session, j, close, 10000.0::double as value, 1.0::double as e, 0.0::double as cost, 'FORECAST ERROR' as action, null::double as want, null::double as gap
  from decided where j = 0
  union all
  select ticker, session, j, close, value - cost as value, case when trade then w else e end as e, cost,
    case when not due then '' when w is null then 'FORECAST ERROR' when trade then 'REBALANCE' when gap >= 5 then 'REVIEW' else 'HOLD' end as action,
    case when due then w * 100 end as want, case when due then gap end as gap
  from (
    select *, case when trade then least(value * 0.99::double, greatest(0.0005::double * size, 60.0::double) + size * 0.001::double) else 0.0::double end as cost
    from (
      select *, coalesce(due and gap >= 10, false) as trade, abs(w - e) * value as size
      from (
        select d.ticker, d.session, d.j, d.close, o.value * (1 + o.e * (d.close / o.close - 1)) as value, o.e, d.due, d.want as w, abs(d.want - o.e) * 100 as gap
        from overlay o join decided d on d.ticker = o.ticker and d.j = o.j + 1))))"""

V10 = f"""{OVERLAY}
select ticker as strategy, session, round(e, 6) as exposure, round(value, 6) as nav, round(cost, 6) as cost, action, round(want, 6) as target_pct, round(gap, 6) as gap_pp from overlay"""

V11 = f"""{OVERLAY},
steps as (
  select ticker, session, value, cost, action, value / lag(value) over o - 1 as ret, value / greatest(max(value) over o, 10000) - 1 as dd
  from overlay window o as (partition by ticker order by session)),
figures as (
  select ticker, pow(arg_max(value, session) / 10000, {YEAR} / count(*)) - 1 as cagr, stddev_samp(ret) * sqrt({YEAR}) as volatility, min(dd) as max_drawdown,
    arg_max(value, session) / 10000 - 1 as total_return from steps group by 1),
all_of as (select *, cagr / volatility as sharpe from figures)
select a.ticker as strategy, {', '.join(f'round(a.{c} - b.{c}, 6) as {c}_delta' for c in ('cagr', 'volatility', 'sharpe', 'max_drawdown', 'total_return'))}
from all_of a, all_of b where a.ticker <> 'NO' and b.ticker = 'NO'"""

T1_RSI = f"""with recursive {PANEL},
k as (select *, row_number() over (partition by ticker order by session) - 1 as k, close - lag(close) over (partition by ticker order by session) as d from panel),
e as (
  select ticker, session, k, greatest(d, 0) as up, greatest(-d, 0) as down from k where k = 1
  union all
  select k.ticker, k.session, k.k, e.up + (greatest(k.d, 0) - e.up) / 14, e.down + (greatest(-k.d, 0) - e.down) / 14 from e join k on k.ticker = e.ticker and k.k = e.k + 1)
select ticker, session, round(case when k < 14 then null when up + down = 0 then 50 else 100 * up / (up + down) end, 6) as rsi14 from k left join e using (ticker, session, k)"""

INDICATORS = f"""with {PANEL},
ind as (
  select ticker, session, close,
    case when count(*) over w50 = 50 then avg(close) over w50 end as sma50, case when count(*) over w200 = 200 then avg(close) over w200 end as sma200,
    close / lag(close, 63) over w - 1 as m63, close / lag(close, 126) over w - 1 as m126,
    case when count(*) over w20 = 20 then (close - avg(close) over w20) / stddev_pop(close) over w20 end as z,
    close / max(close) over w - 1 as dd
  from panel window w as (partition by ticker order by session), w20 as (partition by ticker order by session rows 19 preceding),
    w50 as (partition by ticker order by session rows 49 preceding), w200 as (partition by ticker order by session rows 199 preceding))"""

T2 = f"""{INDICATORS},
below as (select *, coalesce(close < sma200, false) as below from ind),
persists as (select *, count(*) filter (below) over f = 5 as persists from below window f as (partition by ticker order by session rows 4 preceding))
select ticker, session, case when sma200 is null or m63 is null then 'INSUFFICIENT DATA'
  when below and m63 < 0 and persists and dd <= -0.25 then 'EXIT CANDIDATE' when below and m63 < 0 and persists and dd <= -0.15 then 'REDUCE CANDIDATE'
  when below or abs(z) >= 2 then 'WATCH' else 'MAINTAIN' end as signal
from persists"""

T3 = f"""{INDICATORS},
gaps as (select *, sma50 - sma200 as s, lag(sma50 - sma200) over (partition by ticker order by session) as s0, sma50 is null or sma200 is null or m63 is null as unknown,
  close > sma50 and sma50 > sma200 and m63 > 0 as up, close < sma50 and sma50 < sma200 and m63 < 0 as down from ind)
select ticker, session,
  case when unknown then 'Insufficient Data' when up then 'Favorable Trend Conditions' when down then 'Unfavorable Trend Conditions' else 'Mixed Signals' end as entry,
  case when unknown then 'Insufficient Data' when down then case when m126 < 0 then 'Evaluate Exit' else 'Evaluate Reduction' end else 'Hold' end as exit,
  case when s0 <= 0 and s > 0 then 'Crossed above' when s0 >= 0 and s < 0 then 'Crossed below' when s > 0 then 'Above' when s < 0 then 'Below' when s = 0 then 'At level' end as cross
from gaps"""

# Coefficients of the rational Chebyshev fit of the complementary error function, highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def tail(x: str) -> str:
    """Upper tail of the chi-squared law with one degree of freedom."""
    z, poly = f"sqrt(greatest({x}, 0) / 2)", ""
    t = f"(1 / (1 + 0.5::double * {z}))"
    for c in ERFC:
        poly = f"({c}::double + {t} * {poly})" if poly else f"{c}::double"
    return f"least({t} * exp(-{z} * {z} + {poly}), 1.0::double)"


T8 = f"""with {PANEL},
{COMPLETE},
{RETS},
h as (select ticker, session, (ret < -0.2)::int as hit, lag((ret < -0.2)::int) over (partition by ticker order by session) as prev from rets),
g as (
  select ticker, count(*)::double as n, sum(hit)::double as x, count(*) filter (prev = 0 and hit = 0)::double as n00, count(*) filter (prev = 0 and hit = 1)::double as n01,
    count(*) filter (prev = 1 and hit = 0)::double as n10, count(*) filter (prev = 1 and hit = 1)::double as n11 from h group by 1),
p as (select *, n01 / nullif(n00 + n01, 0) as p01, n11 / nullif(n10 + n11, 0) as p11, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) as p from g),
lr as (
  select *, -2 * ((n - x) * ln(0.9::double) + x * ln(0.1::double) - case when x < n then (n - x) * ln(1 - x / n) else 0 end - case when x > 0 then x * ln(x / n) else 0 end) as uc,
    -2 * (case when n00 + n10 > 0 and p < 1 then (n00 + n10) * ln(1 - p) else 0 end + case when n01 + n11 > 0 then (n01 + n11) * ln(p) else 0 end
      - case when n00 > 0 then n00 * ln(1 - p01) else 0 end - case when n01 > 0 then n01 * ln(p01) else 0 end
      - case when n10 > 0 then n10 * ln(1 - p11) else 0 end - case when n11 > 0 then n11 * ln(p11) else 0 end) as ind,
    n * 0.1 >= 5 and x > 0 and x < n and n00 + n01 > 0 and n10 + n11 > 0 as ok
  from p)
select ticker as name, n::bigint as n, x::bigint as hits, round(case when ok then {tail('uc')} end, 6) as kupiec_p, round(case when ok then {tail('ind')} end, 6) as christoffersen_p from lr"""

S19 = """with d as (select distinct cast(date_trunc('month', o_orderdate) as date) as decision_date from orders),
f as (
  select o_custkey as entity, cast(o_orderdate as date) as filed, cast(date_trunc('month', o_orderdate) - interval 1 day as date) as "end", o_totalprice as val, o_orderkey as accn
  from orders)
select entity, decision_date, round(val, 6) as val, filed, "end", accn
from d join f on filed < decision_date and "end" <= decision_date
qualify row_number() over (partition by entity, decision_date order by "end" desc, filed desc, accn desc) = 1"""

NUM = "num as (select session, (row_number() over (order by session) - 1)::int as no from (select distinct session from complete))"


def plan(lookback: int, rebalance: int) -> str:
    return f"""nn as (select count(*)::int as n from num),
plan as (select t::int as t, least(t + {rebalance}, n - 1)::int as until from nn, range({lookback}, 100000, {rebalance}) r(t) where t <= n - 2)"""


def held(lookback: int, rebalance: int, buy_and_hold: bool = False) -> str:
    """nav: an equally weighted walk-forward over complete prices; drift: its holdings' growth at the end of each period."""
    periods = "(select min(t) as t, (select n - 1 from nn) as until from plan)" if buy_and_hold else "plan"
    return f"""{PANEL},
{COMPLETE},
{NUM},
{plan(lookback, rebalance)},
hold as (
  select t, until, c.ticker, no, session, close / first_value(close) over (partition by t, c.ticker order by no) as growth
  from complete c join num using (session) join {periods} on no between t and until),
g as (select t, until, no, session, avg(growth) as g from hold where no > t group by 1, 2, 3, 4),
base as (select t, coalesce(product(g) over (order by t rows between unbounded preceding and 1 preceding), 1) as b from g where no = until),
nav as (select session, no, b * g * 10000 as nav from g join base using (t) union all select session, no, 10000 from num where no = {lookback}),
drift as (select until as t, ticker, growth / sum(growth) over (partition by until) as pre, count(*) over (partition by until) as n from hold where no = until and no > t)"""


def perf(curves: str) -> str:
    """Performance of every strategy of a table (strategy, session, nav) against a capital of 10,000."""
    return f"""select strategy, round(f / 10000 - 1, 6) as total_return, round(pow(f / 10000, 365.25 / d) - 1, 6) as cagr, round(s * sqrt({YEAR}), 6) as volatility,
  round(m * {YEAR} / (s * sqrt({YEAR})), 6) as sharpe, round(m * {YEAR} / sqrt(lp * {YEAR}), 6) as sortino, round(dd, 6) as max_drawdown, n
from (
  select strategy, arg_max(nav, session) as f, max(session) - min(session) as d, avg(r) as m, stddev_samp(r) as s, avg(least(r, 0) * least(r, 0)) as lp, min(nav / pk - 1) as dd, count(*) as n
  from (select strategy, session, nav, nav / coalesce(lag(nav) over o, 10000) - 1 as r, greatest(max(nav) over o, 10000) as pk from {curves} window o as (partition by strategy order by session))
  group by 1)"""


EW = "'Equal Weight' as strategy"
B6 = f"""with {PANEL},
{COMPLETE},
{NUM},
r as (select ticker, no, close / lag(close) over (partition by ticker order by no) - 1 as ret from complete join num using (session) where no < 52),
k as (select count(distinct ticker) as k from complete),
cov as (select covar_samp(a.ret, b.ret) * {YEAR} as v from r a join r b using (no) where a.ret is not null group by a.ticker, b.ticker)
select {EW}, 52 as t, round(ret, 6) as ret, round(vol, 6) as vol, round(ret / vol, 6) as sharpe
from (select avg(ret) * {YEAR} as ret from r), (select sqrt(sum(v)) / any_value(k) as vol from cov, k)"""
B7 = f"""{THREE},
{COMPLETE},
{NUM},
{plan(52, 26)}
select {EW}, t, {', '.join(f'round(avg(beta_{n}), 6) as beta_{n}' for n in NAMES3)}, count(*) as active from plan, fits group by t"""
B10 = f"""with {PANEL},
{COMPLETE},
{NUM}
select greatest(n - 158, 0) + 104 as t, {EW}, ticker, round(1.0::double / count(*) over (), 6) as w, 'ok' as status, n - 1 as until
from (select distinct ticker from complete), (select count(*)::int as n from num)"""
B11 = f"""with {held(52, 26)},
{MARKET},
bench as (select 'Benchmark' as strategy, session, close / first_value(close) over (order by session) * 10000 as nav from market semi join nav using (session)),
curves as (select {EW}, session, nav from nav union all by name select * from bench)
{perf('curves')}"""
B15 = f"""with {held(52, 26)}
select {EW}, t, case when t = 52 then 1.0::double else 0.0::double end as turnover, count(distinct ticker)::int as active, string_agg(distinct ticker, ',' order by ticker) as tickers
from plan, (select distinct ticker from complete) group by t"""
B17 = f"""with {held(52, 26, True)}
select {EW}, session, round(nav, 6) as nav from nav"""
B26 = f"""with {held(52, 26)}
select {EW}, session, round(nav, 6) as gross, round(nav * product(greatest(1 - case when no in (select t from plan) then 25 else 0 end / nav, 0)) over (order by session), 6) as nav from nav"""
B30 = f"""with {held(52, 26)}
select {EW}, t, round(sum(abs(pre - 1.0::double / n)) / 2, 6) as turnover from drift where t in (select t from plan) group by t"""
K4 = f"""with {held(52, 26)},
o as (
  select d.t, ticker, nav * (1.0::double / n) - nav * pre as notional from drift d join nav on no = d.t where d.t in (select t from plan)
  union all
  select 52, ticker, 10000.0::double / count(*) over () from (select distinct ticker from complete)),
c as (select *, greatest(3.0::double, 0.0005::double * abs(notional)) as commission, abs(notional) * 0.0005::double as slip from o where abs(notional) > 1e-8)
select {EW}, t, ticker, round(notional, 6) as notional, round(commission, 6) as commission, round(slip, 6) as spread, round(slip, 6) as slippage, 0.0::double as tax, round(commission + 2 * slip, 6) as cost from c"""
ROBUST = f"""with {PANEL},
{MARKET},
anchors as (select cast(a as date) as anchor, cast(a - interval 12 month as date) as est_start, cast(a + interval 12 month as date) as oos_end
  from unnest(generate_series(timestamp '1993-01-04', timestamp '1998-01-04', interval 6 month)) t(a)),
days as (select distinct session from panel),
ok as (
  select anchor, est_start, oos_end, count(*) filter (session < anchor) as est_rows from anchors join days on session >= est_start group by 1, 2, 3
  having min(session) filter (session < anchor) - est_start <= 14 and count(*) filter (session < anchor) >= 40
    and count(*) filter (session >= anchor and session < oos_end) >= 36 and max(session) >= oos_end),
whole as (select anchor, ticker from ok join panel on session >= est_start and session < anchor group by anchor, ticker, est_rows having count(*) = est_rows),
w as (select anchor, ticker, 1.0::double / count(*) over (partition by anchor) as w from whole),
grown as (
  select anchor, session, w * close / first_value(close) over (partition by anchor, ticker order by session) as v
  from w join ok using (anchor) join panel using (ticker) where session >= anchor and session < oos_end),
curves as (
  select anchor, 'Equal Weight' as strategy, session, sum(v) * 10000 as nav from grown group by 1, 3
  union all
  select anchor, 'Benchmark', session, close / first_value(close) over (partition by anchor order by session) * 10000 from ok join market on session >= anchor and session < oos_end),
results as (
  select anchor, strategy, arg_max(nav, session) / 10000 - 1 as total_return, min(nav / pk - 1) as max_drawdown
  from (select *, greatest(max(nav) over (partition by anchor, strategy order by session), 10000) as pk from curves) group by 1, 2),
pair as (select e.anchor, e.total_return as e, b.total_return as b from results e join results b using (anchor) where e.strategy = 'Equal Weight' and b.strategy = 'Benchmark')"""
B28 = f"""{ROBUST}
select strategy, count(*) as windows, round(median(total_return), 6) as median_return, round(avg(total_return), 6) as mean_return,
  round(avg((total_return > b)::int), 6) as win_rate, round(min(max_drawdown), 6) as worst_drawdown, round(avg(total_return - b), 6) as mean_excess
from results join pair using (anchor) group by 1"""
B29 = f"""{ROBUST}
select 'Benchmark' as strategy, count(*) as windows, round(avg(b - e), 6) as mean_difference, round(avg((b > e)::int), 6) as above from pair"""
WINDOWS = f"""{PANEL},
{COMPLETE},
{MARKET},
{NUM},
{plan(104, 52)},
steps_of as (
  select ticker, c.session, no, close / lag(close) over (partition by ticker order by no) - 1 as ret, lag(c.session) over (partition by ticker order by no) as own_prev
  from complete c join num using (session))"""
B1_CAPM = f"""with {WINDOWS},
m as (select session, no, close / lag(close) over (order by no) - 1 as market_ret from market join num using (session))
select t, s.ticker, round(regr_slope(ret, market_ret) * avg(market_ret) * {YEAR}, 6) as mu
from plan join steps_of s on no < t and no > t - 104 join m using (session) group by 1, 2"""
B1_FF3 = f"""with {WINDOWS},
{FACTORS},
days as (select session, lag(session) over (order by session) as prev from (select session from complete union select session from factors)),
signals as (select t, cast(session - interval 2 month as date) as cutoff from plan join num on no = t - 1),
sample as (
  select t || '|' || s.ticker as ticker, f.*, s.ret, s.ret - f.rf as y
  from plan join signals using (t) join steps_of s on no < t and no > t - 104 join days on days.session = s.session join factors f on f.session = s.session
  where own_prev = prev and s.session <= cutoff),
{fits(NAMES3)}
select split_part(ticker, '|', 1)::int as t, split_part(ticker, '|', 2) as ticker, round(expected, 6) as mu from fits"""
BRAND = """brand as (
  select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
FILED = """names as (select ticker, row_number() over (order by ticker) - 1 as b from (select distinct p_brand as ticker from part)),
facts as (
  select ticker as entity, ['income', 'equity', 'shares', 'debt'][o_orderkey % 4 + 1] as kind, cast(o_orderdate as date) as filed,
    cast(date_trunc('month', o_orderdate) - interval 1 day as date) as "end", case when o_orderkey % 11 > 0 then o_totalprice end as val, o_orderkey as accn
  from orders join names on o_custkey % (select count(*) from names) = b),
latest as (
  select entity, decision_date, kind, val, filed from dates join facts on filed < decision_date and "end" <= decision_date
  qualify row_number() over (partition by entity, decision_date, kind order by "end" desc, filed desc, accn desc) = 1),
snapshots as (
  select entity, decision_date, max(filed) as published_at,
    max(val) filter (kind = 'income') as income, max(val) filter (kind = 'equity') as equity, max(val) filter (kind = 'shares') as shares, max(val) filter (kind = 'debt') as debt,
    max(filed) filter (kind = 'income') as income_filed_at, max(filed) filter (kind = 'equity') as equity_filed_at, max(filed) filter (kind = 'shares') as shares_filed_at, max(filed) filter (kind = 'debt') as debt_filed_at
  from (select distinct entity from facts) cross join dates left join latest using (entity, decision_date) group by 1, 2)"""
DATES = "dates as (select session as decision_date from (select session, row_number() over (order by session) - 1 as k from (select distinct session from panel)) where k % 13 = 0)"
S20 = f"""with {PANEL},
{DATES},
{FILED}
select entity, decision_date, published_at, {rounded('income', 'equity', 'shares', 'debt')}, income_filed_at, equity_filed_at, shares_filed_at, debt_filed_at from snapshots"""


def percentile(x: str, low: bool = False) -> str:
    """Average-rank percentile within a decision date; null stays null."""
    up = f"(100.0 * (rank() over (partition by decision_date order by {x} nulls last) + (count({x}) over (partition by decision_date, {x}) - 1) / 2.0) / count({x}) over (partition by decision_date))"
    return f"case when {x} is not null then {'100 - ' if low else ''}{up} end"


Q8 = f"""with {PANEL},
{DATES},
{FILED},
{BRAND},
past as (
  select decision_date, ticker, session, close, row_number() over w as n, lag(close, 21) over w as p22, lag(close, 126) over w as p127, lag(close, 251) over w as p252, lag(close, 252) over w as p253,
    first_value(close) over w as p0, close / lag(close) over w - 1 as r, close / max(close) over w - 1 as dd
  from brand join dates on session < decision_date window w as (partition by decision_date, ticker order by session)),
sig as (
  select decision_date, ticker, count(*) as n, arg_max(close, session) as price,
    arg_max(case when n >= 253 then p22 / p253 when n = 252 then p22 / p252 when n >= 127 then p22 / p127 else close / p0 end, session) - 1 as momentum,
    stddev_samp(r) * sqrt({YEAR}) as volatility, min(dd) as max_drawdown from past group by 1, 2 having count(*) >= 120),
cap as (
  select s.*, k.*, case when shares > 0 and shares * price > 0 then shares * price end as cap
  from sig s semi join brand q on q.ticker = s.ticker and q.session = s.decision_date and q.close > 0
    join (select entity, decision_date as dd0, published_at, income, equity, shares, debt from snapshots) k on k.entity = s.ticker and dd0 = s.decision_date and published_at < s.decision_date),
parts as (
  select decision_date, ticker, {percentile('momentum')} as m, {percentile('volatility', True)} as v, {percentile('max_drawdown')} as d,
    {percentile('income / cap')} as e, {percentile('equity / cap')} as b, {percentile('income / nullif(equity, 0)')} as r, {percentile('debt / nullif(equity, 0)', True)} as l from cap),
scores as (
  select decision_date, ticker, m as momentum_score, (v + d) / 2 as risk_score,
    coalesce((e + b) / 2, e, b) as value_score, coalesce((r + l) / 2, r, l) as quality_score from parts),
total as (select *, (momentum_score + risk_score + value_score + quality_score) / 4 as quant_score from scores)
select decision_date, ticker, {rounded('momentum_score', 'risk_score', 'value_score', 'quality_score', 'quant_score')},
  case when quant_score is not null then row_number() over (partition by decision_date, quant_score is not null
    order by round(quant_score, 9) desc nulls last, round(momentum_score, 9) desc nulls last, round(risk_score, 9) desc nulls last, ticker) else 0 end::int as rank
from total"""
F10 = F12.replace("select session, round((1", "select 'Borsa Italiana' as market, session, round((1") + f"""
union all by name select 'USA' as market, session, {rounded('mkt_rf', 'smb', 'hml', 'rf')} from factors"""
F18 = f"""{THREE},
{COMPLETE},
num as (select session, row_number() over (order by session) - 1 as no from (select distinct session from panel)),
curve as (select ticker, session, close / first_value(close) over (partition by ticker order by session) * 10000 as nav from complete where ticker in (select ticker from fits)),
rows as (
  select c.ticker, session, nav, lag(nav) over (partition by c.ticker order by session) as before,
    coalesce(count(*) filter (no % 20 = 0) over (partition by c.ticker order by session rows between unbounded preceding and 1 preceding), 0) > 0 as loaded, f.mkt_rf, f.smb, f.hml, f.rf
  from curve c join num using (session) left join factors f using (session)),
days2 as (select r.*, beta_mkt_rf, beta_smb, beta_hml, (nav - coalesce(before, 10000)) / 10000 as day, before / 10000 as scale, before is not null and loaded and rf is not null as known from rows r join fits using (ticker)),
parts as (
  select ticker, session, case when known then beta_mkt_rf * mkt_rf * scale else 0 end as mkt_rf, case when known then beta_smb * smb * scale else 0 end as smb,
    case when known then beta_hml * hml * scale else 0 end as hml, case when known then rf * scale else 0 end as rf,
    case when before is null then day when known then day - (beta_mkt_rf * mkt_rf + beta_smb * smb + beta_hml * hml + rf) * scale else 0 end as unexplained,
    case when before is null or known then 0 else day end as unattributed
  from days2),
long as (unpivot parts on mkt_rf, smb, hml, rf, unexplained, unattributed into name component value contribution)
select ticker as strategy, session, component, round(contribution, 6) as contribution, round(sum(contribution) over (partition by ticker, component order by session), 6) as cumulative from long"""
R13 = f"""with {PANEL},
{COMPLETE},
{RETS},
p as (select ticker, w / sum(w) over () as w from (select ticker, arg_max(close, session) * (ascii(ticker) - 60) as w from panel group by 1)),
last as (select session from rets group by 1 order by 1 desc limit 63),
day as (select session, sum(w * ret) as p from rets join p using (ticker) semi join last using (session) group by 1)
select ticker, round(any_value(w), 6) as weight, round(any_value(w) * covar_samp(ret, day.p) / var_samp(day.p), 6) as contribution from rets join day using (session) join p using (ticker) group by 1"""
S10 = f"""with {PANEL}
select ticker, session, round(close, 6) as close from panel where ticker <> 'NO'"""
Q5 = f"""with {BRAND},
sig as (
  select ticker, n, case when n >= 253 then p22 / p253 when n = 252 then p22 / p252 when n >= 127 then p22 / p127 else p1 / p0 end as momentum, volatility, max_drawdown from (
    select ticker, count(*) as n, max(close) filter (rn = 1) as p1, max(close) filter (rn = 22) as p22, max(close) filter (rn = 127) as p127, max(close) filter (rn = 252) as p252,
      max(close) filter (rn = 253) as p253, max(close) filter (up = 1) as p0, stddev_samp(ret) as volatility, min(dd) as max_drawdown
    from (select *, row_number() over (partition by ticker order by session desc) as rn, row_number() over o as up, close / lag(close) over o - 1 as ret, close / max(close) over o - 1 as dd
      from brand window o as (partition by ticker order by session)) group by 1)),
parts as (select 1 as decision_date, * from sig where n >= 80),
sc as (select ticker, {percentile('momentum')} as m, ({percentile('volatility', True)} + {percentile('max_drawdown')}) / 2 as r from parts),
ranked as (select ticker, row_number() over (order by round((m + r) / 2, 9) desc, round(m, 9) desc, round(r, 9) desc, ticker)::int as rank from sc)
select u.ticker, rank, coalesce(rank <= 10, false) as selected, case when rank <= 10 then 'Selected' when rank is not null then 'Candidate' else 'Excluded' end as status,
  case when n is null then 'No prices' when n < 80 then 'Too few prices' end as reason
from (select distinct p_brand as ticker from part) u left join sig using (ticker) left join ranked using (ticker)"""
V4 = f"""with recursive {EWMA},
x as (
  select ticker, k as origin, count(*) over (partition by ticker) as n, variance,
    var_samp(ret) over (partition by ticker order by k rows between 63 preceding and 1 preceding) as rolling, avg(ret * ret) over (partition by ticker order by k rows between current row and 12 following) as rv
  from ewma),
long as (select ticker, 'EWMA' as model, variance as f, rv from x where origin >= 104 and origin <= n - 13 and (origin - 104) % 13 = 0
  union all select ticker, 'Rolling', rolling, rv from x where origin >= 104 and origin <= n - 13 and (origin - 104) % 13 = 0)
select ticker, model, round(avg(ln(greatest(f, 1e-12)) + rv / greatest(f, 1e-12)), 6) as qlike, round(avg(pow(f - rv, 2)), 6) as mse, count(*) as n from long group by 1, 2"""
V8 = f"""with recursive {EWMA}
select ticker, 'Rolling' as model, round(sqrt(var_samp(ret) * {YEAR}) * 100, 6) as vol_pct from (select *, row_number() over (partition by ticker order by session desc) as b from logr) where b <= 63 group by 1
union all select ticker, 'EWMA', round(sqrt(arg_max(variance * 0.94 + ret * ret * 0.06, session) * {YEAR}) * 100, 6) from ewma group by 1"""
T12 = f"""with {PANEL},
last as (select ticker, arg_max(close, session) as price from panel group by 1),
o as (select l_returnflag || l_linestatus as ticker, sum(l_quantity) as quantity, sum(l_quantity * (l_extendedprice / l_quantity) + 1) as cost_basis from lineitem group by 1)
select ticker, round(quantity, 6) as quantity, round(quantity * price, 2) as value, round(cost_basis, 2) as cost_basis,
  round(quantity * price - cost_basis, 2) as profit, round(quantity * price / sum(quantity * price) over (), 6) as weight
from o join last using (ticker)"""


def _in_euro(names: tuple[str, ...], factors: str) -> str:
    """A subquery: (ticker, mu) of the names in `usd`, by regressions on the given factors."""
    return f"""(with {sample("usd", factors)}, {fits(names)},
  change as (select avg(r) as m from (select fx / lag(fx) over (order by session) - 1 as r from fx where session <= (select max(session) from lately)))
  select ticker, ((1 + expected / {YEAR}) / (1 + m) - 1) as mu from fits, change)"""


L6 = f"""with {PANEL},
{COMPLETE},
{MARKET},
{FX},
{FACTORS},
{FACTORS5},
lately as (select * from complete where session in (select session from (select distinct session from complete) order by session desc limit 201)),
{USD.replace("from panel p", "from lately p")},
names as (select distinct ticker from lately),
r as (select * from (select ticker, session, close / lag(close) over (partition by ticker order by session) - 1 as ret from lately) where ret is not null),
carried as (
  select d.session, last_value(k.close ignore nulls) over (order by d.session) as close
  from (select distinct session from lately) d left join market k on k.session = d.session),
m as (select session, close / lag(close) over (order by session) - 1 as mr from carried)
select 'Historical Mean' as estimator, ticker, round(avg(ret), 6) as mu from r group by 2
union all select 'CAPM', ticker, round((0.02 + regr_slope(ret, mr) * (avg(mr) * {YEAR} - 0.02)) / {YEAR}, 6) from r join m using (session) where mr is not null group by 2
union all select 'FF3', ticker, round(mu, 6) from names left join {_in_euro(NAMES3, "factors")} using (ticker)
union all select 'FF5', ticker, round(mu, 6) from names left join {_in_euro(NAMES5, "factors5")} using (ticker)"""

B16_INCEPTION = f"""with {PANEL},
w as (
  select a.session as t, b.ticker, coalesce(p.close / sum(p.close) over (partition by a.session), 0) as w
  from (select distinct session from panel) a cross join (select distinct ticker from panel) b left join panel p on p.session = a.session and p.ticker = b.ticker),
moves as (select abs(w - lag(w) over (partition by ticker order by t)) as move from w),
ranked as (select w, row_number() over (order by w desc, ticker) as rk from w where t = (select min(t) from w) and w > 1e-10)
select 'x' as strategy, count(*) as active, round(max(w), 6) as max_weight, round(sum(w) filter (rk <= 3), 6) as top3, round(sum(w * w), 6) as hhi,
  round((select sum(move) / 2 from moves), 6) as turnover
from ranked having count(*) > 0"""

ORACLES = {
    "f6_three_factor_fit": _fit_query(NAMES3, THREE),
    "f7_five_factor_fit": _fit_query(NAMES5, FIVE),
    "f11_factor_covariance": F11,
    "f12_factors_to_eur": F12,
    "f15_estimate_in_eur": F15,
    "f17_attribution": F17,
    "b28_calendar": B28_CALENDAR,
    "v3_volatility_summary": V3,
    "v10_exposure_overlay": V10,
    "v11_overlay_deltas": V11,
    "t1_rsi14": T1_RSI,
    "t2_trend_signal": T2,
    "t3_entry_exit": T3,
    "t8_coverage_tests": T8,
    "q5_live_screen": Q5,
    "v4_rolling_validation": V4,
    "v8_forecast_summary": V8,
}
