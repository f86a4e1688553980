"""DuckDB SQL of the queries in plans/catalog_mechanisms.py, written from definitions: windows as range joins, series as
recursive expressions, ranks and percentiles as the engine has them."""

from __future__ import annotations

from quantloom.plans import oracles as O

FEATURES = ("mom21", "mom63", "mom126", "mom252", "vol21", "vol63", "dd63", "market_mom63", "relative_mom63")

NUMBERED = "numbered as (select session, (row_number() over (order by session) - 1)::int as no from (select distinct session from complete))"
#: Decisions from 51 sessions before the last one on, every 13.
CLOCK = """size as (select count(*)::int as n from numbered),
clock as (select t::int as t, least(t + 13, n - 1)::int as until from (select n, unnest(range(greatest(n - 52, 0), n - 1, 13)) as t from size))"""
LEARN = f"""{NUMBERED},
{CLOCK},
steps_of as (select ticker, session, no, close, close / lag(close) over (partition by ticker order by no) - 1 as ret from complete join numbered using (session)),
equal as (select no, product(1 + m) over (order by no) as level from (select no, coalesce(avg(ret), 0) as m from steps_of group by 1)),
features as (
  select ticker, no, mom21, mom63, mom126, mom252, vol21, vol63, dd63, market_mom63, mom63 - market_mom63 as relative_mom63, target from (
    select ticker, no, {", ".join(f"close / lag(close, {n}) over o - 1 as mom{n}" for n in (21, 63, 126, 252))},
      {", ".join(f"case when count(ret) over (o rows {n - 1} preceding) = {n} then stddev_samp(ret) over (o rows {n - 1} preceding) * sqrt(252) end as vol{n}" for n in (21, 63))},
      case when count(close) over (o rows 62 preceding) = 63 then close / max(close) over (o rows 62 preceding) - 1 end as dd63,
      level / lag(level, 63) over o - 1 as market_mom63, lead(close) over o / close - 1 as target
    from steps_of join equal using (no) window o as (partition by ticker order by no))),
known as (select * from features where {" and ".join(f"{c} is not null" for c in (*FEATURES, "target"))})"""

_ALL = ("1", *FEATURES, "target")
L5_SUMS = f"""with {O.PANEL}, {O.COMPLETE}, {LEARN}
select t, {", ".join(f"round(coalesce(sum(({a}) * ({b})) filter (no is not null), 0)::double, 6) as s_{a}_{b}" for i, a in enumerate(_ALL) for b in _ALL[i:])}
from clock left join known on no between t - 200 and t - 1 group by t"""

L5_CONDITIONS = f"""with {O.PANEL}, {O.COMPLETE}, {LEARN}
select t, unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) as feature, true as holds
from (select t from clock join known on no between t - 200 and t - 1 group by t having count(*) >= 90)"""



def _in_euro(names: tuple[str, ...], factors: str) -> str:
    """A subquery: (ticker, mu) of the names in `usd`, which begin with their decision's number."""
    return f"""(with {O.sample("usd", factors)}, {O.fits(names)},
  change as (select t, avg(r) as m from (select session, fx / lag(fx) over (order by session) - 1 as r from fx) c
    join (select t, session as decided from clock join numbered on no = t) k on c.session <= k.decided group by 1)
  select ticker, ((1 + expected / {O.YEAR}) / (1 + m) - 1) as mu from fits join change on t = split_part(ticker, '|', 1)::int)"""


#: estimates (t, estimator, ticker, mu): each decision's window of 201 prices is a set of names of its own.
ESTIMATORS = f"""with {O.PANEL},
{O.COMPLETE},
{O.MARKET},
{O.FX},
{O.FACTORS},
{O.FACTORS5},
{NUMBERED},
{CLOCK},
lately as (select t || '|' || ticker as ticker, session, close from complete join numbered using (session) join clock on no between t - 200 and t),
{O.USD.replace("from panel p", "from lately p")},
names as (select distinct ticker from lately),
r as (select * from (select ticker, session, close / lag(close) over (partition by ticker order by session) - 1 as ret from lately) where ret is not null),
carried as (
  select d.session, last_value(k.close ignore nulls) over (order by d.session) as close
  from (select distinct session from lately) d left join market k on k.session = d.session),
m as (select session, close / lag(close) over (order by session) - 1 as mr from carried),
named as (
  select 'Historical Mean' as estimator, ticker, avg(ret) as mu from r group by 2
  union all select 'CAPM', ticker, (0.02 + regr_slope(ret, mr) * (avg(mr) * {O.YEAR} - 0.02)) / {O.YEAR} from r join m using (session) where mr is not null group by 2
  union all select 'FF3', ticker, mu from names left join {_in_euro(O.NAMES3, "factors")} using (ticker)
  union all select 'FF5', ticker, mu from names left join {_in_euro(O.NAMES5, "factors5")} using (ticker)),
estimates as (select split_part(ticker, '|', 1)::int as t, estimator, split_part(ticker, '|', 2) as ticker, mu from named)"""
L8_ESTIMATORS = f"{ESTIMATORS} select t, estimator, ticker, round(mu, 6) as mu from estimates"

#: weights (strategy, t, ticker, w) to equity, with drift and 3 basis points of what is traded.
EQUITY = """held as (select strategy, t, until, ticker, w, p.no, p.session, p.close / q.close as growth
  from weights join clock using (t) join steps_of q using (ticker) join steps_of p using (ticker) where q.no = t and p.no > t and p.no <= until),
periods as (select strategy, t, sum(w * growth) as g from held where no = until group by 1, 2),
drifted as (select strategy, until as t, ticker, w * growth / g as d from held join periods using (strategy, t) where no = until),
trades as (select strategy, t, sum(abs(coalesce(w, 0) - coalesce(d, 0))) as traded from weights full join drifted using (strategy, t, ticker) join clock using (t) group by 1, 2),
factor as (select strategy, t, coalesce(product(g) over (o rows between unbounded preceding and 1 preceding), 1) as base, product(1 - traded * 3 / 10000) over (o rows between unbounded preceding and current row) as keep
  from periods join trades using (strategy, t) window o as (partition by strategy order by t)),
equity as (select strategy, session, base * keep * sum(w * growth) as nav from held join factor using (strategy, t) group by strategy, session, base, keep)"""
L8_EQUITY = f"""{ESTIMATORS},
steps_of as (select ticker, session, no, close from complete join numbered using (session)),
weights as (select strategy, t, ticker, case when total > 0 then greatest(mu, 0) / total else 1 / n end as w
  from (select estimator as strategy, t, ticker, mu, sum(greatest(mu, 0)) over o as total, count(*) over o as n from estimates window o as (partition by estimator, t))),
{EQUITY},
levels as (select no, session, last_value(close ignore nulls) over (order by no) as level from numbered left join market using (session))
select strategy, session, round(nav, 6) as nav from equity
union all select 'Benchmark', a.session, round(a.level / b.level, 6) from levels a join levels b on b.no = (select min(t) from clock) where a.no > b.no"""

#: history (strategy, k, ret): steps between neighbouring sessions of all curves' calendar that every curve has.
HISTORY = """calendar as (select session, row_number() over (order by session) as k from (select distinct session from panel)),
moves as (select p.ticker as strategy, d.k, case when lag(d.k) over (o) = d.k - 1 then close / lag(close) over (o) - 1 end as ret from panel p join calendar d using (session) window o as (partition by p.ticker order by d.k)),
history as (select * from moves where ret is not null qualify count(*) over (partition by k) = (select count(distinct ticker) from panel))"""


def drawn(name: str, source: str, paths: int, days: int, block: int, seed: int) -> str:
    """<name> (path, day, strategy, ret, value): blocks of history rows by the minimal standard generator."""
    blocks, m = -(-days // block), 2147483647
    return f"""{name}_ks as (select distinct k from {source}),
{name}_starts as (select a.k as start, row_number() over (order by a.k) - 1 as i from {name}_ks a where (select count(*) from {name}_ks b where b.k between a.k and a.k + {block - 1}) = {block}),
{name}_grid as (select p as path, b, ((((((p * 1000003 + b * 7919 + {seed}) % {m}) * 48271) % {m}) * 48271) % {m}) >> 8 as x from range({paths}) t(p), range({blocks}) u(b)),
{name}_days as (select path, b * {block} + j + 1 as day, start + j as k from {name}_grid join {name}_starts on i = x % (select count(*) from {name}_starts), range({block}) v(j) where b * {block} + j < {days}),
{name} as (select path, day, strategy, ret, product(1 + ret) over (partition by path, strategy order by day) * 10000 as value from {name}_days join {source} using (k))"""


M4_FAN = f"""with {O.PANEL}, {HISTORY}, {drawn("paths", "history", 300, 26, 4, 42)}
select strategy, day::int as day, {", ".join(f"round(quantile_cont(value, {p / 100}), 6) as p{p}" for p in (5, 25, 50, 75, 95))} from paths group by 1, 2"""

M3_METRICS = f"""with {O.PANEL}, {HISTORY}, {drawn("paths", "history", 300, 26, 4, 42)},
falls as (select *, value / greatest(max(value) over (partition by path, strategy order by day), 10000) - 1 as dd from paths),
ends as (select path, strategy, arg_max(value, day) as final, min(dd) as mdd from falls group by 1, 2),
tails as (select strategy, sum((final - 10000) * w) / sum(w) as t from (
  select *, greatest(0, least(1, count(*) over (partition by strategy) * 0.05::double - (row_number() over (partition by strategy order by final) - 1))) as w from ends) group by 1),
daily as (select strategy, sum(ret * w) / sum(w) as t from (
  select *, greatest(0, least(1, count(*) over (partition by strategy) * 0.05::double - (row_number() over (partition by strategy order by ret) - 1))) as w from paths) group by 1),
q as (select strategy, quantile_cont(ret, 0.05) as q from paths group by 1)
select strategy, round(avg(final), 6) as mean, round(median(final), 6) as median, round(quantile_cont(final, 0.05), 6) as p5, round(quantile_cont(final, 0.95), 6) as p95,
  round(avg((final < 10000)::int) * 100, 6) as p_loss, round(avg((mdd <= -0.2::double)::int) * 100, 6) as p_drawdown20, round(greatest(0, 10000 - quantile_cont(final, 0.05)), 6) as var,
  round(greatest(0, -any_value(tails.t)), 6) as es, round(greatest(0, -any_value(q.q)) * 10000, 6) as daily_var, round(greatest(0, -any_value(daily.t)) * 10000, 6) as daily_es
from ends join tails using (strategy) join daily using (strategy) join q using (strategy) group by 1"""

_SAMPLES = {"all": "history", "first half": "early", "second half": "late"}
_METHODS = {"moving_block_4": 4, "moving_block_10": 10, "iid": 1}
M6_GRID = f"""with {O.PANEL}, {HISTORY},
early as (select * from history where k <= (select quantile_cont(k, 0.5) from history)),
late as (select * from history where k > (select quantile_cont(k, 0.5) from history)),
{", ".join(drawn(f"{source}_{name}", source, 200, 13, block, 7) for source in _SAMPLES.values() for name, block in _METHODS.items())}
""" + " union all ".join(f"select '{sample}' as sample, strategy, " + ", ".join(f"round(any_value({name}), 6) as {name}" for name in _METHODS) + " from (" + " union all by name ".join(f"select strategy, median(value) as {name} from {source}_{name} where day = 13 group by 1" for name in _METHODS) + ") group by strategy" for sample, source in _SAMPLES.items())

_MODELS = "unnest(['Minimum Volatility', 'Maximum Sharpe', 'Risk Parity', 'HRP', 'Equal Weight']) as strategy"
O1_CERTIFICATES = f"""with {O.PANEL}, {O.COMPLETE}, caps as (select unnest([1.0, 0.5, 0.25])::double as cap),
names as (select count(distinct ticker)::int as n from complete)
select strategy, cap, n, true as feasible, case when strategy <> 'HRP' then true end as optimal from (select cap, n, {_MODELS} from caps, names)"""

#: Tickers with a price on each of the 104 sessions before t.
B1_CERTIFICATES = f"""with {O.PANEL}, num as (select session, (row_number() over (order by session) - 1)::int as no from (select distinct session from panel)),
clock as (select unnest(range(104, (select count(*) from num) - 1, 52))::int as t),
whole as (select t, ticker from panel join num using (session) join clock on no < t and no >= t - 104 group by 1, 2 having count(*) = 104),
names as (select t, count(*)::int as n from whole group by 1)
select t, strategy, n, true as feasible, case when strategy <> 'HRP' then true end as optimal from (select t, n, {_MODELS} from names)"""

K1_COMMITS = """select user_id::varchar as owner, 'events' as portfolio, event_type as kind, event_id::varchar as record,
  case when event_id % 3 < 2 then props else 'second' end as payload from events"""

#: b with b + cost(b) = v by steps b <- v - cost(b): orders' costs rise far slower than b.
_COST = "list_sum(list_transform(h, lambda x: case when abs(b / n - x) > 1e-8 then greatest(3.0::double, 0.0005::double * abs(b / n - x)) + abs(b / n - x) * 0.001::double else 0 end))"
NET = f"""with recursive {O.held(52, 26)},
steps as (select t, list(growth order by ticker) as g, row_number() over (order by t) as k, count(*)::int as held from hold where no = until group by 1),
net as (
  select 1::bigint as k, held as n, list_transform(g, lambda x: 0.0::double) as h, 10000.0::double as v from steps where k = 1
  union all
  select k + 1, n, list_transform(g, lambda x: b * x / n), list_sum(list_transform(g, lambda x: b * x / n))
  from (select net.k, net.n, s.g, list_reduce(list_transform(range(30), lambda i: v), lambda b, z: v - {_COST}) as b from net join steps s on s.k = net.k)
  where k < (select max(k) from steps)),
budgets as (select t, v, list_reduce(list_transform(range(30), lambda i: v), lambda b, z: v - {_COST}) as b from net join steps using (k)),
curve as (
  select session, b as nav, v - b as cost from budgets join num on no = t
  union all
  select session, b * g, 0 from g join budgets using (t) where no < until or no = (select max(no) from num))"""
B5_NET = f"{NET} select {O.EW}, session, round(nav, 6) as nav, round(cost, 6) as cost from curve"
B11_COSTS = f"""{NET}, {O.MARKET},
bench as (select 'Benchmark' as strategy, session, close / first_value(close) over (order by session) * 10000 as nav from market semi join curve using (session)),
curves as (select {O.EW}, session, nav from curve union all by name select * from bench),
summary as (select {O.EW}, round(sum(cost), 6) as total_cost, count(*) filter (cost > 0) as paid_rebalances, round((select arg_max(nav, session) from nav) / 10000 - 1, 6) as gross_return,
  round((select arg_max(nav, session) from nav) / 10000 - arg_max(nav, session) / 10000, 6) as cost_drag from curve)
select * replace (coalesce(paid_rebalances, 0) as paid_rebalances) from ({O.perf("curves")}) left join summary using (strategy)"""

B10_RUN = f"""with {O.PANEL}, {O.COMPLETE}, {NUMBERED}, {O.MARKET},
size as (select count(*)::int as n from numbered),
first as (select greatest(n - 158, 0) + 104 as t from size),
r as (select ticker, no, close / lag(close) over (partition by ticker order by no) - 1 as ret from complete join numbered using (session), first where no >= t - 104 and no <= t),
k as (select count(distinct ticker) as k from complete),
cov as (select covar_samp(a.ret, b.ret) * {O.YEAR} as v from r a join r b using (no) where a.ret is not null group by a.ticker, b.ticker),
hope as (select {O.EW}, round(ret, 6) as ex_ante_return, round(vol, 6) as ex_ante_volatility, round(ret / vol, 6) as ex_ante_sharpe
  from (select avg(ret) * {O.YEAR} as ret from r), (select sqrt(sum(v)) / any_value(k) as vol from cov, k)),
nav as (select session, avg(close / p0) * 10000 as nav from (select session, ticker, no, close, first_value(close) over (partition by ticker order by no) as p0 from complete join numbered using (session), first where no >= t) group by 1),
bench as (select 'Benchmark' as strategy, session, close / first_value(close) over (order by session) * 10000 as nav from market semi join nav using (session)),
curves as (select {O.EW}, session, nav from nav union all by name select * from bench)
select * from ({O.perf("curves")}) left join hope using (strategy)"""

B9 = f"""with {O.held(52, 26)}, curves as (select {O.EW}, session, nav * 0.995::double as nav from nav)
{O.perf("curves")}"""
B17_SAME = f"""with {O.held(52, 26, True)}
select {O.EW}, session, round(nav * 0.995::double, 6) as nav from nav"""
B22 = f"""with {O.PANEL}, {O.COMPLETE}, {NUMBERED},
settings as (select unnest([26, 52, 104, 300])::int as lookback, unnest([52, 26, 104, 100])::int as test),
size as (select count(*)::int as n, max(session) as last from numbered),
fits as (select *, n >= lookback + test + 2 as ok from settings, size),
starts as (select lookback, test, unnest(range(n - test - 1, n - 1, 13)) as no from fits where ok),
each as (select lookback, test, min(session) as t0, string_agg(session::varchar, ',' order by session) as decisions from starts join numbered using (no) group by 1, 2)
select lookback, test, case when ok then 'ok' else 'not enough sessions' end as status, t0, case when ok then last end as last, decisions from fits left join each using (lookback, test)"""
O13 = """select 'model' as kind, unnest(['Minimum Volatility', 'Maximum Sharpe', 'Risk Parity', 'HRP', 'Equal Weight']) as name, true as no_calmer, true as no_better
union all select 'frontier', unnest(range(20))::varchar, true, true"""
S4 = f"""with {O.PANEL}, three as (select case ticker when 'RF' then 'INDEX' else ticker end as ticker, session, close from panel where ticker in ('AF', 'RF', 'NO'))
select ticker, session, round(close, 6) as close from three where session in (select session from three group by 1 having count(*) = 3)"""
T5 = f"""with {O.PANEL},
q as (select ticker, session, close, k, case when month(session) = 6 and day(session) <= 7 then close * 0.005::double else 0 end as dividend, case when k = 100 and ticker in ('AF', 'RF') then 2.0::double end as split
  from (select *, row_number() over (partition by ticker order by session) as k from panel)),
o as (select row_number() over () as id, ticker, session as date, case when k = 30 then 10.0::double else 5.0::double end as quantity, close as price from q where k in (30, 150)),
units as (select o.id, coalesce(product(split), 1) * any_value(quantity) as units from o left join q on q.ticker = o.ticker and q.session > o.date group by 1),
held as (select q.session, close * units as mark, case when q.session > date then dividend * units else 0 end as paid, case when q.session = date then quantity * price + 1 else 0 end as cost
  from o join units using (id) join q using (ticker) where q.session >= date),
day as (select session, sum(mark) as v, sum(paid) as paid, sum(cost) as flow, row_number() over (order by session) as k from held group by 1),
nav as (select session, k, v + sum(paid) over (order by session) + 100 as nav, flow + case when k = 1 then 100 else 0 end as flow from day),
ret as (select *, case when k = 1 then nav / flow - 1 else (nav - flow) / lag(nav) over (order by session) - 1 end as ret from nav),
eq as (select *, product(1 + ret) over (order by session) as equity from ret)
select session, round(nav, 6) as nav, round(ret, 6) as ret, round(equity, 6) as equity, round(equity / greatest(max(equity) over (order by session), 1) - 1, 6) as drawdown from eq"""


def _window_fit(names: tuple[str, ...], factors: str) -> str:
    """(key, mu): factor-model expected returns of each window's sample, whose names begin with the window's anchor."""
    sample = f"""sample as (
  select key as ticker, f.*, ret, ret - f.rf as y from inside join {factors} f using (session) join nexts using (session)
  where own_prev = prev and session <= cutoff)"""
    return f"(with {sample}, {O.fits(names, 40)} select ticker as key, expected as mu from fits)"


B28_MEANS = f"""with {O.PANEL},
{O.MARKET},
{O.FACTORS},
{O.FACTORS5},
days as (select distinct session from panel),
anchors as (select unnest(generate_series(date '1993-01-04', date '1998-01-04', interval 6 month))::date as anchor),
spans as (select anchor, (anchor - interval 24 month)::date as est_start, (anchor + interval 12 month)::date as oos_end from anchors),
counted as (select anchor, est_start, oos_end, min(session) filter (session < anchor) as first, count(*) filter (session < anchor) as est_rows,
  count(*) filter (session >= anchor and session < oos_end) as oos_rows, max(session) as last, max(session) filter (session < anchor) as known from spans join days on session >= est_start group by 1, 2, 3),
good as (select *, (known - interval 2 month)::date as cutoff from counted where date_diff('day', est_start, first) <= 14 and est_rows >= 80 and oos_rows >= 36 and last >= oos_end),
mr as (select session, close / lag(close) over (order by session) - 1 as mr from (select d.session, m.close from days d left join market m using (session))),
nexts as (select session, lag(session) over (order by session) as prev from (select session from panel union select session from factors)),
steps_in as (select ticker, session, close / lag(close) over o - 1 as ret, lag(session) over o as own_prev from panel window o as (partition by ticker order by session)),
whole as (select anchor, ticker from panel join good on session >= est_start and session < anchor group by anchor, ticker, est_rows having count(*) = est_rows),
inside as (select anchor, anchor || '|' || ticker as key, ticker, session, ret, own_prev, cutoff from steps_in join good on session > first and session < anchor where ret is not null)
select 'history' as kind, anchor, ticker, round(avg(ret) * {O.YEAR}, 6) as mu from inside semi join whole using (anchor, ticker) group by 2, 3
union all select 'capm', anchor, ticker, round(0.02 + regr_slope(ret, mr) * (avg(mr) * {O.YEAR} - 0.02), 6) from inside join mr using (session) where mr is not null group by 2, 3
union all select 'ff3', split_part(key, '|', 1)::date, split_part(key, '|', 2), round(mu, 6) from {_window_fit(O.NAMES3, "factors5")}
union all select 'ff5', split_part(key, '|', 1)::date, split_part(key, '|', 2), round(mu, 6) from {_window_fit(O.NAMES5, "factors5")}"""
