"""All queries of the core library over the adapter views, with independent DuckDB SQL where there is one.

A query is a function (spark, sf_dir) -> DataFrame. Doubles are rounded to 6 places at the end on both
sides, as engines add in different orders. Kernels and simulations have no SQL; tests check them by
certificates (sums, bounds, optimality, planted values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quantloom.operators import activation as A
from quantloom.operators import backtest as B
from quantloom.operators import construct as C
from quantloom.operators import factors as FA
from quantloom.operators import learning as L
from quantloom.operators import montecarlo as M
from quantloom.operators import returns as R
from quantloom.operators import robustness as RB
from quantloom.operators import screening as S
from quantloom.operators import signals as SG
from quantloom.operators import volatility as V
from quantloom.plans import oracles
from quantloom.sources import sinks, tables as X
from quantloom.sources.scratch import stored
from quantloom.streaming.journal import as_journal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CTE = {
    "panel": ("", "select l_returnflag || l_linestatus as ticker, cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem group by 1, 2"),
    "brand": ("", "select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem join part on l_partkey = p_partkey group by 1, 2"),
    "market": ("", "select cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem group by 1"),
    "mret": ("market", "select * from (select session, close / lag(close) over (order by session) - 1 as market_ret from market) where market_ret is not null"),
    "complete": ("panel", "select * from panel where session in (select session from panel group by 1 having count(distinct ticker) = (select count(distinct ticker) from panel))"),
    "rets": ("complete", "select * from (select ticker, session, close / lag(close) over (partition by ticker order by session) - 1 as ret from complete) where ret is not null"),
    "ew": ("panel", "select ticker, 1.0::double / count(*) over () as w from (select distinct ticker from panel)"),
    "cov": ("rets", "select a.ticker as ti, b.ticker as tj, covar_samp(a.ret, b.ret) * 252 as value, count(*) as n from rets a join rets b using (session) group by 1, 2"),
    "dates": ("panel", "select session as decision_date from (select session, row_number() over (order by session) - 1 as k from (select distinct session from panel)) where k % 13 = 0"),
    "num": ("panel", "select session, row_number() over (order by session) - 1 as no from (select distinct session from panel)"),
    "curve": ("complete,ew", "select session, sum(w * close / c0) * 10000 as nav from (select *, first_value(close) over (partition by ticker order by session) as c0 from complete join ew using (ticker)) group by 1"),
    "logr": ("panel", "select * from (select ticker, session, ln(close / lag(close) over (partition by ticker order by session)) as ret from panel) where ret is not null"),
    "sig0": ("", "select ticker, session, close, row_number() over (partition by ticker order by session desc) as rn, row_number() over (partition by ticker order by session) as up, close / lag(close) over (partition by ticker order by session) - 1 as ret, close / max(close) over (partition by ticker order by session) - 1 as dd from {src}"),
}


def sql(main: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        deps, _ = CTE[name]
        for d in filter(None, deps.split(",")):
            add(d)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    head = ", ".join(f"{n} as ({CTE[n][1]})" for n in order)
    return f"with {head} {main}" if head else main


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda v: getattr(X, v)(spark, sf_dir), spark, sf_dir)
            return df.select(*(F.round(c.name, 6).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _rets(v):
    return R.simple_returns(v("panel"))


def _ew(v):
    return R.equal_weights(v("panel"))


def _dates(v):
    days = B.sessions(v("panel"))
    return days.where(F.col("no") % 13 == 0).select(F.col("session").alias("decision_date"))


def _mret(v):
    from pyspark.sql import Window as W

    m = v("market")
    return m.select("session", (F.col("close") / F.lag("close").over(W.partitionBy(F.lit(0)).orderBy("session")) - 1).alias("market_ret")).where("market_ret is not null")


def _curve(v):
    """An equally weighted buy-and-hold curve of the panel."""
    p = R.complete_sessions(v("panel")).join(R.equal_weights(v("panel")), "ticker")
    from pyspark.sql import Window as W

    first = F.first("close").over(W.partitionBy("ticker").orderBy("session"))
    p = p.withColumn("g", F.col("close") / first)
    return p.groupBy("strategy", "session").agg((F.sum(F.col("w") * F.col("g")) * 10000).alias("nav"))


#: Least rows a year and a month of a window of weekly prices.
WEEKLY = (40, 3)


# --- scans and cleaning ---------------------------------------------------------------------------


@query("select distinct on (trim(p_name)) trim(p_name) as ticker, trim(p_type) as name from part where trim(p_name) <> '' and lower(trim(p_name)) <> 'nan' order by trim(p_name), p_partkey")
def s3_clean_universe(v, spark, d):
    p = X.table(spark, d, "part")
    return S.clean_universe(p.select(F.col("p_name").alias("ticker"), F.col("p_type").alias("name"), F.col("p_partkey").alias("input_ord")))


@query("select ticker, name from (select s_name as ticker, n_name as name, row_number() over (partition by s_name order by n_name) as rn from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE') where rn = 1")
def s2_market_universe(v, spark, d):
    s, n, r = (X.table(spark, d, t) for t in ("supplier", "nation", "region"))
    cat = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cat = cat.select(F.col("r_name").alias("market"), F.lit("Stock").alias("asset_type"), F.col("n_name").alias("name"), F.col("s_name").alias("ticker"), F.lit("EUR").alias("currency"))
    return S.market_universe(cat, "EUROPE").select("ticker", "name")


@query(sql("select ticker, session, round(close, 6) as close from complete", "complete"))
def s4_complete_prices(v, spark, d):
    return R.complete_sessions(v("panel")).select("ticker", "session", "close")


@query(sql("select ticker, count(*) as valid_prices, case when count(*) >= 80 then 'ok' else 'too few prices' end as status from brand where close > 0 group by 1", "brand"))
def s5_history_gate(v, spark, d):
    p = v("panel_brand").withColumn("ingest_ord", F.lit(1))
    return S.history_status(p, S.clean_prices(p)).select("ticker", F.col("valid_rows").alias("valid_prices"), "status")


@query(sql("select session, ticker, round(close, 6) as close from panel", "panel"))
def s6_unpivot_quotes(v, spark, d):
    p = v("panel")
    tickers = sorted(r[0] for r in p.select("ticker").distinct().collect())  # flag and status pairs: the columns of a wide file
    wide = p.groupBy("session").pivot("ticker", tickers).agg(F.first("close"))
    names = [f"Close|{t}" if i % 2 else f"{t}|Close" for i, t in enumerate(tickers)]
    return S.unpivot_quotes(wide.select("session", *(F.col(t).alias(n) for t, n in zip(tickers, names, strict=True))))


@query("select ticker, session, round(close, 6) as close from (select l_partkey::varchar as ticker, cast(l_shipdate as date) as session, l_extendedprice as close, row_number() over (partition by l_partkey, cast(l_shipdate as date) order by l_orderkey * 10 + l_linenumber desc) as rn from lineitem where l_extendedprice > 0) where rn = 1")
def s7_clean_prices(v, spark, d):
    li = X.table(spark, d, "lineitem")
    raw = li.select(F.col("l_partkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("session"), F.col("l_extendedprice").alias("close"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_ord"))
    return S.clean_prices(raw)


@query(sql("select ticker, count(*) as raw_rows, count(*) as valid_rows, count(*) || ' valid / ' || count(*) || ' raw rows, ' || min(session) || ' to ' || max(session) as history, 'ok' as status from panel group by 1", "panel"))
def s8_history_status(v, spark, d):
    p = v("panel").withColumn("ingest_ord", F.lit(1))
    return S.history_status(p, S.clean_prices(p))


@query(oracles.S19)
def s19_facts_as_of(v, spark, d):
    dates = X.table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("decision_date")).distinct()
    return S.facts_as_of(v("filings"), dates)


@query("with x as (select c_custkey::varchar as ticker, c_acctbal / 100 as pe, c_acctbal / 1000 as pb, c_nationkey / 100.0::double as roe, case when c_custkey % 3 = 0 then null else c_nationkey * 10.0::double end as de from customer), y as (select ticker, case when pe > 0 then 1 / pe end as ey, case when pb > 0 then 1 / pb end as bm, roe, de / 100 as de from x) select ticker, round(ey, 6) as earnings_yield, round(bm, 6) as book_to_market, round(roe, 6) as roe, round(de, 6) as debt_to_equity, case (ey is not null)::int + (bm is not null)::int + (roe is not null)::int + (de is not null)::int when 4 then 'OK' when 0 then 'No fundamentals' else 'Partial ' || ((ey is not null)::int + (bm is not null)::int + (roe is not null)::int + (de is not null)::int) || '/4' end as status from y")
def s16_fundamental_ratios(v, spark, d):
    c = X.table(spark, d, "customer")
    return S.fundamental_ratios(c.select(F.col("c_custkey").cast("string").alias("ticker"), (F.col("c_acctbal") / 100).alias("pe"), (F.col("c_acctbal") / 1000).alias("pb"), (F.col("c_nationkey") / 100).alias("roe"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") * 10.0).alias("debt_to_equity")))


@query("select user_id::varchar as owner, event_type as kind, count(*) as records, min(json_extract(props, '$.k')::bigint) as least_k from events group by 1, 2")
def s21_journal_summary(v, spark, d):
    j = as_journal(X.table(spark, d, "events"))
    return j.groupBy("owner", "kind").agg(F.count(F.lit(1)).alias("records"), F.min(F.from_json("payload", "k long")["k"]).alias("least_k"))


@query("with j as (select user_id::varchar as owner, 'events' as portfolio, event_type as kind, event_id::varchar as record, props as payload from events) select * from j where record::bigint % 2 = 1")
def k1_journal_new(v, spark, d):
    rows = as_journal(X.table(spark, d, "events")).drop("ts")
    have = rows.where(F.col("record").cast("long") % 2 == 0)
    # each key twice, with other payloads: the one that arrived first is taken
    twice = rows.withColumn("seq", F.lit(1)).union(rows.select("owner", "portfolio", "kind", "record", F.lit("late").alias("payload"), F.lit(2)))
    return sinks.journal_new(have, twice, "seq")


# --- returns and moments --------------------------------------------------------------------------


@query(sql("select ticker, session, round(ret, 6) as ret from rets", "rets"))
def r1_simple_returns(v, spark, d):
    return _rets(v)


@query(sql("select ticker, round(avg(ret) * 252, 6) as mu, round(stddev_samp(ret) * sqrt(252), 6) as vol, count(*) as n from rets group by 1", "rets"))
def r2_annual_moments(v, spark, d):
    return R.annual_moments(_rets(v))


@query(sql("select a.ticker as ticker_i, b.ticker as ticker_j, round(corr(a.ret, b.ret), 6) as value, count(*) as n from rets a join rets b using (session) group by 1, 2", "rets"))
def r4_correlation(v, spark, d):
    return R.correlation(_rets(v))


@query(sql("select ti as ticker_i, tj as ticker_j, round(value, 6) as value, n from cov", "cov"))
def r5_covariance(v, spark, d):
    return R.covariance(_rets(v))


@query(sql("select 'Equal Weight' as strategy, round(sum(w * m), 6) as ret from ew join (select ticker, avg(ret) * 252 as m from rets group by 1) using (ticker)", "ew", "rets"))
def r6_portfolio_return(v, spark, d):
    return R.portfolio_return(_ew(v), R.annual_moments(_rets(v)))


@query(sql("select 'Equal Weight' as strategy, round(sqrt(sum(a.w * b.w * value)), 6) as vol from cov join ew a on a.ticker = ti join ew b on b.ticker = tj", "ew", "cov"))
def r7_portfolio_volatility(v, spark, d):
    return R.portfolio_volatility(_ew(v), R.covariance(_rets(v)))


@query(sql("select round(avg(c), 6) as mean_corr, round(max(c), 6) as max_corr, arg_max(ti, {'c': round(c, 9), 'i': ti, 'j': tj}) as pair_i, arg_max(tj, {'c': round(c, 9), 'i': ti, 'j': tj}) as pair_j, count(*) filter (c > 0.8) as n_high, count(*) as n_pairs from (select a.ticker as ti, b.ticker as tj, corr(a.ret, b.ret) as c from rets a join rets b using (session) where a.ticker < b.ticker group by 1, 2 having count(*) >= 60)", "rets"))
def r8_correlation_summary(v, spark, d):
    return R.correlation_summary(R.correlation(_rets(v), 60))


@query(sql("select 'Equal Weight' as strategy, round(2.3263478740408408::double * 10000 * pv / sqrt(252), 6) as var_diversified, round(2.3263478740408408::double * 10000 * wv / sqrt(252), 6) as var_undiversified, round(100 * (1 - pv / wv), 6) as benefit_pct, 'ok' as status from (select sqrt(sum(a.w * b.w * value)) as pv from cov join ew a on a.ticker = ti join ew b on b.ticker = tj), (select sum(w * sqrt(value)) as wv from cov join ew on ew.ticker = ti where ti = tj)", "ew", "cov"))
def r9_diversification_var(v, spark, d):
    return R.diversification_var(_ew(v), R.covariance(_rets(v)), 10_000.0)


@query(sql("select 'Equal Weight' as strategy, session, round(ln(1 + sum(w * ret)), 6) as log_ret from ew join rets using (ticker) group by 2", "ew", "rets"))
def r10_portfolio_log_returns(v, spark, d):
    return R.portfolio_log_returns(_ew(v), _rets(v))


@query(sql("select 'Equal Weight' as strategy, ticker, round(w, 6) as w, round(s, 6) as sigma, round(c / s, 6) as contribution, round(c / (s * s), 6) as share from (select a.ticker, a.w, a.w * sum(value * b.w) as c from cov join ew a on a.ticker = ti join ew b on b.ticker = tj group by 1, 2), (select sqrt(sum(a.w * b.w * value)) as s from cov join ew a on a.ticker = ti join ew b on b.ticker = tj)", "ew", "cov"))
def r11_risk_contributions(v, spark, d):
    return R.risk_contributions(_ew(v), R.covariance(_rets(v)))


@query(sql("select 'Equal Weight' as strategy, session, round(log_ret, 6) as log_ret from (select session, ln(1 + sum(w * ret)) as log_ret from ew join rets using (ticker) group by 1) order by session desc limit 63", "ew", "rets"))
def r14_pretest_tail(v, spark, d):
    return R.portfolio_log_returns(_ew(v), _rets(v)).orderBy(F.desc("session")).limit(63)


@query(sql("""select ti as ticker_i, tj as ticker_j, round(((1 - k) * s + k * case when ti = tj then mu else 0 end) * 252, 6) as value, round(k, 6) as shrinkage
from s, (select mu, case when delta > 0 then least(beta, delta) / delta else 0 end as k from (select mu, (ss - p * mu * mu) / p as delta, bb / (p * n) as beta from (select avg(s) filter (ti = tj) as mu, count(*) filter (ti = tj) as p, sum(s * s) as ss, sum(q - s * s) as bb, max(n) as n from s)))""", "rets").replace("with complete", "with complete", 1).replace(" select ti as ticker_i", ", x as (select ticker, session, ret - avg(ret) over (partition by ticker) as x from rets), s as (select a.ticker as ti, b.ticker as tj, avg(a.x * b.x) as s, avg(a.x * b.x * a.x * b.x) as q, count(*) as n from x a join x b using (session) group by 1, 2) select ti as ticker_i", 1))
def r15_shrunk_covariance(v, spark, d):
    return R.shrunk_covariance(_rets(v))


# --- screening ------------------------------------------------------------------------------------

SIGNALS = "select ticker, case when n >= 253 then p22 / p253 - 1 when n = 252 then p22 / p252 - 1 when n >= 127 then p22 / p127 - 1 else p1 / p0 - 1 end as momentum, case when n >= 253 then '12-1' when n = 252 then '12-1 (252 obs)' when n >= 127 then '6-1' else 'available' end as momentum_window, volatility, max_drawdown, n from (select ticker, count(*) as n, max(close) filter (rn = 1) as p1, max(close) filter (rn = 22) as p22, max(close) filter (rn = 127) as p127, max(close) filter (rn = 252) as p252, max(close) filter (rn = 253) as p253, max(close) filter (up = 1) as p0, stddev_samp(ret) * sqrt(252) as volatility, min(dd) as max_drawdown from sig0 group by 1)"
SCORED = "select *, 100 * (rank() over (order by momentum) + (count(*) over (partition by momentum) - 1) / 2.0) / count(*) over () as ms, 100 - 100 * (rank() over (order by volatility) + (count(*) over (partition by volatility) - 1) / 2.0) / count(*) over () as vs, 100 * (rank() over (order by max_drawdown) + (count(*) over (partition by max_drawdown) - 1) / 2.0) / count(*) over () as ds from sig"


def _screen_sql(src: str) -> str:
    head = sql("", src).rstrip()
    sig0 = CTE["sig0"][1].format(src=src)
    return f"{head}, sig0 as ({sig0}), sig as ({SIGNALS}), sc as ({SCORED})"


@query(_screen_sql("panel") + " select ticker, round(momentum, 6) as momentum, momentum_window, round(volatility, 6) as volatility, round(max_drawdown, 6) as max_drawdown, n from sig")
def q1_price_signals(v, spark, d):
    return S.price_signals(v("panel"))


@query(_screen_sql("brand") + " select ticker, round(ms::double, 6) as momentum_score, round(vs::double, 6) as volatility_score from sc")
def q2_percentile_scores(v, spark, d):
    s = S.percentile_scores(S.price_signals(v("panel_brand")), {"momentum_score": ("momentum", False), "volatility_score": ("volatility", True)})
    return s.select("ticker", "momentum_score", "volatility_score")


@query(_screen_sql("brand") + " select ticker, round(ms::double, 6) as momentum_score, round(((vs + ds) / 2)::double, 6) as risk_score, 2 as components, round(((ms + (vs + ds) / 2) / 2)::double, 6) as quant_score, case when row_number() over (order by round(((ms + (vs + ds) / 2) / 2)::double, 9) desc, round(ms::double, 9) desc, round(((vs + ds) / 2)::double, 9) desc, ticker) <= 10 then 'Selected' else 'Candidate' end as status from sc")
def q3_factor_scores(v, spark, d):
    return S.score(S.price_signals(v("panel_brand")), ("Momentum", "Risk"), 2).select("ticker", "momentum_score", "risk_score", "components", "quant_score", "status")


@query(_screen_sql("brand") + ", r as (select ticker, ms, (vs + ds) / 2 as rs, (ms + (vs + ds) / 2) / 2 as qs from sc) select ticker, round(qs::double, 6) as quant_score, row_number() over (order by round(qs::double, 9) desc, round(ms::double, 9) desc, round(rs::double, 9) desc, ticker)::int as rank, row_number() over (order by round(qs::double, 9) desc, round(ms::double, 9) desc, round(rs::double, 9) desc, ticker) <= 10 as selected from r")
def q4_ranked_screen(v, spark, d):
    """The flagship: a ranked screen of the brand panel by momentum and risk."""
    return S.score(S.price_signals(v("panel_brand")), ("Momentum", "Risk"), 2, 10).select("ticker", "quant_score", "rank", "selected")


@query()
def q5_live_screen(v, spark, d):
    p = v("panel_brand")
    u = X.table(spark, d, "part").select(F.col("p_brand").alias("ticker"), F.col("p_brand").alias("name")).distinct()
    return S.screen(u, p, active=("Momentum", "Risk"), min_components=2).select("ticker", "rank", "selected", "status", "reason")


PIT = "past as (select decision_date || '|' || ticker as ticker, session, close from brand, dates where session < decision_date)"


@query(sql("", "brand", "dates").rstrip() + f", {PIT}, sig0 as ({CTE['sig0'][1].format(src='past')}), sig1 as ({SIGNALS}), sig as (select split_part(ticker, '|', 1)::date as decision_date, split_part(ticker, '|', 2) as ticker, momentum, volatility, max_drawdown from sig1 where n >= 252), sc as (select *, 100 * (rank() over (partition by decision_date order by momentum) + (count(*) over (partition by decision_date, momentum) - 1) / 2.0) / count(*) over (partition by decision_date) as ms, 100 - 100 * (rank() over (partition by decision_date order by volatility) + (count(*) over (partition by decision_date, volatility) - 1) / 2.0) / count(*) over (partition by decision_date) as vs, 100 * (rank() over (partition by decision_date order by max_drawdown) + (count(*) over (partition by decision_date, max_drawdown) - 1) / 2.0) / count(*) over (partition by decision_date) as ds from sig) select decision_date, ticker, round(((ms + (vs + ds) / 2) / 2)::double, 6) as quant_score, row_number() over (partition by decision_date order by round(((ms + (vs + ds) / 2) / 2)::double, 9) desc, round(ms::double, 9) desc, round(((vs + ds) / 2)::double, 9) desc, ticker)::int as rank from sc")
def q6_point_in_time_screen(v, spark, d):
    return S.screen_point_in_time(v("panel_brand"), _dates(v)).select("decision_date", "ticker", "quant_score", "rank")


@query(sql("select decision_date, count(*) as known, count(*) filter (n >= 80 and q is not null) as eligible, max(n) as max_obs, median(n)::double as median_obs, case when count(*) filter (n >= 80 and q is not null) >= 2 then 'ok' else 'fewer than 2 eligible' end as status from (select decision_date, ticker, count(*) as n from brand, dates where session < decision_date group by 1, 2) left join (select ticker, session as decision_date, 1 as q from brand) using (decision_date, ticker) group by 1", "brand", "dates"))
def q7_tradable_diagnostics(v, spark, d):
    return S.tradable_diagnostics(v("panel_brand"), _dates(v))


@query(_screen_sql("brand") + " select least(10, count(*)) as selected, count(*) as eligible, 0::bigint as excluded from sc")
def q9_coverage(v, spark, d):
    return S.coverage(S.score(S.price_signals(v("panel_brand")), ("Momentum", "Risk"), 2, 10))


# --- factor models --------------------------------------------------------------------------------


@query(sql("select ticker, round(beta, 6) as beta, round((ra - beta * rm) * 252, 6) as alpha, round(rho, 6) as correlation, round(rho * rho, 6) as r2, round(ra * 252, 6) as historical, round(beta * rm * 252, 6) as expected, n from (select ticker, regr_slope(ret, market_ret) as beta, corr(ret, market_ret) as rho, avg(ret) as ra, avg(market_ret) as rm, count(*) as n from rets join mret using (session) group by 1)", "rets", "mret"))
def f1_capm(v, spark, d):
    return FA.capm(_rets(v), _mret(v))


@query(sql("select i::int as point, round(lo + (hi - lo) * i / 100.0, 6) as beta, round(0.02 + (lo + (hi - lo) * i / 100.0) * (0.08 - 0.02), 6) as expected from (select least(0, min(b))::double as lo, greatest(1, max(b))::double as hi from (select regr_slope(ret, market_ret) as b from rets join mret using (session) group by ticker)), range(101) t(i)", "rets", "mret"))
def f4_security_market_line(v, spark, d):
    return FA.security_market_line(FA.capm(_rets(v), _mret(v)), 0.08, 0.02)


@query(sql("select strategy, round((ret - 0.02) / vol, 6) as slope, 0.02::double as start_ret, round(m * 1.08, 6) as end_vol, round(0.02 + (ret - 0.02) / vol * m * 1.08, 6) as end_ret from (select ticker as strategy, avg(ret) * 252 as ret, stddev_samp(ret) * sqrt(252) as vol from rets group by 1), (select max(v) as m from (select stddev_samp(ret) * sqrt(252) as v from rets group by ticker))", "rets"))
def f5_capital_market_line(v, spark, d):
    m = R.annual_moments(_rets(v)).select(F.col("ticker").alias("strategy"), F.col("mu").alias("ret"), "vol")
    return FA.capital_market_line(m, 0.02)


@query()
def f6_three_factor_fit(v, spark, d):
    return FA.multi_factor(FA.factor_sample(v("panel"), v("factors")))


@query()
def f7_five_factor_fit(v, spark, d):
    f = v("factors").withColumns({"rmw": F.sin(F.datediff("session", F.lit("1992-01-06")) / 7.0) / 100, "cma": F.cos(F.datediff("session", F.lit("1992-01-06")) / 3.0) / 100})
    return FA.multi_factor(FA.factor_sample(v("panel"), f), ("mkt_rf", "smb", "hml", "rmw", "cma"))


@query(sql("select session, decision_date as signal from market, dates where session <= decision_date - interval 2 month", "market", "dates"))
def f8_publication_lag(v, spark, d):
    return FA.publication_lag(v("market").select("session"), _dates(v).withColumnRenamed("decision_date", "signal"))


@query()
def f11_factor_covariance(v, spark, d):
    sample = FA.factor_sample(v("panel"), v("factors"))
    return FA.factor_covariance(FA.multi_factor(sample), v("factors"))


@query()
def f12_factors_to_eur(v, spark, d):
    rates = v("market").select("session", F.lit(2.0).alias("rate"))
    return FA.factors_to_eur(v("factors"), v("fx"), rates)


@query("with o as (select cast(date_trunc('week', o_orderdate) as date) as session, avg(o_totalprice) as v from orders group by 1), f as (select session, v / first_value(v) over (order by session) as fx from o), m as (select cast(date_trunc('week', l_shipdate) as date) as session, avg(l_extendedprice) as close from lineitem group by 1) select m.session, round(close, 6) as close, round(case when m.session - f.session <= 21 then fx end, 6) as fx from m asof left join f on m.session >= f.session")
def f14_fx_as_of(v, spark, d):
    return FA.as_of(v("market"), v("fx"), "session", "fx", 21)


@query()
def f17_attribution(v, spark, d):
    nav = _curve(v)
    e = B.sessions(v("panel")).where(F.col("no") % 20 == 0).select(F.lit("Equal Weight").alias("strategy"), "session", F.lit(1.0).alias("mkt_rf"), F.lit(0.2).alias("smb"), F.lit(-0.1).alias("hml"))
    return FA.attribution(nav, v("factors"), e, 10_000.0)


# --- construction ---------------------------------------------------------------------------------


@query()
def o1_o8_model_weights(v, spark, d):
    r = _rets(v)
    return C.optimise(R.annual_moments(r), R.covariance(r), cap=0.5)


@query()
def o9_efficient_frontier(v, spark, d):
    r = _rets(v)
    return C.efficient_frontier(R.annual_moments(r), R.covariance(r), 20)


@query(sql("select 'Equal Weight' as strategy, ticker, round(w, 6) as w from ew", "ew"))
def o10_equal_weight(v, spark, d):
    return _ew(v)


@query(sql("select 'Equal Weight' as strategy, ticker, round(w, 6) as w, round(w * 1000000, 6) as amount, round(price, 6) as price, floor(w * 1000000 / price) as quantity, round(floor(w * 1000000 / price) * price, 6) as invested, round(1000000 - sum(floor(w * 1000000 / price) * price) over (), 6) as residual from ew join (select ticker, arg_max(close, session) as price from panel group by 1) using (ticker)", "ew"))
def o11_allocation(v, spark, d):
    return C.allocation(_ew(v), v("panel"), 1_000_000.0)


@query(sql("select count(*) as n, case when count(*) < 2 then 'fewer than 2 assets' when 0.1 * count(*) < 1 then 'cap is below 1 / N' else 'ok' end as status from ew", "ew"))
def o12_feasible(v, spark, d):
    return C.feasible(_ew(v), 0.1)


# --- backtests ------------------------------------------------------------------------------------


@query()
def b1_walk_forward_weights(v, spark, d):
    return B.walk_forward_weights(R.complete_sessions(v("panel")), 104, 52, cap=0.5)


GROSS = sql("", "complete").rstrip() + """, num as (select session, (row_number() over (order by session) - 1)::int as no from (select distinct session from complete)), nn as (select count(*)::int as n from num),
plan as (select t::int as t, least(t + 26, n - 1)::int as until from nn, range(52, 100000, 26) r(t) where t <= n - 2),
hold as (select t, until, c.ticker, no, session, close from complete c join num using (session) join plan on no >= t and no <= until),
g as (select t, until, no, session, avg(growth) as g from (select *, close / first_value(close) over (partition by t, ticker order by no) as growth from hold) where no > t group by 1, 2, 3, 4),
base as (select t, coalesce(product(g) over (order by t rows between unbounded preceding and 1 preceding), 1) as b from g where no = until),
nav as (select session, b * g * 10000 as nav from g join base using (t) union all select session, 10000 from num where no = 52)"""


@query(GROSS + " select 'Equal Weight' as strategy, session, round(nav, 6) as nav from nav")
def b4_gross_nav_equal_weight(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.gross_nav(B.walk_forward_weights(p, 52, 26, ("Equal Weight",)), p, 10_000.0)


@query()
def b5_net_nav(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.net_nav(B.walk_forward_weights(p, 104, 52, cap=0.5), p, 10_000.0)


PERF = "select 'Equal Weight' as strategy, round(f / 10000 - 1, 6) as total_return, round(pow(f / 10000, 365.25 / d) - 1, 6) as cagr, round(s * sqrt(252), 6) as volatility, round(m * 252 / (s * sqrt(252)), 6) as sharpe, round(m * 252 / sqrt(lp * 252), 6) as sortino, round(dd, 6) as max_drawdown, n from (select arg_max(nav, session) as f, max(session) - min(session) as d, avg(r) as m, stddev_samp(r) as s, avg(least(r, 0) * least(r, 0)) as lp, min(nav / pk - 1) as dd, count(*) as n from (select session, nav, nav / coalesce(lag(nav) over (order by session), 10000) - 1 as r, greatest(max(nav) over (order by session), 10000) as pk from curve))"


@query(sql(PERF, "curve"))
def b8_performance(v, spark, d):
    return B.performance(_curve(v), 10_000.0)


@query()
def b10_fixed_horizon(v, spark, d):
    return B.fixed_horizon(R.complete_sessions(v("panel")), 104, 52, cap=0.5)


@query(sql("select 'Benchmark' as strategy, session, round(close / first_value(close) over (order by session) * 10000, 6) as nav from market", "market"))
def b12_benchmark_curve(v, spark, d):
    return B.benchmark_curve(v("market"), 10_000.0)


@query(sql("select 'Equal Weight' as strategy, session, round(nav / greatest(max(nav) over (order by session), 10000) - 1, 6) as drawdown from curve", "curve"))
def b13_drawdowns(v, spark, d):
    return B.drawdowns(_curve(v), 10_000.0)


@query(sql("select 'x' as strategy, t, round(coalesce(sum(abs(w - o)) / 2, 1), 6) as turnover from (select t, w, lag(w) over (partition by ticker order by t) as o from (select a.session as t, b.ticker, coalesce(p.close / sum(p.close) over (partition by a.session), 0) as w from (select distinct session from panel) a cross join (select distinct ticker from panel) b left join panel p on p.session = a.session and p.ticker = b.ticker)) group by t", "panel"))
def b14_turnover(v, spark, d):
    from pyspark.sql import Window as W

    w = v("panel").select(F.lit("x").alias("strategy"), F.col("session").alias("t"), "ticker", (F.col("close") / F.sum("close").over(W.partitionBy("session"))).alias("w"))
    return B.turnover(w)


@query(sql("select 'x' as strategy, session as t, count(*) as active, round(max(w), 6) as max_weight, round(sum(w) filter (rk <= 3), 6) as top3, round(sum(w * w), 6) as hhi from (select *, row_number() over (partition by session order by w desc, ticker) as rk from (select session, ticker, close / sum(close) over (partition by session) as w from panel)) group by 2", "panel"))
def b16_concentration(v, spark, d):
    from pyspark.sql import Window as W

    return B.concentration(v("panel").select(F.lit("x").alias("strategy"), F.col("session").alias("t"), "ticker", (F.col("close") / F.sum("close").over(W.partitionBy("session"))).alias("w")))


@query(sql("select ticker as strategy, session, round(close / first_value(close) over (partition by ticker order by session) * 10000, 6) as nav from complete", "complete"))
def b18_matched_growth(v, spark, d):
    return B.matched_growth(v("panel").select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav")), 10_000.0)


@query(sql("select strategy, round(total_return, 6) as total_return, row_number() over (order by round(total_return, 9) desc, strategy)::int as rank from (select ticker as strategy, arg_max(close, session) / 10000 - 1 as total_return from panel group by 1)", "panel"))
def b20_final_ranking(v, spark, d):
    return B.final_ranking(B.performance(v("panel").select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav")), 10_000.0))


@query(sql("select strategy, session, round(s0 / (s0 - s), 6) as part, round(n0 + s0 / (s0 - s) * (nav - n0), 6) as level from (select p.ticker as strategy, session, p.close as nav, p.close - m.close as s, lag(p.close - m.close) over (partition by p.ticker order by session) as s0, lag(p.close) over (partition by p.ticker order by session) as n0 from panel p join market m using (session)) where s0 * s < 0", "panel", "market"))
def b21_crossings(v, spark, d):
    return B.crossings(v("panel").select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav")), v("market").withColumnRenamed("close", "nav"))


@query("select o_custkey as portfolio, round(sum(greatest(3.0, 0.0005 * l_extendedprice) + l_extendedprice * 0.001), 6) as cost, count(*) as orders, round(sum(l_extendedprice), 6) as traded from lineitem join orders on l_orderkey = o_orderkey where l_extendedprice > 1e-8 group by 1")
def b24_order_costs(v, spark, d):
    li, o = X.table(spark, d, "lineitem"), X.table(spark, d, "orders")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    orders = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("portfolio"), (sign * F.col("l_extendedprice")).alias("notional"))
    return B.order_costs(orders, B.PRESETS["Base"])


@query()
def b26_cost_overlay(v, spark, d):
    p = R.complete_sessions(v("panel"))
    w = B.walk_forward_weights(p, 52, 26, ("Equal Weight",))
    costs = B.net_nav(w, p, 10_000.0).where("cost > 0")
    return B.cost_overlay(B.gross_nav(w, p, 10_000.0), costs)


@query()
def b28_robustness(v, spark, d):
    p, m = v("panel"), v("market")
    win = RB.calendar(p, "1993-01-04", "1998-01-04", 1, 12, 6, *WEEKLY)
    return RB.roll_up(RB.run(p, win, RB.window_weights(p, win, cap=0.5), m))


@query()
def b30_drift_turnover(v, spark, d):
    p = R.complete_sessions(v("panel"))
    return B.drift_turnover(B.walk_forward_weights(p, 104, 52, cap=0.5), p)


# --- volatility and signals -----------------------------------------------------------------------


@query(sql("", "logr").rstrip().replace("with ", "with recursive ", 1) + ", k as (select *, row_number() over (partition by ticker order by session) - 1 as k from logr), v0 as (select ticker, var_samp(ret) as v from k where k < 21 group by 1), e as (select k.ticker, session, ret, k, v as variance from k join v0 using (ticker) where k = 0 union all select k.ticker, k.session, k.ret, k.k, 0.94::double * e.variance + 0.06::double * e.ret * e.ret from e join k on k.ticker = e.ticker and k.k = e.k + 1) select ticker, session, round(ret, 6) as ret, k::int as k, round(variance, 6) as variance from e")
def v1_ewma_variance(v, spark, d):
    return V.ewma_variance(V.log_returns(v("panel"))).withColumn("k", F.col("k").cast("int"))


@query(sql("select ticker, session, round(case when count(ret) over w = 63 then stddev_samp(ret) over w * sqrt(252) end, 6) as vol from logr window w as (partition by ticker order by session rows between 62 preceding and current row)", "logr"))
def v2_rolling_volatility(v, spark, d):
    return V.rolling_volatility(V.log_returns(v("panel")))


@query()
def v2_garch_forecasts(v, spark, d):
    return V.garch_forecast(V.log_returns(v("panel")), 4)


@query()
def v3_volatility_summary(v, spark, d):
    return V.summary(v("panel"))


@query(sql("", "logr").rstrip() + ", k as (select *, row_number() over (partition by ticker order by session) - 1 as k, count(*) over (partition by ticker) as n from logr), x as (select ticker, k as origin, n, var_samp(ret) over (partition by ticker order by k rows between 63 preceding and 1 preceding) as f, avg(ret * ret) over (partition by ticker order by k rows between current row and 12 following) as rv from k) select ticker, round(avg(ln(greatest(f, 1e-12)) + rv / greatest(f, 1e-12)), 6) as qlike, round(avg(pow(f - rv, 2)), 6) as mse, count(*) as n from x where origin >= 104 and origin <= n - 13 and (origin - 104) % 13 = 0 group by 1")
def v4_rolling_validation(v, spark, d):
    val = V.validation(V.log_returns(v("panel")), 104, 13, 13)
    return V.loss(val)


@query()
def v5_model_comparison(v, spark, d):
    """All five models at the same origins; training rows are enough for GARCH fits."""
    return V.loss(V.validation(V.log_returns(v("panel")), 156, 13, 13, families=V.FAMILIES))


@query(sql("select ticker, session, round(vol * 100, 6) as vol_pct, case when vol * 100 >= 30 then 'CRITICAL' when vol * 100 >= 25 then 'HIGH' when vol * 100 >= 20 then 'ELEVATED' else 'NORMAL' end as level, round(least(100, 100 * 15.0 / (vol * 100)), 6) as suggested_pct, round(100 - least(100, 100 * 15.0 / (vol * 100)), 6) as gap_pp, case when 100 - least(100, 100 * 15.0 / (vol * 100)) >= 10 then 'REBALANCE REVIEW' when 100 - least(100, 100 * 15.0 / (vol * 100)) >= 5 then 'MONITOR / REVIEW' else 'NO CHANGE INDICATED' end as action from (select ticker, session, case when count(ret) over w = 63 then stddev_samp(ret) over w * sqrt(52) end as vol from logr window w as (partition by ticker order by session rows between 62 preceding and current row)) where vol is not null", "logr"))
def v9_risk_alerts(v, spark, d):
    vol = V.rolling_volatility(V.log_returns(v("panel")), 63, 52).where("vol is not null").withColumn("vol_pct", F.col("vol") * 100)
    a = V.alert(F.col("vol_pct"), F.lit(15.0), F.lit(100.0))
    return vol.select("ticker", "session", "vol_pct", *(c.alias(n) for n, c in a.items()))


def _overlay(v):
    nav = v("panel").select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav"))
    vol = V.rolling_volatility(V.log_returns(v("panel")), 21, 52).select(F.col("ticker").alias("strategy"), "session", (F.col("vol") * 100).alias("vol_pct"))
    return V.exposure_overlay(nav, vol)


@query()
def v10_exposure_overlay(v, spark, d):
    return _overlay(v)


@query()
def v11_overlay_deltas(v, spark, d):
    s = V.overlay_summary(_overlay(v), 10_000.0)
    return V.overlay_deltas(s, "NO")


@query(sql("", "logr").rstrip() + ", r as (select ticker, var_samp(ret) as v from (select *, row_number() over (partition by ticker order by session desc) as k from logr) where k <= 63 group by 1) select ticker, 'Rolling' as model, round(sqrt(v * 252) * 100, 6) as vol_pct from r")
def v8_forecast_summary(v, spark, d):
    return V.forecast_summary(V.forecast_path(V.log_returns(v("panel"))))


@query()
def v8_forecast_summary_all(v, spark, d):
    return V.forecast_summary(V.forecast_path(V.log_returns(v("panel")), families=V.FAMILIES))


@query()
def v6_filtered_volatility(v, spark, d):
    return V.filtered_volatility(V.log_returns(v("panel")))


@query()
def t6_conditional_forecast(v, spark, d):
    return V.value_at_risk(V.conditional_forecast(_rets(v)))


IND = "select ticker, session, round(close, 6) as close, round(case when count(*) over w50 = 50 then avg(close) over w50 end, 6) as sma50, round(case when count(*) over w200 = 200 then avg(close) over w200 end, 6) as sma200, round(close / lag(close, 63) over w - 1, 6) as momentum63, round(case when count(*) over w20 = 20 then (close - avg(close) over w20) / stddev_pop(close) over w20 end, 6) as zscore, round(close / max(close) over (partition by ticker order by session) - 1, 6) as drawdown from panel window w as (partition by ticker order by session), w20 as (partition by ticker order by session rows 19 preceding), w50 as (partition by ticker order by session rows 49 preceding), w200 as (partition by ticker order by session rows 199 preceding)"


@query(sql(IND, "panel"))
def t1_indicators(v, spark, d):
    return SG.indicators(v("panel")).select("ticker", "session", "close", "sma50", "sma200", "momentum63", "zscore", "drawdown")


@query(sql("", "panel").rstrip().replace("with ", "with recursive ", 1) + ", k as (select *, row_number() over (partition by ticker order by session) as k from panel), e as (select ticker, session, k, close as e from k where k = 1 union all select k.ticker, k.session, k.k, e.e + (2.0::double / 21) * (k.close - e.e) from e join k on k.ticker = e.ticker and k.k = e.k + 1) select ticker, session, round(case when k >= 20 then e end, 6) as ema20 from e")
def t1_ema20(v, spark, d):
    return SG.indicators(v("panel")).select("ticker", "session", "ema20")


@query()
def t1_rsi14(v, spark, d):
    return SG.indicators(v("panel")).select("ticker", "session", "rsi14")


@query()
def t2_trend_signal(v, spark, d):
    return SG.trend_signal(SG.indicators(v("panel")))


@query()
def t3_entry_exit(v, spark, d):
    return SG.entry_exit(SG.indicators(v("panel")))


@query(sql("select 'p' as portfolio, ticker, floor(greatest(w * 1000000 - 2, 0) / price) as quantity, round(price, 6) as price, 2.0::double as fee, round(1000000 - sum(floor(greatest(w * 1000000 - 2, 0) / price) * price + 2) over (), 6) as cash from ew join (select ticker, arg_max(close, session) as price from panel group by 1) using (ticker)", "ew"))
def t4_paper_orders(v, spark, d):
    last = v("panel").groupBy("ticker").agg(F.max_by("close", "session").alias("price"))
    return SG.paper_orders(_ew(v).select(F.lit("p").alias("portfolio"), "ticker", "w"), last, 1_000_000.0, 2.0)


@query(sql("", "rets").rstrip() + ", h as (select ticker, session, (ret < -0.2)::int as hit, lag((ret < -0.2)::int) over (partition by ticker order by session) as prev from rets) select ticker as name, count(*) as n, sum(hit)::bigint as hits, count(*) filter (prev = 0 and hit = 1) as n01, count(*) filter (prev = 1 and hit = 1) as n11 from h group by 1")
def t8_hit_counts(v, spark, d):
    from pyspark.sql import Window as W

    h = _rets(v).withColumn("hit", (F.col("ret") < -0.2).cast("int")).withColumn("prev", F.lag("hit").over(W.partitionBy("ticker").orderBy("session")))
    return h.groupBy(F.col("ticker").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.count_if(F.expr("prev = 0 and hit = 1")).alias("n01"), F.count_if(F.expr("prev = 1 and hit = 1")).alias("n11"))


@query()
def t8_coverage_tests(v, spark, d):
    from pyspark.sql import Window as W

    h = _rets(v).select(F.col("ticker").alias("name"), F.row_number().over(W.partitionBy("ticker").orderBy("session")).alias("k"), (F.col("ret") < -0.2).cast("int").alias("hit"))
    return SG.coverage_tests(h, 0.9)


@query(sql("select origin, session, round(0.1::double, 6) as var, 0.15::double as es, round(ret, 6) as ret, -ret > 0.1 as breach, round(case when -ret > 0.1 then -ret - 0.15 end, 6) as es_gap from (select d.decision_date as origin, m.session, m.market_ret as ret, row_number() over (partition by d.decision_date order by m.session) as rn from dates d join mret m on m.session > d.decision_date) where rn = 1", "dates", "mret"))
def t9_breach_matching(v, spark, d):
    f = _dates(v).select(F.col("decision_date").alias("origin"), F.lit(0.1).alias("var"), F.lit(0.15).alias("es"))
    return SG.breach_matching(f, _mret(v).withColumnRenamed("market_ret", "ret"))


@query(sql("select ticker, session, island::int as island, round(100 * product(1 + ret) over (partition by ticker, island order by session), 6) as index from (select *, sum(g) over (partition by ticker order by session) as island from (select *, coalesce((session - lag(session) over (partition by ticker order by session) > 7)::int, 1) as g from rets))", "rets"))
def t10_synthetic_index(v, spark, d):
    return SG.synthetic_index(_rets(v), 7).withColumn("island", F.col("island").cast("int"))


@query(oracles.T12)
def t12_positions(v, spark, d):
    li = X.table(spark, d, "lineitem")
    o = li.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(1.0).alias("fee"))
    last = v("panel").groupBy("ticker").agg(F.max_by("close", "session").alias("price"))
    out = SG.positions(o, last)
    return out.withColumns({c: F.round(c, 2) for c in ("value", "cost_basis", "profit")})  # sums of 11 digits before the point


def _quotes(v):
    return v("panel").select("ticker", "session", "close", F.col("close").alias("adj_close"), F.lit(0.0).alias("split"))


@query()
def t13_historical_activation(v, spark, d):
    days = v("market").select("session")
    return A.reconstruct(_quotes(v), days, "1996-01-10", 2, "Minimum Volatility", 1_000_000.0, 2.0, cap=0.5)


@query(sql("", "rets").rstrip() + ", days as (select session, lead(session) over (order by session) as nxt from (select distinct session from panel)), r as (select ticker, session as origin, lead(session) over (partition by ticker order by session) as valid, row_number() over (partition by ticker order by session) as n from rets) select ticker, origin, valid from r join days on session = origin where n >= 126 and valid = nxt and valid <= date '1996-01-01' and day(origin) <> 1")
def t15_forecast_origins(v, spark, d):
    r = _rets(v)
    have = r.where(F.dayofmonth("session") == 1).select("ticker", F.col("session").alias("origin"))
    return A.forecast_origins(r, v("panel").select("session").distinct(), "1996-01-01", have)


@query()
def t15_historical_forecasts(v, spark, d):
    p = stored(v("panel"), "prices")  # lineitem is read once
    r, days = R.simple_returns(p), p.select("session").distinct()
    last = days.agg(F.max("session").alias("last")).first()["last"]  # one row
    return A.historical_forecasts(r, A.forecast_origins(r, days, last, r.limit(0).select("ticker", F.col("session").alias("origin"))))


# --- scenarios and learning -----------------------------------------------------------------------


def _curves(v):
    return v("panel").select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav"))


@query(sql("select strategy, k::int as k, session, round(ret, 6) as ret from (select p.ticker as strategy, session, d.k, case when lag(d.k) over (partition by p.ticker order by d.k) = d.k - 1 then close / lag(close) over (partition by p.ticker order by d.k) - 1 end as ret, p.ticker from panel p join (select session, row_number() over (order by session) as k from (select distinct session from panel)) d using (session)) where ret is not null qualify count(*) over (partition by k) = (select count(distinct ticker) from panel)", "panel"))
def m2_aligned_returns(v, spark, d):
    return M.aligned_returns(_curves(v))


@query()
def m3_block_bootstrap(v, spark, d):
    h = M.aligned_returns(_curves(v))
    return M.metrics(M.simulate(h), 10_000.0)


@query()
def m3_gaussian(v, spark, d):
    h = M.aligned_returns(_curves(v))
    return M.metrics(M.simulate_gaussian(h), 10_000.0)


@query("select l_returnflag || l_linestatus as strategy, round(quantile_cont(l_extendedprice, 0.05), 6) as p5, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.95), 6) as p95 from lineitem group by 1")
def m4_exact_percentiles(v, spark, d):
    p = X.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("strategy"), F.lit(1).alias("day"), F.col("l_extendedprice").alias("value"))
    return M.fan(p).select("strategy", "p5", "p50", "p95")


@query(sql("select strategy, round(sum(ret * w) / sum(w), 6) as tail_mean from (select ticker as strategy, ret, greatest(0, least(1, count(*) over (partition by ticker) * 0.05 - (row_number() over (partition by ticker order by ret) - 1))) as w from rets) group by 1", "rets"))
def m5_tail_mean(v, spark, d):
    return M.tail_mean(_rets(v).select(F.col("ticker").alias("strategy"), F.col("ret").alias("pnl")), 0.05)


@query(sql("select p.ticker, p.session, (row_number() over w - 1)::int as k, round(close / lag(close, 21) over w - 1, 6) as mom21, round(close / lag(close, 63) over w - 1, 6) as mom63, round(case when count(*) over w63 = 63 then close / max(close) over w63 - 1 end, 6) as dd63, round(lead(close, 21) over w / close - 1, 6) as target, round(mm, 6) as market_mom63 from panel p left join (select session, close / lag(close, 63) over (order by session) - 1 as mm from market) using (session) window w as (partition by p.ticker order by p.session), w63 as (partition by p.ticker order by p.session rows 62 preceding)", "panel", "market"))
def l1_features(v, spark, d):
    return L.features(v("panel"), v("market")).select("ticker", "session", F.col("k").cast("int").alias("k"), "mom21", "mom63", "dd63", "target", "market_mom63")


@query()
def l2_elastic_net(v, spark, d):
    return L.forecast(L.split(L.features(v("panel"), v("market"), 4), 52, 4))


@query()
def l2_gradient_boosting(v, spark, d):
    return L.accuracy(L.forecast(L.split(L.features(v("panel"), v("market"), 4), 52, 4), "GradientBoosting"))


@query(sql("with_x", "panel").replace("with_x", "select round(avg(abs(f - t)), 6) as mae, round(sqrt(avg((f - t) * (f - t))), 6) as rmse, count(*) as n, (select round(avg(ic), 6) from (select session, corr(rf, rt) as ic, count(*) as c from (select session, rank() over (partition by session order by f) + (count(*) over (partition by session, f) - 1) / 2.0 as rf, rank() over (partition by session order by t) + (count(*) over (partition by session, t) - 1) / 2.0 as rt from y) group by 1) where c >= 3) as rank_ic from y").replace("as close from lineitem group by 1, 2)", "as close from lineitem group by 1, 2), y as (select * from (select ticker, session, close / lag(close) over (partition by ticker order by session) - 1 as f, lead(close) over (partition by ticker order by session) / close - 1 as t from panel) where f is not null and t is not null)"))
def l4_accuracy(v, spark, d):
    from pyspark.sql import Window as W

    by = W.partitionBy("ticker").orderBy("session")
    f = v("panel").select("ticker", "session", (F.col("close") / F.lag("close").over(by) - 1).alias("forecast"), (F.lead("close").over(by) / F.col("close") - 1).alias("target"))
    return L.accuracy(f)


@query()
def l5_ml_walk_forward(v, spark, d):
    return L.walk_forward(R.complete_sessions(v("panel")), v("market"), 4, 26, 51, 200)


@query(sql("select strategy, round(last / 10000 - 1, 6) as total_return, round(pow(last / 10000, 252.0 / n) - 1, 6) as cagr, round(s * sqrt(252), 6) as volatility, round(m * 252 / (s * sqrt(252)), 6) as sharpe, round(dd, 6) as max_drawdown from (select ticker as strategy, arg_max(close, session) as last, count(r) as n, avg(r) as m, stddev_samp(r) as s, min(dd) as dd from (select ticker, session, close, close / lag(close) over (partition by ticker order by session) - 1 as r, close / max(close) over (partition by ticker order by session) - 1 as dd from panel) group by 1)", "panel"))
def l8_comparison_metrics(v, spark, d):
    return L.comparison_metrics(v("panel").select(F.col("ticker").alias("strategy"), "session", (F.col("close") / 10000).alias("nav")))


@query()
def m6_sensitivity(v, spark, d):
    return M.sensitivity(M.aligned_returns(_curves(v)), 1000, M.YEAR, 10_000.0)


@query(sql("select ticker as strategy, round(least(1, arg_min(close, session) / 50000), 6) as multiplier from panel group by 1", "panel"))
def m2_entry_multipliers(v, spark, d):
    return M.entry_multipliers(_curves(v), 50_000.0)


@query(sql("select ticker, round(x, 6) as market_excess, round(a + b * x, 6) as fitted from (select ticker, unnest([lo, hi]) as x, a, b from (select ticker, regr_slope(ret, market_ret) as b, regr_intercept(ret, market_ret) as a, min(market_ret) as lo, max(market_ret) as hi from rets join mret using (session) group by 1))", "rets", "mret"))
def f3_capm_line(v, spark, d):
    return FA.capm_line(_rets(v), _mret(v))


@query(sql("select session, round(close, 6) as close from market where session >= date '1994-01-03' - 10 and session < date '1996-01-01'", "market"))
def f13_window_factors(v, spark, d):
    return FA.window_factors(v("market"), "1994-01-03", "1996-01-01")


@query(sql("", "panel").rstrip() + ", o as (select cast(date_trunc('week', o_orderdate) as date) as session, avg(o_totalprice) as v from orders group by 1), f as (select session, v / first_value(v) over (order by session) as fx from o) select ticker, p.session, round(close * fx, 6) as close from panel p asof join f on p.session >= f.session")
def f14_prices_in_usd(v, spark, d):
    return FA.prices_in_usd(v("panel"), v("fx"))


@query()
def f15_estimate_in_eur(v, spark, d):
    return FA.estimate_in_eur(v("panel"), v("fx"), v("factors"))


@query()
def f16_factor_portfolio(v, spark, d):
    return FA.factor_portfolio(v("panel"), v("factors"), cap=0.5)


def _plan(v):
    p = R.complete_sessions(v("panel"))
    return p, B.walk_forward_weights(p, 104, 52, cap=0.5)


@query()
def b6_ex_ante_kpis(v, spark, d):
    p, w = _plan(v)
    num = B.sessions(p)
    return B.ex_ante_kpis(w, *B.window_moments(p, num, B.schedule(num, 104, 52), 104))


@query()
def b7_exposures(v, spark, d):
    fit = FA.multi_factor(FA.factor_sample(v("panel"), v("factors"))).select("ticker", "beta_mkt_rf", "beta_smb", "beta_hml")
    return B.exposures(_plan(v)[1], fit, ("beta_mkt_rf", "beta_smb", "beta_hml"))


@query()
def b11_standard_engine(v, spark, d):
    return B.standard_engine(R.complete_sessions(v("panel")), v("market"), 10_000.0, 104, 52, cap=0.5)


@query()
def b15_rebalancing_history(v, spark, d):
    h = B.history_table(_plan(v)[1])
    return h.select("strategy", "t", "turnover", F.size("holdings").alias("active"), F.to_json("holdings").alias("holdings"))


@query()
def b17_buy_and_hold(v, spark, d):
    p, w = _plan(v)
    return B.buy_and_hold(w, p, 10_000.0)


@query(sql("select ticker as strategy, session, round(close, 6) as nav from panel where ticker <> 'NO'", "panel"))
def b19_clean_curves(v, spark, d):
    c = v("panel").withColumn("ingest_ord", F.lit(1))
    bad = c.where("ticker = 'NO'").withColumn("close", F.when(F.month("session") == 1, -1.0).otherwise(F.col("close")))
    twice = c.where("ticker <> 'NO'").select("ticker", "session", (F.col("close") * 2).alias("close"), F.lit(0).alias("ingest_ord"))
    return B.clean_curve(c.where("ticker <> 'NO'").union(bad).union(twice).select(F.col("ticker").alias("strategy"), "session", F.col("close").alias("nav"), "ingest_ord"))


@query(sql("select ticker as strategy, session, round(close, 6) as nav from panel qualify row_number() over (partition by ticker order by session desc) <= 42", "panel"))
def b23_recent_tail(v, spark, d):
    return B.recent(_curves(v), 42)


@query()
def b29_paired_differences(v, spark, d):
    p, m = v("panel"), v("market")
    win = RB.calendar(p, "1993-01-04", "1998-01-04", 1, 12, 6, *WEEKLY)
    return RB.paired(RB.run(p, win, RB.window_weights(p, win, cap=0.5), m))


@query()
def b28_calendar(v, spark, d):
    return RB.calendar(v("panel"), "1993-01-04", "1998-01-04", 1, 12, 6)


@query(sql("select ticker, session, round(close / 100, 6) as index, session >= date '1995-01-02' as live from panel", "panel"))
def t11_warm_up(v, spark, d):
    p = v("panel")
    live = p.where("session >= date '1995-01-02'").select("ticker", "session", (F.col("close") / 100).alias("index"))
    return SG.warm_up(p, live)


@query(sql("select ticker, round(0.7 * avg(ret) * 252 + 0.3 * median(ret) * 252, 6) as mu from rets group by 1", "rets"))
def l7_hybrid(v, spark, d):
    r = _rets(v)
    return L.hybrid(R.annual_moments(r), r.groupBy("ticker").agg((F.expr("percentile(ret, 0.5)") * 252).alias("mu")), 0.3)


ORACLES.update(oracles.ORACLES)

from quantloom.plans import catalog_more, catalog_mechanisms  # noqa: E402, F401, I001  (they register their queries here)
