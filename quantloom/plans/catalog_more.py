"""Further queries: file sources and sinks by round trips, factor-model backtests, and operators under equal weights,
for which plans/oracles.py has SQL. Registered in catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.operators import activation as A
from quantloom.operators import backtest as B
from quantloom.operators import factors as FA
from quantloom.operators import learning as L
from quantloom.operators import returns as R
from quantloom.operators import robustness as RB
from quantloom.operators import screening as S
from quantloom.plans import oracles as O
from quantloom.plans.catalog import WEEKLY, _curves, _dates, _rets, query, sql
from quantloom.sources import files, sinks, tables as X
from quantloom.sources.scratch import folder as scratch

EQUAL = ("Equal Weight",)


def _lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


# --- files ----------------------------------------------------------------------------------------


@query("select n_name as market, 'Stock' as asset_type, 'name, \"of\" ' || s_name as name, s_name as ticker, 'EUR' as currency from supplier join nation on s_nationkey = n_nationkey")
def s1_catalog_csv(v, spark, d):
    """Instruments written as CSV with a header in every file, and one more header row among them, then read."""
    s, n = X.table(spark, d, "supplier"), X.table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("market"), F.lit("Stock").alias("asset_type"), F.concat(F.lit('name, "of" '), "s_name").alias("name"), F.col("s_name").alias("ticker"), F.lit("EUR").alias("currency"))
    stray = spark.createDataFrame([tuple(rows.columns)], rows.schema)
    path = scratch(spark, "catalog")
    rows.unionByName(stray).write.option("header", True).option("escape", '"').csv(path)
    return files.catalog(spark, path)


def _archive(v, spark, names: tuple[str, ...], factors: DataFrame) -> DataFrame:
    day = factors.select(F.concat_ws(",", F.date_format("session", "yyyyMMdd"), *((F.col(n) * 100).cast("string") for n in names)).alias("value"))
    noise = spark.createDataFrame([("This file was created by hand",), (",Mkt-RF,SMB,HML,RF",), ("19920101,-99.99,1,1,1,1,1",), ("19920102,abc,1,1,1,1,1",), ("1992,1,1,1,1",), ("",)], "value string")
    return files.factor_archive(spark, _lines(day.union(day.limit(3)).union(noise), scratch(spark, "archive")), names)


@query(f"with {O.FACTORS} select session, {O.rounded('mkt_rf', 'smb', 'hml', 'rf')} from factors where greatest(abs(mkt_rf), abs(smb), abs(hml)) < 0.5")
def s13_factor_archive(v, spark, d):
    return _archive(v, spark, ("mkt_rf", "smb", "hml", "rf"), v("factors"))


def _five(v):
    day = F.datediff("session", F.lit("1992-01-06"))
    return v("factors").withColumns({"rmw": F.sin(day / 7.0) / 100, "cma": F.cos(day / 3.0) / 100})


@query(f"with {O.FACTORS}, {O.FACTORS5} select session, {O.rounded('mkt_rf', 'smb', 'hml', 'rmw', 'cma', 'rf')} from factors5 where greatest(abs(mkt_rf), abs(smb), abs(hml)) < 0.5")
def s14_five_factor_archive(v, spark, d):
    return _archive(v, spark, ("mkt_rf", "smb", "hml", "rmw", "cma", "rf"), _five(v))


@query(f"with {O.FX} select session, round(fx, 6) as rate from fx")
def s15_overnight_rates(v, spark, d):
    path = scratch(spark, "rates")
    fx = v("fx").select(F.col("session").cast("string").alias("TIME_PERIOD"), F.col("fx").cast("string").alias("OBS_VALUE"), F.lit("x").alias("OTHER"))
    fx.union(fx.limit(2)).union(spark.createDataFrame([("1999-01-01", "", "x")], fx.schema)).write.option("header", True).csv(path)
    return files.overnight_rates(spark, path)


@query("select o_orderkey::varchar as ticker, o_orderdate::date as published_at, round(o_totalprice, 6) as annual_earnings, round(o_totalprice * 2, 6) as equity, case when o_orderkey % 3 > 0 then 100.0::double end as shares, 1.0::double as debt from orders")
def s17_pit_fundamentals(v, spark, d):
    path, o = scratch(spark, "fundamentals"), X.table(spark, d, "orders")
    o.select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("ticker"), F.col("o_orderdate").cast("date").alias("decision_date"), F.col("o_orderdate").cast("date").alias("published_at"), F.col("o_totalprice").alias("annual_earnings"), (F.col("o_totalprice") * 2).alias("equity"), F.when(F.col("o_orderkey") % 3 > 0, "100").otherwise("n/a").alias("shares"), F.lit(1.0).alias("debt")).write.option("header", True).csv(path)
    return files.pit_fundamentals(spark, path)


@query("select o_custkey::varchar as entity, round(o_totalprice, 6) as val, o_orderdate::date + 400 as filed, o_orderdate::date + 365 as \"end\", '10-K' as form, o_orderkey::varchar as accn from orders join (select o_custkey, max((o_orderkey % 2 = 0)::int) as has from orders where o_orderkey % 5 > 0 group by 1) using (o_custkey) where o_orderkey % 5 > 0 and (o_orderkey % 2 = 0) = (has = 1)")
def s18_company_facts(v, spark, d):
    """Facts as nested JSON under two tags of two namespaces; an entity's preferred tag alone counts if it has entries."""
    day = F.col("o_orderdate").cast("date")
    entry = F.struct(F.date_add(day, 400).cast("string").alias("filed"), F.date_add(day, 365).cast("string").alias("end"), day.cast("string").alias("start"), F.col("o_totalprice").alias("val"), F.when(F.col("o_orderkey") % 5 > 0, "10-K").otherwise("8-K").alias("form"), F.col("o_orderkey").cast("string").alias("accn"))
    of = lambda odd: F.filter(F.collect_list(F.when((F.col("o_orderkey") % 2 == 0) != F.lit(odd), entry)), lambda x: x.isNotNull())
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("entity")).agg(of(False).alias("even"), of(True).alias("odd"))
    tag = lambda n, c: F.struct(F.struct(F.struct(F.col(c).alias("USD")).alias("units")).alias(n))
    body = F.to_json(F.struct(F.struct(tag("NetIncome", "even").alias("us-gaap"), tag("ProfitLoss", "odd").alias("dei")).alias("facts")))
    return files.company_facts(o.select("entity", body.alias("json")), ("NetIncome", "ProfitLoss"))


@query("select 'EXP-' || event_id as id, ts as created, event_type as title, 'x' as kind from events")
def s22_saved_experiments(v, spark, d):
    e = X.table(spark, d, "events")
    body = F.to_json(F.struct(F.concat(F.lit("EXP-"), F.col("event_id").cast("string")).alias("id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created"), F.col("event_type").alias("title"), F.lit("x").alias("kind")))
    path = scratch(spark, "experiments")
    # one file an experiment would be many small ones: each file holds a list; files that are not JSON are skipped
    lists = e.select(F.pmod("event_id", F.lit(8)).alias("p"), body.alias("b")).groupBy("p").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("b")), F.lit("]")).alias("value"))
    for value in (lists.repartition(8, "p").select("value"), spark.createDataFrame([("not { json",)], "value string")):
        value.write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return files.experiments(spark, path).select("id", F.col("created").cast("timestamp_ntz").alias("created"), "title", "kind")


@query(sql("select ticker, session, round(close, 6) as close from panel", "panel"))
def k5_export_round_trip(v, spark, d):
    path = scratch(spark, "export")
    sinks.write_csv(v("panel"), path)
    return spark.read.schema("ticker string, session date, close double").option("header", True).csv(path)


@query(sql("select ticker as strategy, session, round(close, 6) as nav, 'Monte Carlo' as title from panel", "panel"))
def k3_experiment_snapshot(v, spark, d):
    """A run saved under its name and read again."""
    from datetime import datetime

    folder = scratch(spark, "snapshots")
    name = sinks.save_experiment(spark, folder, {"curves": _curves(v)}, {"title": "Monte Carlo"}, datetime(2024, 1, 2))
    got, meta = sinks.load_experiment(spark, folder, name)
    return got["curves"].withColumn("title", F.lit(meta["title"]))


@query("select user_id::varchar as owner, 'events' as portfolio, event_type as kind, event_id::varchar as record, props as payload from events where event_type = (select min(event_type) from events) and user_id = (select min(user_id) from events)")
def s21_journal_read(v, spark, d):
    from quantloom.streaming.journal import as_journal

    e = X.table(spark, d, "events")
    least = e.agg(F.min("user_id").cast("string").alias("u"), F.min("event_type").alias("k")).first()
    path = scratch(spark, "journal")
    sinks.journal_append(spark, path, as_journal(e).drop("ts"))
    return sinks.journal_read(spark, path, least["u"], least["k"], "events")


@query(sql("select ticker, session, round(close, 6) as close from panel where ticker <> 'NO'", "panel"))
def s12_completed_quotes(v, spark, d):
    p = v("panel").withColumns({"currency": F.when(F.col("ticker") == "NO", "USD").otherwise("EUR"), "exchange_tz": F.lit("Europe/Rome")})
    later = p.limit(1).withColumn("session", F.date_add(F.current_date(), 5))
    odd = p.limit(1).withColumn("ticker", F.lit("not a ticker!"))
    return A.completed_quotes(p.union(later).union(odd), "EUR").select("ticker", "session", "close")


@query(O.S10)
def s10_first_quotes(v, spark, d):
    p = v("panel").withColumn("ingest_ord", F.lit(1))
    empty = p.where("ticker = 'NO'").withColumn("close", F.lit(None).cast("double"))
    again = p.withColumns({"close": F.col("close") * 2, "ingest_ord": F.lit(2)})
    return S.first_quotes(p.where("ticker <> 'NO'").union(empty).union(again.where("ticker <> 'NO'")))


# --- screening and factors ------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as filings of the brands, of four kinds; some without a value."""
    names = X.table(spark, d, "part").select(F.col("p_brand").alias("entity")).distinct()
    from pyspark.sql import Window as W

    names = names.withColumn("b", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("entity")) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))  # one row a brand
    o, day = X.table(spark, d, "orders"), F.col("o_orderdate").cast("date")
    kind = F.get(F.array(*(F.lit(k) for k in S.FACT_KINDS)), (F.col("o_orderkey") % 4).cast("int"))
    return o.join(names, F.col("o_custkey") % F.col("n") == F.col("b")).select("entity", kind.alias("kind"), day.alias("filed"), F.date_sub(F.trunc(day, "month"), 1).alias("end"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("val"), F.col("o_orderkey").alias("accn"))


@query(O.S20)
def s20_fundamental_snapshots(v, spark, d):
    return S.fundamentals_at(_facts(spark, d), _dates(v))


@query(O.Q8)
def q8_four_factor_screen(v, spark, d):
    snapshots = S.fundamentals_at(_facts(spark, d), _dates(v))
    out = S.screen_four_factors(v("panel_brand"), _dates(v), snapshots, min_obs=120)
    return out.select("decision_date", "ticker", "momentum_score", "risk_score", "value_score", "quality_score", "quant_score", F.coalesce("rank", F.lit(0)).alias("rank"))


@query(O.F10)
def f10_market_factors(v, spark, d):
    rates = v("market").select("session", F.lit(2.0).alias("rate"))
    euro = FA.factors_for("Borsa Italiana", v("factors"), v("fx"), rates).withColumn("market", F.lit("Borsa Italiana"))
    return euro.unionByName(FA.factors_for("USA", v("factors")).withColumn("market", F.lit("USA")))


@query(O.F18)
def f18_strategy_attribution(v, spark, d):
    from pyspark.sql import Window as W

    first = F.first("close").over(W.partitionBy("ticker").orderBy("session"))
    fit = FA.multi_factor(FA.factor_sample(v("panel"), v("factors"))).where("status = 'ok'")
    nav = R.complete_sessions(v("panel")).select(F.col("ticker").alias("strategy"), "session", (F.col("close") / first * 10000).alias("nav")).join(fit.select(F.col("ticker").alias("strategy")), "strategy", "left_semi")
    at = B.sessions(v("panel")).where(F.col("no") % 20 == 0).select("session")
    own = fit.select(F.col("ticker").alias("strategy"), "ticker", F.lit(1.0).alias("w")).crossJoin(at)
    return FA.strategy_attribution(nav, v("factors"), own, fit, 10_000.0)


@query(O.R13)
def r13_live_risk(v, spark, d):
    value = F.max_by("close", "session") * (F.ascii("ticker") - 60)
    return R.live_risk_contributions(v("panel").groupBy("ticker").agg(value.alias("value")), _rets(v))


# --- backtests ------------------------------------------------------------------------------------


def _equal(v, lookback=52, rebalance=26):
    p = R.complete_sessions(v("panel"))
    return p, B.walk_forward_weights(p, lookback, rebalance, EQUAL)


def _windows(v):
    p = R.complete_sessions(v("panel"))
    num = B.sessions(p)
    return p, num, B.schedule(num, 104, 52)


@query(O.B1_CAPM)
def b1_capm_means(v, spark, d):
    p, num, plan = _windows(v)
    return B.capm_moments(p, v("market"), num, plan, 104)


@query(O.B1_FF3)
def b1_three_factor_means(v, spark, d):
    p, num, plan = _windows(v)
    return B.factor_moments(p, v("factors"), num, plan, 104, B.FACTOR_NAMES["ff3"])[0]


@query()
def b1_ten_strategies(v, spark, d):
    return B.walk_forward_weights(R.complete_sessions(v("panel")), 104, 52, B.ALL_MODELS, cap=0.5, market=v("market"), factors=_five(v))


@query()
def b2_selection_policies(v, spark, d):
    p = v("panel_brand")
    num = B.sessions(p)
    plan = B.schedule(num, 260, 26)
    return B.selection(p, num, plan, "fixed").withColumn("policy", F.lit("fixed")).unionByName(B.selection(p, num, plan, "dynamic").withColumn("policy", F.lit("dynamic")))


@query()
def b11_ten_strategies(v, spark, d):
    p = R.complete_sessions(v("panel"))
    w = B.walk_forward_weights(p, 104, 52, B.ALL_MODELS, cap=0.5, market=v("market"), factors=_five(v))
    return B.performance(B.net_nav(w, p, 10_000.0).select("strategy", "session", "nav"), 10_000.0)


@query(O.B6)
def b6_ex_ante_equal_weight(v, spark, d):
    p, w = _equal(v)
    num = B.sessions(p)
    return B.ex_ante_kpis(w, *B.window_moments(p, num, B.schedule(num, 52, 26), 52))


@query(O.B7)
def b7_exposures_equal_weight(v, spark, d):
    fit = FA.multi_factor(FA.factor_sample(v("panel"), v("factors"))).where("status = 'ok'").select("ticker", "beta_mkt_rf", "beta_smb", "beta_hml")
    return B.exposures(_equal(v)[1], fit, ("beta_mkt_rf", "beta_smb", "beta_hml"))


@query(O.B10)
def b10_fixed_horizon_equal_weight(v, spark, d):
    return B.fixed_horizon(R.complete_sessions(v("panel")), 104, 52, EQUAL)


@query(O.B11)
def b11_engine_equal_weight(v, spark, d):
    out = B.standard_engine(R.complete_sessions(v("panel")), v("market"), 10_000.0, 52, 26, costs=B.PRESETS["None"], models=EQUAL)
    return out.drop("total_cost", "paid_rebalances", "gross_return", "cost_drag")


@query(O.B15)
def b15_history_equal_weight(v, spark, d):
    h = B.history_table(_equal(v)[1])
    return h.select("strategy", "t", "turnover", F.size("holdings").alias("active"), F.array_join(F.array_sort(F.map_keys("holdings")), ",").alias("tickers"))


@query(O.B17)
def b17_buy_and_hold_equal_weight(v, spark, d):
    p, w = _equal(v)
    return B.buy_and_hold(w, p, 10_000.0)


@query(O.B26)
def b26_overlay_of_fixed_costs(v, spark, d):
    p, w = _equal(v)
    days = w.select("strategy", F.col("t").alias("no")).distinct().join(B.sessions(p), "no").select("strategy", "session", F.lit(25.0).alias("cost"))
    return B.cost_overlay(B.gross_nav(w, p, 10_000.0), days)


@query(O.B30)
def b30_drift_equal_weight(v, spark, d):
    p, w = _equal(v)
    return B.drift_turnover(w, p)


@query(O.K4)
def k4_order_log(v, spark, d):
    p, w = _equal(v)
    return B.order_log(w, p, B.gross_nav(w, p, 10_000.0))


def _robust(v):
    p = v("panel")
    win = RB.calendar(p, "1993-01-04", "1998-01-04", 1, 12, 6, *WEEKLY)
    return RB.run(p, win, RB.window_weights(p, win, EQUAL), v("market"))


@query(O.B28)
def b28_robustness_equal_weight(v, spark, d):
    return RB.roll_up(_robust(v))


@query(O.B29)
def b29_paired_equal_weight(v, spark, d):
    return RB.paired(_robust(v))


@query(O.B16_INCEPTION)
def b16_inception(v, spark, d):
    from pyspark.sql import Window as W

    share = (F.col("close") / F.sum("close").over(W.partitionBy("session"))).alias("w")
    return B.inception_diagnostics(v("panel").select(F.lit("x").alias("strategy"), F.col("session").alias("t"), "ticker", share))


@query(O.L6)
def l6_daily_estimators(v, spark, d):
    """Over the last 200 returns."""
    return L.daily_estimators(R.complete_sessions(v("panel")), v("market"), v("factors"), _five(v), v("fx"), 0.02, 200)
